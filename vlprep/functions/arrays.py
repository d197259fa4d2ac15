"""Expressions on token arrays: padding, masks, labels, prefixes, stop cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vlprep.config import IGNORE_LABEL, LENGTH_HIGH, LENGTH_LOW, PAD_ID, QUERY_POSITIONS, LabelRule
from vlprep.functions.vectors import let


def _fill(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value).cast("int"), n.cast("int"))


def length_between(n: Column, low: int = LENGTH_LOW, high: int = LENGTH_HIGH) -> Column:
    """``low < n < high``, written so that ``n`` is evaluated once per row."""
    return F.abs(n * 2 - F.lit(low + high)) < F.lit(high - low)


def pad(ids: Column, width: Column, pad_id: int = PAD_ID) -> Column:
    return F.concat(ids, _fill(pad_id, width - F.size(ids)))


def mask(ids: Column, width: Column) -> Column:
    """1 for real tokens, 0 for pads."""
    return F.concat(_fill(1, F.size(ids)), _fill(0, width - F.size(ids)))


def seq_len(attention_mask: Column) -> Column:
    return F.aggregate(attention_mask, F.lit(0), lambda acc, x: acc + x)


def labels(ids: Column, width: Column, prompt_len: Column | None, rule: LabelRule, pad_id: int = PAD_ID) -> Column:
    """Labels of a padded row: its ids, with prompt and/or pad positions ignored."""
    shown = F.least(prompt_len, F.size(ids)) if rule.mask_prompt and prompt_len is not None else F.lit(0)
    tail = IGNORE_LABEL if rule.mask_pad else pad_id
    return F.concat(
        _fill(IGNORE_LABEL, shown),
        F.slice(ids, shown.cast("int") + 1, F.size(ids)),
        _fill(tail, width - F.size(ids)),
    )


def prefixed(values: Column, fill: int, positions: int = QUERY_POSITIONS, brackets: bool = True) -> Column:
    """Put the image positions (and their two brackets) in front of an array."""
    n = positions + 2 if brackets else positions
    return F.concat(_fill(fill, F.lit(n)), values)


def prefixed_ids(ids: Column, image_id: int, start_id: int, end_id: int,
                 positions: int = QUERY_POSITIONS, brackets: bool = True) -> Column:
    one = lambda v: F.array(F.lit(v).cast("int"))
    image = _fill(image_id, F.lit(positions))
    return F.concat(one(start_id), image, one(end_id), ids) if brackets else F.concat(image, ids)


def cut_at_stop(ids: Column, attention_mask: Column, prompt_len: Column, stop_id: int) -> Column:
    """Generated row up to, not including, the first stop id after the prompt.

    A struct of ``answer_ids`` and ``finish_index``, the zero-based place of the
    stop id. Rows without one end at their mask length, with a null index.
    """

    def cut(n: Column) -> Column:
        answer = F.slice(ids, prompt_len.cast("int") + 1, F.greatest(n - prompt_len, F.lit(0)).cast("int"))
        return let(F.array_position(answer, F.lit(stop_id).cast("int")), lambda at: kept(n, at))

    def kept(n: Column, at: Column) -> Column:
        finish = F.when(at > 0, prompt_len + at - 1).cast("bigint")
        answer = F.slice(ids, F.lit(1), F.coalesce(finish, n).cast("int"))
        return F.struct(answer.alias("answer_ids"), finish.alias("finish_index"))

    return let(seq_len(attention_mask), cut)


def masked_sum(losses: Column, label_ids: Column) -> Column:
    """Sum of the losses at positions whose label is not ignored."""
    kept = F.zip_with(losses, label_ids, lambda x, y: F.when(y != IGNORE_LABEL, x.cast("double")).otherwise(F.lit(0.0)))
    return F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)


def kept_count(label_ids: Column) -> Column:
    return F.size(F.filter(label_ids, lambda y: y != IGNORE_LABEL))
