"""Batches, padding, masks, labels and image prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vlprep.config import IGNORE_LABEL, PAD_ID, QUERY_POSITIONS, LabelRule
from vlprep.functions import arrays
from vlprep.operators.ranking import exact_rank


def assign_batches(df: DataFrame, order: str, size: int, drop_last: bool = False, dear: bool = False,
                   like: DataFrame | None = None) -> DataFrame:
    """Add ``batch_id`` and ``pos`` (place in the batch), batches of ``size`` rows in order of ``order``.

    ``drop_last`` leaves out the rows of an incomplete last batch. ``dear`` and ``like``: see :func:`exact_rank`.
    """
    ranked = exact_rank(df, order, "_place", dear, like, total="_rows")
    if drop_last:
        ranked = ranked.filter(F.col("_place") < F.col("_rows") - F.col("_rows") % size)
    return ranked.withColumns(
        {"batch_id": F.expr(f"_place div {int(size)}"), "pos": F.col("_place") % size}
    ).drop("_place", "_rows")


def pad_batch(df: DataFrame, ids: str = "ids", batch: str | list[str] = "batch_id", pad_id: int = PAD_ID) -> DataFrame:
    """Add ``batch_len``, ``input_ids`` and ``attention_mask``, padded to the longest row of the batch.

    Groups by batch, whose size the batching bounds.
    """
    by = [batch] if isinstance(batch, str) else list(batch)
    wide = df.withColumn("batch_len", F.max(F.size(ids)).over(W.partitionBy(*by)))
    return wide.withColumns(
        {
            "input_ids": arrays.pad(F.col(ids), F.col("batch_len"), pad_id),
            "attention_mask": arrays.mask(F.col(ids), F.col("batch_len")),
        }
    )


def make_labels(df: DataFrame, rule: LabelRule, ids: str = "ids", prompt_len: str | None = "prompt_len",
                pad_id: int = PAD_ID, out: str = "labels") -> DataFrame:
    """Labels of rows padded by :func:`pad_batch`."""
    prompt = F.col(prompt_len) if prompt_len else None
    return df.withColumn(out, arrays.labels(F.col(ids), F.col("batch_len"), prompt, rule, pad_id))


def extend_prefix(df: DataFrame, positions: int = QUERY_POSITIONS, brackets: bool = True, image_id: int = PAD_ID,
                  start_id: int = PAD_ID, end_id: int = PAD_ID) -> DataFrame:
    """Put the image positions in front of ids, mask and labels, always all three."""
    return df.withColumns(
        {
            "input_ids": arrays.prefixed_ids(F.col("input_ids"), image_id, start_id, end_id, positions, brackets),
            "attention_mask": arrays.prefixed(F.col("attention_mask"), 1, positions, brackets),
            "labels": arrays.prefixed(F.col("labels"), IGNORE_LABEL, positions, brackets),
        }
    )


def label_stats(df: DataFrame, ids: str = "ids", prompt_len: str = "prompt_len", batch: str = "batch_id") -> DataFrame:
    """Real, pad, prompt and supervised token counts per batch."""
    n, shown = F.size(ids), F.least(F.col(prompt_len), F.size(ids))
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(n).cast("bigint").alias("real_tokens"),
        F.sum(F.col("batch_len") - n).cast("bigint").alias("pad_tokens"),
        F.sum(shown).cast("bigint").alias("prompt_tokens"),
        F.sum(arrays.kept_count(F.col("labels"))).cast("bigint").alias("supervised_tokens"),
    )


def batch_summary(df: DataFrame, ids: str = "ids", batch: str = "batch_id") -> DataFrame:
    """Rows, longest row, real and pad tokens of each batch. Needs no padding done."""
    n = F.size(ids).cast("bigint")
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(n).alias("max_len"),
        F.sum(n).alias("real_tokens"),
        (F.max(n) * F.count(F.lit(1)) - F.sum(n)).alias("pad_tokens"),
    )
