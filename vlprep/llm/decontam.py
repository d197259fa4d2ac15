"""Benchmark passages in documents, found by winnowing.

Every text is fingerprinted: of each ``WINDOW`` = 7 consecutive hashes of
``GRAM`` = 7 words, the smallest is kept (the last one on ties). Any span of 13
words shared by a document and an item has a fingerprint in common (Schleimer et
al., 2003). Equal fingerprints that follow each other in equal steps, as in a
text of one word, are one run. Runs of both sides are joined, each hit is extended to both
sides word by word, and extensions of at least 13 words count. Where
runs allow many ways to lay an item on a document, the document's windows of 13 words are looked up among the item's instead. Items of fewer
words are fingerprinted by all their words, and documents by every run of as
many words as some such item has.

The benchmark may be of any size: its fingerprints are broadcast only after
their number is checked.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.llm.common import Words, arrow_batches, grams, renamed, small, steps, stored

SPAN = 13
GRAM = 7
WINDOW = SPAN - GRAM + 1
#: Ways to lay an item on a document that are tried one by one.
MOST_SHIFTS = 64
#: Most rows that Python gets at a time.
ROWS = 10_000

#: Bytes of words: 0-9, a-z (A-Z are lowered before) and every byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Positions kept: the smallest hash of every window, the last one on ties."""
    if len(hashes) < WINDOW:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(views)) + WINDOW - 1 - views.argmin(1))


def fingerprints(own: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint hashes and the word positions they begin at.

    ``short`` lists the lengths below ``SPAN`` whose runs of words are all taken.
    """
    hashes = grams(own, GRAM)
    at = winnow(hashes)
    found, where = [hashes[at]], [at]
    for n in short:
        runs = grams(own, n)
        found.append(runs ^ np.uint64(n << 32))
        where.append(np.arange(len(runs)))
    return np.concatenate(found), np.concatenate(where)


def runs(found: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal fingerprints in equal steps as one: hash, first and last position, and the step (0 for one alone)."""
    if not len(found):
        return found, where, where, where
    step = np.diff(where)
    same = (found[1:] == found[:-1]) & (step > 0)
    goes_on = same.copy()
    goes_on[1:] &= ~same[:-1] | (step[1:] == step[:-1])
    begins = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    ends = np.append(begins[1:], len(found)) - 1
    width = np.where(ends > begins, np.append(step, 0)[begins], 0)
    return found[begins], where[begins], where[ends], width


def _item_rows(batches):
    for batch, texts in steps(batches):
        words = Words(texts, WORD_BYTES)
        rows = []
        for i in range(len(texts)):
            own = words.of(i)
            n = len(own)
            found, first, last, step = runs(*(fingerprints(own, []) if n >= SPAN else fingerprints(own, [n]) if n else (own, np.empty(0, np.int64))))
            rows.append((n, found.astype(np.uint64).view(np.int64).tolist(), first.tolist(), last.tolist(), step.tolist(), own.tobytes()))
        n, found, first, last, step, own = zip(*rows) if rows else ([],) * 6
        lists = [pa.array(c, pa.list_(pa.int64())) for c in (found, first, last, step)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(n, pa.int64()), *lists, pa.array(own, pa.binary())], ["item_id", "n", "found", "first", "last", "step", "words"])


def _document_rows(batches, short: list[int]):
    for batch, texts in steps(batches):
        words = Words(texts, WORD_BYTES)
        ids, parts = [], []
        for i in range(len(texts)):
            part = runs(*fingerprints(words.of(i), short))
            ids.append(np.full(len(part[0]), i))
            parts.append(part)
        found, first, last, step = (np.concatenate(c) for c in zip(*parts))
        columns = [found.view(np.int64), *(c.astype(np.int64) for c in (first, last, step))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(np.concatenate(ids))), *map(pa.array, columns)], ["doc_id", "print", "d_first", "d_last", "d_step"])


def _extended(own: np.ndarray, item: np.ndarray, shift: int) -> list[tuple[int, int]]:
    """Runs of equal words of document and item, the item laid at word ``shift``, that are long enough."""
    begin, end = max(0, shift), min(len(own), shift + len(item))
    if end <= begin:
        return []
    same = np.diff(np.concatenate([[0], (own[begin:end] == item[begin - shift : end - shift]).view(np.int8), [0]]))
    runs = zip(np.flatnonzero(same == 1) + begin, np.flatnonzero(same == -1) + begin)
    return [(a, b) for a, b in runs if b - a >= min(SPAN, len(item))]


def _windows(own: np.ndarray, item: np.ndarray) -> list[tuple[int, int]]:
    """The document's windows that are windows of the item, wherever they stand in it."""
    n = min(SPAN, len(item))
    at = np.flatnonzero(np.isin(grams(own, n), grams(item, n)))
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > n)  # windows that touch are one span
    return list(zip(at[np.append(0, cuts + 1)].tolist(), (at[np.append(cuts, len(at) - 1)] + n).tolist()))


def _spans(own: np.ndarray, item: np.ndarray, ways: list[dict]) -> list[tuple[int, int]]:
    """Words of a document in windows of an item; ``ways`` are ranges of places to lay the item."""
    ranges = [range(w["low"], w["high"] + 1, w["step"] or 1) for w in ways]
    if sum(map(len, ranges)) > MOST_SHIFTS:
        return _windows(own, item)
    return [span for shift in sorted(set().union(*ranges)) for span in _extended(own, item, shift)]


def _verdict_rows(batches, text: str):
    """Columns: ``hits``, ``text``, and those to keep, c0, c1 and so on, of which ``text`` may be one."""
    for batch, texts in steps(batches, text):
        hits = batch.column("hits")
        kept = [c for c in batch.schema.names if c.startswith("c")]
        rows = []
        if hits.null_count < len(hits):
            words = Words(texts, WORD_BYTES)
            sizes = np.diff(words.first)
        else:
            sizes = Words.count(texts, WORD_BYTES)
        for i in range(len(texts)):
            n, hit, items, spans = int(sizes[i]), 0, [], []
            if hits[i].is_valid:
                own, mask = words.of(i), np.zeros(n + 1, np.int64)
                for h in hits[i].as_py():
                    found = _spans(own, np.frombuffer(h["words"], np.uint64), h["ways"])
                    for a, b in found:
                        mask[a] += 1
                        mask[b] -= 1
                    if found:
                        items.append(h["item_id"])
                covered = np.diff(np.concatenate([[0], (np.cumsum(mask) > 0).view(np.int8)]))
                spans = [{"begin": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(covered == 1), np.flatnonzero(covered == -1))]
                hit = sum(s["end"] - s["begin"] for s in spans)
            rows.append((n, hit, items, spans))
        n, hit, items, spans = zip(*rows)
        kind = batch.schema.field("hits").type.value_type.field("item_id").type
        found = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(kind)), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *found], [*kept, *RESULTS])


RESULTS = ("n_words", "n_hit", "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` with ``n_words``, ``n_hit``, ``items`` (found item ids) and ``spans`` (hit word ranges).

    ``docs`` needs ``doc_id`` and ``text``, which come first; ``keep`` names further columns to
    carry along, any but those of the results. ``benchmark`` needs ``item_id`` and ``text``. Null and empty
    texts have no words and no hits; items without words are found nowhere. Rows
    that share a ``doc_id``, a null one too, are judged each by its own
    text; items that share an ``item_id`` count once. Empty tables give no hits.
    """
    columns = list(dict.fromkeys(["doc_id", "text", *(keep or [])]))
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    kind = dict(items.dtypes)["item_id"]
    lists = "found array<long>, first array<long>, last array<long>, step array<long>"
    items = stored(items.mapInArrow(_item_rows, f"item_id {kind}, n long, {lists}, words binary").filter("n > 0"), "items").withColumn("item_no", F.xxhash64("item_id", "words"))
    short = sorted(r[0] for r in items.filter(F.col("n") < SPAN).select("n").distinct().collect())  # at most 12 lengths
    marks = items.select("item_no", F.explode(F.arrays_zip("found", "first", "last", "step")).alias("f"))
    marks = stored(marks.select("item_no", F.col("f.found").alias("print"), F.col("f.first").alias("i_first"), F.col("f.last").alias("i_last"), F.col("f.step").alias("i_step")), "item-prints")
    ids = dict(docs.dtypes)["doc_id"]
    seen = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        partial(_document_rows, short=short), f"doc_id {ids}, print long, d_first long, d_last long, d_step long"
    )
    alike = (F.col("d_step") == F.col("i_step")) | (F.col("d_step") == 0) | (F.col("i_step") == 0)
    step = F.when(alike, F.greatest("d_step", "i_step")).otherwise(1)
    ways = F.struct((F.col("d_first") - F.col("i_last")).alias("low"), (F.col("d_last") - F.col("i_first")).alias("high"), step.alias("step"))
    hits = (
        seen.join(small(marks), "print")
        .groupBy("doc_id", "item_no")
        .agg(F.collect_set(ways).alias("ways"))
        .join(small(items.select("item_no", "item_id", "words")), "item_no")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("item_id", "words", "ways")).alias("hits"))
    )
    with arrow_batches(docs.sparkSession, ROWS):
        hits = stored(hits.withColumnRenamed("doc_id", "_doc"), "hits")
    source, kept, names = renamed(docs, columns, RESULTS, F.col("doc_id"), F.col("text").cast("string"))
    joined = source.join(small(hits), F.col("l0").eqNullSafe(F.col("_doc")), "left")
    text = "c1" if dict(docs.dtypes)["text"] == "string" else "l1"  # Python gets each text once where it can
    joined = joined.select("hits", *[c for c in source.columns if c == text or c.startswith("c")])
    schema = f"{kept}n_words long, n_hit long, items array<{kind}>, spans array<struct<begin: long, end: long>>"
    return joined.mapInArrow(partial(_verdict_rows, text=text), schema).withColumn("items", F.array_distinct("items")).toDF(*names, *RESULTS)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """The contract's rule: at least a twentieth of the words is hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
