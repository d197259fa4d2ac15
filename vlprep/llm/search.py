"""Ranked search of texts by words, over posting lists that are blocked by similarity.

Documents are taken in segments. A segment holds the counted terms of its documents (for exact
scores) and a posting list per term. Documents of a long list are clustered around some of their own by the
similarity of their vectors of impacts; each cluster is a block. Its summary is, for each
frequent term of the segment, the largest impact in the block.

A query first scores all documents of its short lists. The documents left hold no other
terms of it than frequent ones, so the summaries bound their scores exactly: a block is
skipped only if the sum of its largest impacts over the query's terms stays
below the score that the k-th best document already has. Results are those of scoring everything.

The index holds the terms that the queries use: no other term adds to a score.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vlprep.llm.common import arrow_batches, seeds, steps, stored
from vlprep.session import run_dir

#: Postings of a segment; a document with more is a segment of its own.
SEGMENT_POSTINGS = 250_000
#: Lists up to this length are scored whole; longer ones have blocks.
SHORT_LIST = 256
#: Documents of a block on average.
BLOCK = 128
#: Numbers in the sketch by which documents are compared.
SKETCH = 16
#: Terms of queries, repeats included, that are shipped at a time.
QUERY_TERMS = 200_000
#: Bytes of a text that are split into terms at a time.
PIECE = 4 << 20
#: Groups in which the best of the tasks are merged before the last merge.
MERGES = 64
#: Most rows that Python gets at a time.
ROWS = 10_000
#: Stands for a null id, behind all others.
NO_ID = (1 << 63) - 1

# Characters that are no part of a term, as ranges of code points.
SEPARATORS = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_plain = bytearray(range(256))
for _first, _last in SEPARATORS:
    _plain[_first : _last + 1] = b" " * (_last + 1 - _first)
_plain[65:91] = LOWER.encode()
TABLE = bytes(_plain)


def term_counts(text: bytes) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each occurs. A piece is split at a time."""
    text = text.translate(TABLE)
    if len(text) <= PIECE:
        words = text.split()
        return len(words), Counter(words)
    n, counts, begin = 0, Counter(), 0
    while begin < len(text):
        end = text.find(b" ", begin + PIECE)
        end = len(text) if end < 0 else end
        words = text[begin:end].split()
        n += len(words)
        counts.update(words)
        begin = end
    return n, counts


def _count_rows(batches, vocabulary: dict[bytes, int]):
    known = vocabulary.keys()
    for part, texts in steps(batches, 1):
        sizes, lengths, terms, counts = [], [0], [], []
        for text in texts:
            n, found = term_counts(text)
            mine = found.keys() & known
            sizes.append(n)
            terms.extend(map(vocabulary.__getitem__, mine))
            counts.extend(map(found.__getitem__, mine))
            lengths.append(len(terms))
        ends = pa.array(lengths, pa.int32())
        columns = [part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"])


def impacts(counts: np.ndarray, weights: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score: its weight, its count, the document's length factor."""
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def _gather(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of several ranges one after the other, and where each range begins among them."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(int(sizes.sum())), first


class Segment:
    """Some documents: counted terms by document, lists by term, blocks of the long lists with summaries."""

    COLUMNS = {"ids": "<i8", "starts": "<i8", "terms": "<i4", "impacts": "<i8", "list_terms": "<i4", "list_starts": "<i8", "list_docs": "<i4", "frequent": "<i4", "block_starts": "<i8", "list_blocks": "<i8", "summaries": "<i8"}

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        self.summaries = self.summaries.reshape(len(self.block_starts) - 1, len(self.frequent))

    @classmethod
    def build(cls, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray) -> Segment:
        """From document ids, their numbers of terms, and the terms and impacts of one after the other."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        list_terms, list_starts = np.unique(terms[order], return_index=True)
        list_starts = np.append(list_starts, len(terms))
        list_docs = doc[order]
        frequent = np.flatnonzero(np.diff(list_starts) > SHORT_LIST)
        column = np.full(len(list_terms), -1)
        column[frequent] = np.arange(len(frequent))
        column = column[np.searchsorted(list_terms, terms)]
        dense = np.zeros((len(ids), len(frequent)), np.int64)
        dense[doc[column >= 0], column[column >= 0]] = values[column >= 0]
        sketch = cls._sketch(starts, terms, values)
        block_starts, list_blocks, summaries = [], [0], []
        for place in frequent:
            a, b = list_starts[place], list_starts[place + 1]
            docs = list_docs[a:b]
            leaders = docs[:: max(1, len(docs) // -(-len(docs) // BLOCK))]
            nearest = np.argmax(sketch[docs] @ sketch[leaders].T, axis=1)
            docs = docs[np.argsort(nearest, kind="stable")]
            begins = np.flatnonzero(np.diff(np.sort(nearest), prepend=-1))
            list_docs[a:b] = docs
            block_starts.append(begins + a)
            list_blocks.append(list_blocks[-1] + len(begins))
            summaries.append(np.maximum.reduceat(dense[docs], begins, axis=0))
        return cls(
            ids=ids, starts=starts, terms=terms, impacts=values, list_terms=list_terms, list_starts=list_starts, list_docs=list_docs,
            frequent=frequent, block_starts=np.concatenate([*block_starts, [len(terms)]]).astype(np.int64), list_blocks=np.array(list_blocks),
            summaries=np.concatenate(summaries) if summaries else np.zeros((0, 0), np.int64),
        )

    @staticmethod
    def _sketch(starts: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Vectors of impacts, projected on a few random signs and made unit length."""
        bits = (seeds(1, 21)[0] * (terms.astype(np.uint64) + np.uint64(1))) >> np.uint64(64 - SKETCH)
        out = np.zeros((len(starts) - 1, SKETCH), np.float32)
        for j in range(SKETCH):
            signed = np.where((bits >> np.uint64(j)) & np.uint64(1), values, -values).astype(np.float64)
            total = np.concatenate([[0.0], np.cumsum(signed)])
            out[:, j] = total[starts[1:]] - total[starts[:-1]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def to_row(self) -> dict[str, bytes]:
        return {c: np.ascontiguousarray(getattr(self, c)).astype(t).tobytes() for c, t in self.COLUMNS.items()}

    @classmethod
    def from_row(cls, row: dict[str, bytes]) -> Segment:
        return cls(**{c: np.frombuffer(row[c], t).astype(t[1:].replace("i4", "i8")) for c, t in cls.COLUMNS.items()})

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of some documents for the terms marked in ``wanted``."""
        places, first = _gather(self.starts[docs], self.starts[docs + 1])
        return np.add.reduceat(self.impacts[places] * wanted[self.terms[places]], first)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the short and of the long lists of a query's terms."""
        at = np.minimum(np.searchsorted(self.list_terms, terms), len(self.list_terms) - 1)
        at = at[self.list_terms[at] == terms]
        long = np.diff(self.list_starts)[at] > SHORT_LIST
        return at[~long], at[long]

    def members(self, lists: np.ndarray) -> np.ndarray:
        """Documents of some lists, each once."""
        return np.unique(self.list_docs[_gather(self.list_starts[lists], self.list_starts[lists + 1])[0]])

    def beyond(self, short: np.ndarray, long: np.ndarray, wanted: np.ndarray, least: int):
        """Documents without terms of short lists whose score is ``least`` or more, and their scores.

        Goes through the long lists from the highest impact on. Documents of a list that
        is done need no more attention, so its term no longer counts in the bounds of those that follow.
        """
        seen = np.zeros(len(self.ids), bool)
        seen[self.members(short)] = True
        columns = np.searchsorted(self.frequent, long)
        tops = [self.summaries[self.list_blocks[c] : self.list_blocks[c + 1], c].max() for c in columns]
        columns = columns[np.argsort(tops)[::-1]]
        for i, c in enumerate(columns):
            a, b = self.list_blocks[c], self.list_blocks[c + 1]
            bounds = self.summaries[a:b, columns[i:]].sum(axis=1)
            live = a + np.flatnonzero(bounds >= least)
            # the last block of a list ends where the list does
            ends = np.minimum(self.block_starts[live + 1], self.list_starts[self.frequent[c] + 1])
            docs = self.list_docs[_gather(self.block_starts[live], ends)[0]]
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                yield docs, self.scores(docs, wanted)


def _segment_rows(batches, weights: np.ndarray, n_docs: int, n_terms: int):
    held: list[tuple] = []
    waiting = 0

    def row():
        ids, m, sizes, terms, counts = (np.concatenate(c) for c in zip(*held))
        built = Segment.build(ids, sizes, terms, impacts(counts, weights[terms], np.repeat(m, sizes))).to_row()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in built.values()], list(built))

    for batch in batches:
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        lengths = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
        # whole numbers of any size: the product below can pass 64 bits
        m = np.array([100 - 90 + (90 * n * n_docs) // n_terms for n in batch.column("n").to_pylist()], np.int64)
        terms, counts = (batch.column(c).flatten().to_numpy() for c in ("terms", "counts"))
        ends = np.cumsum(lengths)
        begin = 0
        while begin < len(ids):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SEGMENT_POSTINGS - waiting, "right")))
            part = slice(before, int(ends[end - 1]))
            held.append((ids[begin:end], m[begin:end], lengths[begin:end], terms[part], counts[part]))
            waiting += part.stop - part.start
            begin = end
            if waiting >= SEGMENT_POSTINGS or begin < len(ids):
                yield row()
                waiting = 0
    if held:
        yield row()


def _search_rows(batches, queries: list[np.ndarray], n_vocabulary: int, k: int, least: list[int] | None):
    """The best of a task for each query: from short lists, or, given the k-th best scores, from blocks of long ones."""
    best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
    wanted = np.zeros(n_vocabulary, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            segment = Segment.from_row(row)
            for q, terms in enumerate(queries):
                short, long = segment.lists(terms)
                wanted[terms] = 1
                if least is None:
                    docs = segment.members(short)
                    found = [(docs, segment.scores(docs, wanted))] if len(docs) else []
                else:
                    have = best[q][0]
                    bar = max(least[q], int(have[-1]) if len(have) >= k else 1)
                    found = segment.beyond(short, long, wanted, bar) if len(long) else []
                for docs, scores in found:
                    ok = scores > 0
                    both, ids = np.concatenate([best[q][0], scores[ok]]), np.concatenate([best[q][1], segment.ids[docs[ok]]])
                    order = np.lexsort((ids, -both))[:k]
                    best[q] = both[order], ids[order]
                wanted[terms] = 0
    for q, (scores, ids) in enumerate(best):
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(scores)], ["query", "doc_id", "score"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query over all tasks with ``rank``, merged in two levels."""
    order = [F.col("score").desc(), F.col("doc_id")]
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES)))
    some = salted.withColumn("_r", F.row_number().over(W.partitionBy("query", "_salt").orderBy(*order))).filter(F.col("_r") <= k)
    ranked = some.select("query", "doc_id", "score", F.row_number().over(W.partitionBy("query").orderBy(*order)).alias("rank"))
    return ranked.filter(F.col("rank") <= k)


def item_terms(items: DataFrame) -> DataFrame:
    """(``item_id``, ``term``), each once; rows of one ``item_id`` are one item."""
    lower = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    terms = F.regexp_extract_all(lower, F.lit(f"({TERM})"), F.lit(1))
    return items.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), F.explode(terms).alias("term")).distinct()


def index(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Segments of counted documents (``doc_id``, ``n``, ``terms``, ``counts``), stored in small row groups."""
    spark = counted.sparkSession
    path = run_dir(spark, "segments")
    schema = ", ".join(f"{c} binary" for c in Segment.COLUMNS)
    built = counted.mapInArrow(partial(_segment_rows, weights=weights, n_docs=n_docs, n_terms=n_terms), schema)
    built.write.option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(built.schema).parquet(path)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents of the highest scores above 0 for each item: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``. Equal scores go by ascending ``doc_id``, null
    behind. Repeated rows of ``docs`` are documents of their own. Rows of one ``item_id`` (or without one) are one item. Null and empty texts have no
    terms; items without a match have no rows. Other columns don't matter.

    A term's weight is ``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))`` with ``N`` the documents that have
    terms; a document's length factor ``m`` is ``10 + 90 * n * N div L``; a term adds
    ``weight * (10**9 * tf div (1000 * tf + 8 * m))``.
    """
    # every job that runs Python is started in here
    with arrow_batches(docs.sparkSession, ROWS):
        return _search(docs, items, k)


def _search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    wanted = stored(item_terms(items), "item-terms")
    n_blocks = -(-wanted.count() // QUERY_TERMS)
    found = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for i in range(n_blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).collect()  # at most about QUERY_TERMS rows
        vocabulary = {t: j for j, t in enumerate(sorted({r.term.encode() for r in rows}))}
        if not rows:
            continue
        by_item: dict[int | None, list[int]] = {}
        for r in rows:
            by_item.setdefault(r.item_id, []).append(vocabulary[r.term.encode()])
        names, queries = list(by_item), [np.sort(np.array(t, np.int64)) for t in by_item.values()]
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        counted = stored(plain.mapInArrow(partial(_count_rows, vocabulary=vocabulary), "doc_id long, n long, terms array<int>, counts array<long>"), "terms")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_terms:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for term, count in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the vocabulary
            df[term] = count
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        segments = index(counted.filter(F.size("terms") > 0), weights, n_docs, n_terms)
        with arrow_batches(spark, 1):  # a segment at a time
            run = partial(_search_rows, queries=queries, n_vocabulary=len(vocabulary), k=k)
            schema = "query long, doc_id long, score long"
            near = stored(segments.mapInArrow(partial(run, least=None), schema), "found")
            least = [1] * len(queries)
            for q, score in _merged(near, k).filter(F.col("rank") == k).select("query", "score").collect():  # at most a row an item
                least[q] = score
            far = stored(segments.mapInArrow(partial(run, least=least), schema), "found")
        ids = spark.createDataFrame(list(enumerate(names)), "query long, item_id long")
        doc = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
        found.append(_merged(near.unionByName(far), k).join(F.broadcast(ids), "query").select("item_id", "rank", doc, "score"))
    return reduce(DataFrame.unionByName, found)


__all__ = ["Segment", "impacts", "index", "item_terms", "search", "term_counts"]
