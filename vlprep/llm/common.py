"""Shared parts: texts as flat byte arrays, word hashes, stored tables, connected components."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vlprep.session import run_dir
from vlprep.session import small as few_rows

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 18
#: Bytes of an Arrow batch where an operator starts the job itself.
BATCH_BYTES = 4 << 20
#: Bytes, as stored, up to which a table is broadcast.
BROADCAST_BYTES = 16 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


BYTE_CODES = seeds(256, 11)
_BASE = int(seeds(1, 12)[0])
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 2 * STEP_BYTES), base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have if len(have) <= 4 * STEP_BYTES else have[: 2 * STEP_BYTES].copy()
    return have[:n]


def worker_cache(name: str) -> dict:
    """A dictionary that a Python worker keeps from task to task, though functions reach it anew with every task."""
    home = sys.modules.setdefault("_vlprep_worker", types.ModuleType("_vlprep_worker"))
    return home.__dict__.setdefault(name, {})


#: What :func:`worker_cache` has of token encoders: hundreds of MB, which workers that go on to other work let go.
ENCODERS = "token encoders"


def let_go() -> None:
    """Free the token encoders that a Python worker has kept from earlier tasks."""
    if kept := worker_cache(ENCODERS):
        kept.clear()
        pa.default_memory_pool().release_unused()


class Words:
    """Words of some texts: hash of each, and where those of each text begin.

    ``word_bytes`` says for each byte value whether it belongs to words. A to Z
    count as a to z.
    """

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        code = LOWER[raw]
        inside = word_bytes[code]
        edge = np.diff(inside.view(np.int8), prepend=0)
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.first = np.searchsorted(self.starts, self.text_starts)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_CODES[code] * powers(_BASE, len(code)))])
            self.hashes = mix((total[self.ends] - total[self.starts]) * powers(_BASE_INVERSE, len(code))[self.starts])

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.first[i] : self.first[i + 1]]

    @staticmethod
    def count(texts: list[bytes], word_bytes: np.ndarray) -> np.ndarray:
        """Number of words of each text, without their hashes."""
        inside = word_bytes[LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]]
        begins = np.cumsum(np.diff(inside.view(np.int8), prepend=0) == 1)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        return np.diff(begins[np.cumsum(lengths + 1) - 1], prepend=0)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - n + 1, np.uint64(n))
        for j, factor in enumerate(seeds(n, 13)):
            out += hashes[j : len(hashes) - n + 1 + j] * factor
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], text: int | str = "text", step: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``step`` bytes of text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + step, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def steps(batches: Iterator[pa.RecordBatch], text: int | str = "text", step: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about ``step`` bytes of text with their texts, nulls read as empty. The worker lets token encoders go."""
    let_go()
    for part in slices(batches, text, step):
        column = part.column(text)
        texts = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
        yield part, [t or b"" for t in texts]


def groups(batches, keys: list[str]):
    """Runs of rows with equal ``keys`` in sorted batches, each as one table of Arrow columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int = BATCH_BYTES):
    """Jobs started inside give Python at most ``rows`` rows and about ``size`` bytes at a time."""
    limits = {"maxRecordsPerBatch": str(rows), "maxBytesPerBatch": str(size)}
    names = {f"spark.sql.execution.arrow.{k}": v for k, v in limits.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and return it as read from there."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out.stored_bytes = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return out


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast when it has few rows, and few bytes where it is a stored table; else leave the join to Spark."""
    return df if getattr(df, "stored_bytes", 0) > BROADCAST_BYTES else few_rows(df, rows)


def renamed(df: DataFrame, keep: Sequence[str], taken: Sequence[str], *leading: Column) -> tuple[DataFrame, str, list[str]]:
    """``leading`` and the columns ``keep`` of ``df`` under names of its own; the kept ones' schema; and their names again.

    Names in ``taken``, those of an operator's results, can't be kept.
    """
    clash = sorted(set(taken).intersection(keep))
    if clash:
        raise ValueError(f"rename the kept columns {clash}: the result has columns of these names")
    out = df.select(*leading, *[F.col(f"`{c}`") for c in keep]).toDF(*[f"l{i}" for i in range(len(leading))], *[f"c{i}" for i in range(len(keep))])
    return out, "".join(f"{f.name} {f.dataType.simpleString()}, " for f in out.schema.fields[len(leading) :]), list(keep)


def held_out(modulus: int, rest: int) -> Column:
    """Whether the crc32 of ``doc_id`` as text leaves ``rest``; false without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == rest, F.lit(False))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a graph: (``id``, ``component_id``, the smallest id reachable).

    Ids without an edge are not in the result. Alternates large-star and
    small-star steps (Kiveris et al., 2014): each links neighbours to the
    smallest one seen, so trees flatten in a few rounds and no node ever
    gathers its neighbours. The links of every round are stored.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    state = None
    while True:
        e = stored(e, "components")
        seen = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            return (
                e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
                .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
            )
        state = tuple(seen)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(lowest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = turned.unionByName(lowest.withColumnRenamed("m", "v")).distinct()


__all__ = ["Words", "components", "grams", "mix", "powers", "read_table", "seeds", "small", "steps", "stored"]
