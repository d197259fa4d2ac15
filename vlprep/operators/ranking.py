"""Exact positions of rows in a global order, without sorting in one task.

Rows are put into buckets that follow the order. The buckets are counted, the
counts are summed up to start positions, and each row gets the start of its
bucket plus its place in it. Only the table of buckets meets in one task, and
its size is bounded by the number of buckets, not by the data.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vlprep.config import BROADCAST_ROWS
from vlprep.functions.keys import key_number

HASH_DIGITS = 4
HASH_BUCKETS = 16**HASH_DIGITS
INT_BUCKETS = 4096
ROWS_PER_BUCKET = 250_000
#: Values drawn to set the limits of ranges.
SAMPLE_ROWS = 1 << 17
#: Groups in which counts of tasks are added up before they reach the driver.
COUNT_GROUPS = 64
#: A range with so many values is sorted on the driver.
FEW_ROWS = 10_000

_BEFORE = (W.unboundedPreceding, -1)


#: Bucket of rows whose order is null; it comes before all others.
NULL_BUCKET = -1


def _hash_bucket(key: str) -> Column:
    text = F.col(key)
    fault = F.raise_error(F.concat(F.lit(f"{key} is not a lower-case hex key: "), text)).cast("int")
    bucket = F.when(text.rlike(f"^[0-9a-f]{{{HASH_DIGITS},}}$"), key_number(text, HASH_DIGITS).cast("int")).otherwise(fault)
    # never null, so that no plan adds a null check to one of two uses of it
    return F.coalesce(F.when(text.isNotNull(), bucket), F.lit(NULL_BUCKET))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys are kept once."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_same_{k}" for k in keys])


def int_buckets(df: DataFrame, order: str, n_buckets: int = INT_BUCKETS, rows_per_bucket: int = ROWS_PER_BUCKET):
    """Function adding column ``_bucket``: about equally full ranges of a whole number.

    The limits come from about ``SAMPLE_ROWS`` values. They only set the
    balance; whatever they are, positions derived from them are exact. Ranges
    over ``rows_per_bucket`` rows are cut evenly, up to 65,536 ranges in all.
    """
    values = df.select(F.col(order).cast("bigint").alias("v")).filter("v IS NOT NULL")
    n = row_count(values)
    drawn = values.sample(SAMPLE_ROWS / n, seed=0) if n > SAMPLE_ROWS else values
    drawn = np.sort(drawn.toArrow().column("v").to_numpy()).astype(float)  # at most about SAMPLE_ROWS values
    limits = np.unique(drawn[np.linspace(0, len(drawn) - 1, n_buckets + 1).astype(int)]) if len(drawn) else drawn
    parts = min(HASH_BUCKETS // n_buckets, -(-n // (n_buckets * rows_per_bucket)))
    if parts > 1 and len(limits) > 1:
        limits = np.unique(np.interp(np.arange((len(limits) - 1) * parts + 1) / parts, np.arange(len(limits)), limits))
    splits = [-float("inf"), *limits.tolist()[1:-1], float("inf")]
    if len(splits) < 3:
        return lambda d: d.withColumn("_bucket", F.when(F.col(order).isNull(), NULL_BUCKET).otherwise(0))
    cutter = Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket")

    def add(d: DataFrame) -> DataFrame:
        out = cutter.transform(d.withColumn("_order", F.col(order).cast("double")))
        return out.withColumn("_bucket", F.coalesce(F.col("_bucket").cast("int"), F.lit(NULL_BUCKET))).drop("_order")

    return add


def order_buckets(df: DataFrame, order: str):
    """Function adding ``_bucket``, never null, which follows the order of a hash key or whole number."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.StringType):
        return lambda d: d.withColumn("_bucket", _hash_bucket(order))
    if isinstance(kind, T.IntegralType):
        return int_buckets(df, order)
    raise ValueError(f"order column {order!r} must be a hash key or a whole number, is {kind.simpleString()}")


def row_count(df: DataFrame) -> int:
    """Number of rows; the counts of the tasks are added up in a few tasks, not in one."""
    group = F.pmod(F.spark_partition_id(), F.lit(COUNT_GROUPS))
    return sum(r["count"] for r in df.groupBy(group.alias("_group")).count().collect())  # at most COUNT_GROUPS rows


def _extent(df: DataFrame, order: str) -> tuple[int, object, object]:
    """Rows without ``order``, its smallest and its largest value."""
    group = F.pmod(F.spark_partition_id(), F.lit(COUNT_GROUPS))
    value = F.col(order)
    found = df.groupBy(group.alias("_group")).agg(F.count_if(value.isNull()), F.min(value), F.max(value)).collect()  # at most COUNT_GROUPS rows
    low, high = [r[2] for r in found if r[2] is not None], [r[3] for r in found if r[3] is not None]
    return sum(r[1] for r in found), min(low, default=None), max(high, default=None)


def _nth_range(counts: list[tuple], n: int) -> tuple[object, int, int]:
    """The range that holds the ``n``-th value, the values before it, the values in it; ``counts`` are (range, values)."""
    before = 0
    for part, count in sorted(counts):
        if before + count >= n:
            return part, before, count
        before += count
    return None, before, 0


def nth_smallest(df: DataFrame, order: str, n: int):
    """The ``n``-th smallest value, from 1, of a whole number or a hash key; None if there are fewer.

    Values are counted in at most 65,536 ranges, then the range that holds the
    ``n``-th in ranges of its own, until it has few values. No row is shuffled, only counts are.
    """
    value = F.col(order)
    values = df.select(value).filter(value.isNotNull())
    text = isinstance(df.schema[order].dataType, T.StringType)
    prefix, inside = "", values
    if not text:
        _, low, high = _extent(values, order)
        if low is None:
            return None
    while True:
        if text:
            digits = F.substring(value, len(prefix) + 1, HASH_DIGITS)
            counted = inside.groupBy(F.when(_hash_bucket(order) >= 0, digits).alias("_range"))
        else:
            width = (high - low) // HASH_BUCKETS + 1
            kind = "decimal(38,0)" if high - low >= 1 << 62 else "bigint"
            counted = inside.select(F.expr(f"(CAST(`{order}` AS {kind}) - CAST({low} AS {kind})) div CAST({width} AS {kind})").alias("_range")).groupBy("_range")
        part, before, count = _nth_range([tuple(r) for r in counted.count().collect()], n)  # at most HASH_BUCKETS ranges
        if part is None:
            return None
        n -= before
        if text:
            prefix += part
            inside = values.filter(value.startswith(prefix))
            done = len(part) < HASH_DIGITS
            last = prefix
        else:
            low, high = low + part * width, min(high, low + (part + 1) * width - 1)
            inside = values.filter((value >= low) & (value <= high))
            done = low == high
            last = low
        if done:
            return last
        if count <= FEW_ROWS:
            return sorted(r[0] for r in inside.collect())[n - 1]  # at most FEW_ROWS values


def _starts(counted: DataFrame) -> DataFrame:
    """Start position of each ``_bucket``, and the total. One row per bucket meets here: 65,536 at most."""
    before = F.sum("_n").over(W.orderBy("_bucket").rowsBetween(*_BEFORE))
    total = F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return counted.select("_bucket", F.coalesce(before, F.lit(0)).alias("_start"), total.alias("_total"))


def exact_rank(df: DataFrame, order: str, out: str = "pos", dear: bool = False, like: DataFrame | None = None,
               total: str | None = None, only: Column | None = None) -> DataFrame:
    """Add the zero-based position of each row in the order of ``order``.

    ``order`` is unique: a hex key of :func:`hash_key`, or a whole number; any other
    text fails. Rows without an order come first, at any size, in no set order. The
    bucket counts read ``order`` in a pass of their own, which is cheap for
    stored columns. Set ``dear`` when ``df`` is costly to compute: then the
    counts come from the shuffled rows, and ``df`` is computed once. ``like`` is
    a stored table whose ``order`` column is spread alike; whole-number ranges
    are then taken from it. ``total`` names a column for the number of rows.
    """
    bucketed = order_buckets(like if like is not None else df, order)(df)
    one = F.lit(1) if only is None else only.cast("int")
    if dear:
        bucketed = bucketed.repartition("_bucket")
        # Buckets and places are never below these limits, so the hash is never computed. Naming
        # every column here and below keeps both uses of the shuffle the same, and
        # Spark then runs it once.
        one = F.when(F.col("_bucket") >= NULL_BUCKET, one).otherwise(F.xxhash64(*df.columns))
    counted = bucketed.groupBy("_bucket").agg(F.sum(one).alias("_n"))
    inside = W.partitionBy("_bucket").orderBy(order)
    if only is None:
        here = F.row_number().over(inside)
    else:
        here = F.sum(only.cast("int")).over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = bucketed.join(F.broadcast(_starts(counted)), "_bucket").withColumn(
        out, (F.col("_start") + here - 1).cast("bigint")
    )
    if dear:
        placed = placed.filter((F.col(out) >= -1) | (F.xxhash64(*df.columns) == 0))
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_bucket", "_start", "_total")


def rank_in_group(df: DataFrame, group: str, order: str, out: str = "pos", width: int | None = None) -> DataFrame:
    """Add the zero-based position of each row in its group, in order of ``order``.

    ``order`` is a whole number, unique in its group; rows without one come first.
    Rows without a group are a group. A group of any size is
    spread over many tasks: the unit of work is a (group, range of order). With
    ``width`` the ranges are ``order div width`` wide, for dense orders such as
    turn numbers; without it they are about equally full.
    """
    if width is not None:
        bucketed = df.withColumn("_bucket", F.expr(f"`{order}` div {int(width)}"))  # null orders are a range of their own
    else:
        bucketed = int_buckets(df, order)(df)
    starts = (
        bucketed.groupBy(group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            group,
            "_bucket",
            F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_bucket").rowsBetween(*_BEFORE)), F.lit(0)).alias("_start"),
        )
    )
    here = F.row_number().over(W.partitionBy(group, "_bucket").orderBy(order))
    return (
        null_safe_join(bucketed.withColumn("_here", here), starts, [group, "_bucket"])
        .withColumn(out, (F.col("_start") + F.col("_here") - 1).cast("bigint"))
        .drop("_bucket", "_start", "_here")
    )


def running_start(table: DataFrame, key: str, weight: str, out: str = "start") -> DataFrame:
    """Add the sum of ``weight`` over all rows whose hash key sorts before this one's.

    Works on tables of any size, in two steps: over buckets, then in each bucket.
    """
    bucketed = table.withColumn("_bucket", _hash_bucket(key))
    totals = bucketed.groupBy("_bucket").agg(F.sum(weight).alias("_n"))
    here = F.coalesce(F.sum(weight).over(W.partitionBy("_bucket").orderBy(key).rowsBetween(*_BEFORE)), F.lit(0))
    return (
        bucketed.join(F.broadcast(_starts(totals)), "_bucket")
        .withColumn(out, (F.col("_start") + here).cast("bigint"))
        .drop("_bucket", "_start", "_total")
    )


def name_index(names: DataFrame, by: str | list, out: str, rows: int | None = None) -> DataFrame:
    """Number the rows of a table of distinct names in name order, from zero.

    ``by`` is a column, or a list of them. Up to ``BROADCAST_ROWS`` names are sorted
    together. Beyond that they are range-partitioned and written once, and the partitions are counted. ``rows``
    is an upper bound known beforehand; without one, the rows are counted.
    """
    from vlprep.session import cut, fits

    by = by if isinstance(by, list) else [by]
    if rows <= BROADCAST_ROWS if rows is not None else fits(names):
        return names.withColumn(out, (F.row_number().over(W.orderBy(*by)) - 1).cast("bigint"))
    ranged = cut(names.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_bucket", F.spark_partition_id()))
    here = F.row_number().over(W.partitionBy("_bucket").orderBy(*by))
    # Spark chooses the number of range partitions: as many as shuffle partitions
    starts = _starts(ranged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")))
    return (
        ranged.join(F.broadcast(starts), "_bucket")
        .withColumn(out, (F.col("_start") + here - 1).cast("bigint"))
        .drop("_bucket", "_start", "_total")
    )


def take_per_group(df: DataFrame, by: str | list[str], order, k: int) -> DataFrame:
    """First ``k`` rows of each group; each task keeps at most ``k`` per group before the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    order = order if isinstance(order, list) else [order]
    return (
        df.withColumn("_row", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
        .filter(F.col("_row") <= k)
        .drop("_row")
    )


def argmax_by(df: DataFrame, key: str | list[str], score: str, index: str, out: str = "best") -> DataFrame:
    """``index`` of the highest ``score`` per key, the lowest index on ties."""
    key = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*key).agg(F.max_by(index, F.struct(F.col(score), -F.col(index))).alias(out))
