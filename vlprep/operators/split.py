"""Splits, rank assignment and resampling by seeded keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.config import BROADCAST_ROWS, TEST_DIVISOR, VALIDATION_ROWS
from vlprep.functions.keys import hash_key, key_choice, key_number
from vlprep.operators.ranking import exact_rank, name_index, nth_smallest, null_safe_join, row_count
from vlprep.session import cut, small

_PPM = 1_000_000


def positional_split(df: DataFrame, row_id: str, val: int = VALIDATION_ROWS, test_div: int = TEST_DIVISOR, seed=0) -> DataFrame:
    """Add ``split``: the first ``val`` rows by id, then a seeded shuffle of the rest cut 1 : ``test_div``-1.

    Of the ``m`` shuffled rows the first ``m div test_div`` are ``test``. Ids are
    ranked alone and the rows move once; ``cut`` a ``df`` that is costly to compute.
    """
    ranked = exact_rank(df.select(row_id), row_id, "_place").withColumn("_key", hash_key(seed, row_id))
    rest = F.col("_place") >= val
    shuffled = exact_rank(ranked, "_key", "_order", dear=True, total="_m", only=rest)
    split = F.when(~rest, "val").when(F.col("_order") < F.expr(f"_m div {int(test_div)}"), "test").otherwise("train")
    return df.join(shuffled.select(row_id, split.alias("split")), row_id)


def _halves(df: DataFrame, order: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` rows by a unique ``order``, and the others.

    Both are filters by the ``n``-th value, which counts alone give. Rows without an order come first, in no set order.
    """
    missing = F.col(order).isNull()
    n_missing = row_count(df.filter(missing))
    if n < n_missing:
        placed = exact_rank(df.filter(missing), order, "_place")
        head, rest = placed.filter(F.col("_place") < n).drop("_place"), placed.filter(F.col("_place") >= n).drop("_place")
        return head, df.filter(~missing).unionByName(rest)
    if n == n_missing:
        return df.filter(missing), df.filter(~missing)
    last = nth_smallest(df, order, n - n_missing)
    if last is None:
        return df, df.limit(0)
    return df.filter(missing | (F.col(order) <= last)), df.filter(F.col(order) > last)


def head_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order``."""
    return _halves(df, order, n)[0]


def tail_from(df: DataFrame, order: str, n: int) -> DataFrame:
    """The rows after the first ``n`` by ``order``."""
    return _halves(df, order, n)[1]


def split_shards(df: DataFrame, shard: str, val_fraction: float, seed=0) -> DataFrame:
    """Add ``split`` by shard: a shard is wholly ``train`` or wholly ``val``. No shuffle."""
    limit = int(round(val_fraction * _PPM))
    draw = key_number(hash_key(seed, shard)) % _PPM
    return df.withColumn("split", F.when(draw < limit, "val").otherwise("train"))


def shard_table(df: DataFrame, shard: str, out: str = "shard_idx") -> DataFrame:
    """Distinct shards numbered in name order; they are written once, so that later uses don't read ``df`` again."""
    return name_index(cut(df.select(shard).distinct()), shard, out)


def assign_ranks(df: DataFrame, shard: str, world: int, workers: int = 1) -> DataFrame:
    """Add ``shard_idx``, ``rank`` and ``worker``: shards go round the ranks, then round their workers."""
    table = shard_table(df, shard)
    return null_safe_join(df, small(table), [shard]).withColumns(
        {
            "rank": F.col("shard_idx") % world,
            "worker": F.expr(f"(shard_idx div {int(world)})") % workers,
        }
    )


def shard_draws(shards: DataFrame, n_shards: int, n_draws: int, seed=0) -> DataFrame:
    """``n_draws`` shards drawn with replacement: columns ``draw`` and ``shard_idx``."""
    draws = shards.sparkSession.range(n_draws).withColumnRenamed("id", "draw")
    return draws.withColumn("shard_idx", key_choice(hash_key(seed, "draw"), n_shards))


def resample_shards(df: DataFrame, shard: str, n_draws: int, seed=0) -> DataFrame:
    """Samples of ``n_draws`` shards drawn with replacement, with the draw they came by.

    The draws of a shard are gathered first, so each sample is matched once and
    then repeated. Up to ``BROADCAST_ROWS`` draws the samples are not shuffled.
    """
    table = shard_table(df, shard)
    n = table.count()
    if n == 0:
        return df.withColumn("draw", F.lit(None).cast("bigint"))
    # blocks of draws keep the lists short, however many draws there are
    lists = (
        shard_draws(table, n, n_draws, seed)
        .groupBy("shard_idx", F.expr(f"draw div {BROADCAST_ROWS}").alias("_block"))
        .agg(F.collect_list("draw").alias("_draws"))
    )
    wanted = lists.join(small(table, n), "shard_idx").select(shard, "_draws")
    return null_safe_join(df, small(wanted, n_draws), [shard]).withColumn("draw", F.explode("_draws")).drop("_draws")
