"""Seeded shuffles at row, shard, buffer and batch level, and replay over epochs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.config import SHUFFLE_BUFFER
from vlprep.functions.keys import hash_key
from vlprep.operators.ranking import exact_rank, null_safe_join, rank_in_group, running_start
from vlprep.session import small


def with_key(df: DataFrame, row_id: str, seed, out: str = "shuffle_key") -> DataFrame:
    return df.withColumn(out, hash_key(seed, row_id))


def shuffle(df: DataFrame, row_id: str, seed) -> DataFrame:
    """All rows in a seeded random order (range-partitioned sort)."""
    return df.orderBy(hash_key(seed, row_id), F.col(row_id))


def shuffle_positions(df: DataFrame, row_id: str, seed, out: str = "pos") -> DataFrame:
    """The place of each row in :func:`shuffle`, without sorting the rows globally."""
    return exact_rank(with_key(df, row_id, seed, "_key"), "_key", out).drop("_key")


def shuffle_shards(df: DataFrame, shard: str, row_id: str, seed, out: str = "pos") -> DataFrame:
    """Positions after shuffling whole shards; rows keep their order in a shard.

    A shard of any size is spread over tasks by ranges of ``row_id``.
    """
    counts = df.groupBy(shard).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_key", hash_key(seed, shard))
    starts = running_start(counts, "_key", "_rows", "_first").select(shard, "_first")
    inside = rank_in_group(df, shard, row_id, "_inside")
    return (
        null_safe_join(inside, small(starts), [shard])
        .withColumn(out, (F.col("_first") + F.col("_inside")).cast("bigint"))
        .drop("_first", "_inside")
    )


def buffer_shuffle(df: DataFrame, position: str, row_id: str, seed, size: int = SHUFFLE_BUFFER, out: str = "pos") -> DataFrame:
    """Shuffle inside consecutive blocks of ``size`` positions.

    ``position`` is dense from zero, so a block has at most ``size`` rows.
    """
    from pyspark.sql import Window as W

    block = F.expr(f"`{position}` div {int(size)}")
    inside = F.row_number().over(W.partitionBy("_block").orderBy("_key"))
    return (
        df.withColumn("_block", block)
        .withColumn("_key", hash_key(seed, row_id))
        .withColumn(out, (F.col("_block") * size + inside - 1).cast("bigint"))
        .drop("_block", "_key")
    )


def shuffle_batches(df: DataFrame, batch: str, n_batches: int | None = None, seed=0, epoch: int = 0, out: str = "batch_pos") -> DataFrame:
    """New place of every batch for one epoch; the rows of a batch stay together.

    With the number of batches known, their ids need no pass over ``df``; a row of
    a batch beyond it fails.
    """
    if n_batches is None:
        ids = df.select(batch).distinct()
    else:
        ids = df.sparkSession.range(n_batches).select(F.col("id").alias(batch))
    order = exact_rank(ids.withColumn("_key", hash_key(seed, F.lit(epoch), batch)), "_key", out).drop("_key")
    fault = F.raise_error(F.concat(F.lit("no place for batch "), F.coalesce(F.col(batch).cast("string"), F.lit("null")))).cast("bigint")
    return df.join(order, batch, "left").withColumn(out, F.coalesce(out, fault))


def epochs(df: DataFrame, row_id: str, n: int, seed) -> DataFrame:
    """Repeat the rows for ``n`` epochs, each with keys of its own for a new order."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))).withColumn(
        "epoch_key", hash_key(seed, "epoch", row_id)
    )
