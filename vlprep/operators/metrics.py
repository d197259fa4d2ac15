"""Loss, accuracy and size reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.functions import arrays
from vlprep.operators.ranking import take_per_group


def accuracy(df: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    hit = (F.col(predicted) == F.col(label)).cast("bigint")
    return df.agg(
        F.coalesce(F.sum(hit), F.lit(0)).alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.avg(hit.cast("double")).alias("accuracy"),
    )


def mean_loss(df: DataFrame, by: str, order: str, loss: str, k: int) -> DataFrame:
    """Mean loss of the first ``k`` batches of each validation event."""
    return take_per_group(df, by, order, k).groupBy(by).agg(
        F.count(F.lit(1)).alias("n_batches"), F.avg(loss).alias("mean_loss")
    )


def accumulate_loss(df: DataFrame, micro_step: str, loss: str, accum: int) -> DataFrame:
    """Loss per step: the sum of ``loss / accum`` over the micro steps it is made of."""
    return (
        df.withColumn("step", F.expr(f"`{micro_step}` div {int(accum)}"))
        .groupBy("step")
        .agg(F.count(F.lit(1)).alias("n_micro"), F.sum(F.col(loss) / F.lit(accum)).alias("loss"))
    )


def rank_mean(df: DataFrame, step: str, rank: str, loss: str) -> DataFrame:
    """Mean over ranks of each rank's summed loss per step."""
    per_rank = df.groupBy(step, rank).agg(F.sum(loss).alias("_loss"))
    return per_rank.groupBy(step).agg(F.count(F.lit(1)).alias("n_ranks"), F.avg("_loss").alias("loss"))


def every_k(df: DataFrame, step: str, k: int, last: bool = True) -> DataFrame:
    """Rows of every ``k``-th step, and of the last one."""
    wanted = F.col(step) % k == 0
    if last:
        wanted = wanted | (F.col(step) == df.agg(F.max(step)).scalar())
    return df.filter(wanted)


def masked_mean(df: DataFrame, losses: str, labels: str, by: str | None = None) -> DataFrame:
    """Mean token loss over positions that are not ignored. Arrays are folded in place, not exploded."""
    part = df.withColumns(
        {"_sum": arrays.masked_sum(F.col(losses), F.col(labels)), "_n": arrays.kept_count(F.col(labels))}
    )
    grouped = part.groupBy(by) if by else part.groupBy()
    return grouped.agg(
        F.sum("_n").cast("bigint").alias("n_tokens"),
        (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("loss"),
    )


def step_budget(df: DataFrame, by: str, batch_size: int, accum: int, epochs: int) -> DataFrame:
    """Batches and optimiser steps that the rows of each group allow."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows")).select(
        by,
        "n_rows",
        F.expr(f"n_rows div {int(batch_size)}").alias("n_batches"),
        F.expr(f"(n_rows div {int(batch_size * accum)}) * {int(epochs)}").alias("n_steps"),
    )


def dataset_report(df: DataFrame, shard: str, length: str) -> DataFrame:
    return df.groupBy(shard).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(length).cast("bigint").alias("total_len"),
        F.min(length).cast("bigint").alias("min_len"),
        F.max(length).cast("bigint").alias("max_len"),
    )
