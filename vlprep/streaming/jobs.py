"""The batch transforms as Structured Streaming jobs."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vlprep.config import WORD_PATTERN
from vlprep.operators.batching import pad_batch
from vlprep.operators.filters import text_keys, without_keys
from vlprep.operators.ranking import exact_rank, row_count
from vlprep.operators.tokens import caption_tokens
from vlprep.session import cut
from vlprep.sources.tables import parse_run_log


def _start(writer, trigger: dict | None) -> StreamingQuery:
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_prepare(source: DataFrame, sink: str, checkpoint: str, text: str = "text", pattern: str = WORD_PATTERN,
                   trigger: dict | None = None) -> StreamingQuery:
    """Caption words and length filter on new files of a stream, appended to parquet."""
    out = caption_tokens(source, text, pattern)
    return _start(out.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint), trigger)


def stream_disjoint(source: DataFrame, used: DataFrame, sink: str, checkpoint: str, text: str = "text",
                    trigger: dict | None = None) -> StreamingQuery:
    """Rows of a stream whose text is not in a static corpus, whose keys are computed once at the start."""
    out = without_keys(source, cut(text_keys(used, text)), text)
    return _start(out.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint), trigger)


OWNER = "owner string"
LEDGER = "start bigint, rows bigint"


def batch_owner(spark: SparkSession, folder: str) -> str | None:
    """The checkpoint that a folder of batches belongs to; None if there is none yet."""
    try:
        held = spark.read.schema(OWNER).parquet(f"{folder}/owner").first()
    except AnalysisException:
        return None
    return held and held.owner


def _start_of(spark: SparkSession, epoch: int, folder: str, owner: str) -> int:
    """Rows before an epoch, from the ledger entry of the one before. The first epoch claims the folder."""
    held = batch_owner(spark, folder)
    if held is None and epoch == 0:
        spark.createDataFrame([(owner,)], OWNER).write.mode("errorifexists").parquet(f"{folder}/owner")
        held = owner
    if held != owner:
        raise ValueError(f"{folder!r} holds the batches of another checkpoint ({held}, not {owner}): give each its own folder")
    if epoch == 0:
        return 0
    try:
        before = spark.read.schema(LEDGER).parquet(f"{folder}/ledger/epoch={epoch - 1}").first()
    except AnalysisException as error:
        raise ValueError(f"the ledger of {folder!r} lacks epoch {epoch - 1}") from error
    return before.start + before.rows


def append_batches(spark: SparkSession, rows: DataFrame, epoch: int, order: str, size: int, folder: str, owner: str = "") -> None:
    """Number the rows of one micro-batch on from those before it, and write them.

    Rows go to a folder of the epoch, so a replayed epoch overwrites itself. The ledger holds where each
    epoch begins and how many rows it has; only the entry of the epoch before is read. A
    folder belongs to the checkpoint (``owner``) that wrote its first epoch; others are refused.
    """
    start = _start_of(spark, epoch, folder, owner)
    ranked = exact_rank(rows, order, "_place").withColumn("_place", F.col("_place") + start)
    here = f"{folder}/rows/epoch={epoch}"
    ranked.withColumns({"batch_id": F.expr(f"_place div {int(size)}"), "pos": F.col("_place") % size}).drop("_place").write.mode(
        "overwrite"
    ).parquet(here)
    # counted from what was written: the ledger always fits the rows
    entry = spark.createDataFrame([(start, row_count(spark.read.parquet(here)))], LEDGER)
    entry.write.mode("overwrite").parquet(f"{folder}/ledger/epoch={epoch}")


def stream_batches(source: DataFrame, folder: str, checkpoint: str, order: str, size: int, trigger: dict | None = None) -> StreamingQuery:
    """Batches of ``size`` rows over the whole stream; a batch may span micro-batches."""

    def step(rows: DataFrame, epoch: int) -> None:
        # the id of the stream, which its checkpoint keeps over restarts
        stream = json.loads(rows.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        rows.persist()
        try:
            append_batches(rows.sparkSession, rows, epoch, order, size, folder, stream)
        finally:
            rows.unpersist()

    return _start(source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint), trigger)


def complete_batches(spark: SparkSession, folder: str, size: int, ids: str | None = None) -> DataFrame:
    """Rows of all full batches so far; the rows of the open last one wait. With ``ids``, padded."""
    total = spark.read.schema(LEDGER).parquet(f"{folder}/ledger").agg(F.max(F.col("start") + F.col("rows"))).first()[0]
    rows = spark.read.parquet(f"{folder}/rows").filter(F.col("batch_id") < total // size)
    return pad_batch(rows, ids) if ids else rows


def run_log_metrics(lines: DataFrame, k: int) -> DataFrame:
    """Mean and latest loss per split and bucket of ``k`` steps; works on streams and tables.

    On a stream the state is one row per bucket. The log has no event time, so it
    is kept for the length of the run.
    """
    good = parse_run_log(lines).filter("ok")
    return good.groupBy("split", F.expr(f"step div {int(k)}").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.avg("loss").alias("mean_loss"),
        F.max("step").alias("last_step"),
        F.max_by("loss", "step").alias("last_loss"),
    )


def stream_run_log(spark: SparkSession, path: str, sink, checkpoint: str, k: int, trigger: dict | None = None) -> StreamingQuery:
    """Run-log metrics as lines arrive; ``sink(df, epoch)`` gets the changed buckets."""
    metrics = run_log_metrics(spark.readStream.text(path), k)
    return _start(metrics.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint), trigger)


def latest_validation(metrics: DataFrame) -> DataFrame:
    """The most recent validation loss of run-log metrics."""
    return metrics.filter(F.col("split") == "val").agg(
        F.max("last_step").alias("step"), F.max_by("last_loss", "last_step").alias("loss")
    )
