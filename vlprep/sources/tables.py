"""Readers and writers of tables, documents, image folders and run logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vlprep.config import SplitPaths
from vlprep.operators.ranking import name_index
from vlprep.session import small

MESSAGE = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
CONVERSATION = T.StructType([T.StructField("topic", T.StringType()), T.StructField("content", T.ArrayType(MESSAGE))])
DIALOGUE = T.StructType(
    [T.StructField("image_id", T.LongType()), T.StructField("conversations", T.ArrayType(CONVERSATION))]
)
_FIRST_KEY = '"image_id"'


def read_metadata(spark: SparkSession, path: str, url_col: str | Column = "URL", caption_col: str | Column = "TEXT",
                  keep: list[str] | None = None) -> DataFrame:
    """Caption metadata as ``image_url``, ``caption`` and the columns to carry along."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return spark.read.parquet(path).select(
        *(keep or []), column(url_col).alias("image_url"), column(caption_col).alias("caption")
    )


def list_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """Shard files of a pattern: ``shard``, ``bytes``, and ``shard_idx`` in path order. File contents are not read."""
    try:
        files = spark.read.format("binaryFile").load(pattern)
    except AnalysisException as error:
        raise ValueError(f"no shards match {pattern!r}") from error
    table = files.select(F.col("path").alias("shard"), F.col("length").alias("bytes"))
    if table.isEmpty():
        raise ValueError(f"no shards match {pattern!r}")
    return name_index(table, "shard", "shard_idx")


def read_dialogues(spark: SparkSession, path: str, layout: str = "split") -> DataFrame:
    """Nested dialogue documents.

    ``split``: files holding one JSON array each, read by many tasks, cut where a
    document starts; every document must begin with its ``image_id``, followed by
    ``conversations``. ``array``: the same files without that condition, one task
    per file. ``lines``: one document per line. What does not parse, or breaks
    the condition, ends the job; nothing is left out.
    """
    if layout == "lines":
        return spark.read.schema(DIALOGUE).option("mode", "FAILFAST").json(path)
    if layout == "array":
        return spark.read.schema(DIALOGUE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if layout != "split":
        raise ValueError(f"layout must be 'split', 'array' or 'lines', got {layout!r}")
    piece = F.col("value")
    starts = piece.rlike(r'^\s*:\s*-?\d+\s*,\s*"conversations"\s*:')
    before_first = piece.rlike(r"^\s*(\[\s*)?\{?\s*$")
    failure = F.raise_error(F.concat(F.lit("not a document, read with layout='array': "), F.substring(piece, 1, 80)))
    pieces = spark.read.option("lineSep", _FIRST_KEY).text(path).filter(
        F.when(starts, True).when(before_first, False).otherwise(failure.cast("boolean"))
    )
    # what stands between two documents: closing brace, comma or bracket, opening brace
    between = r"\}\s*(,\s*\{|\])?\s*$"
    whole = F.when(piece.rlike(between), F.regexp_replace(piece, between, "}")).otherwise(failure.cast("string"))
    return pieces.select(
        F.from_json(F.concat(F.lit("{" + _FIRST_KEY), whole), DIALOGUE, {"mode": "FAILFAST"}).alias("d")
    ).select("d.*")


def write_dialogue_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    """Documents one per line, which every later read can split."""
    df.select("image_id", "conversations").write.mode(mode).json(path)


def write_dialogue_arrays(df: DataFrame, path: str, mode: str = "error") -> None:
    """Documents in files that hold one JSON array each, ``image_id`` first; every task writes a file of its own."""
    document = F.to_json(F.struct(F.col("image_id").cast("bigint").alias("image_id"), F.col("conversations")), {"ignoreNullFields": "false"})

    def bracketed(batches):
        lead = "["
        for batch in batches:
            lines = [f"{',' if i or lead == ',' else '['}{line}" for i, line in enumerate(batch.column(0).to_pylist())]
            if lines:
                lead = ","
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"], pa.string())], ["value"])

    df.select(document.alias("value")).mapInArrow(bracketed, "value string").write.mode(mode).text(path)


def read_images(spark: SparkSession, path: str, on_error: str = "skip") -> DataFrame:
    """Images of a folder with ``image_id`` from the file name; unreadable files are skipped, or kept with width -1."""
    if on_error not in ("skip", "keep"):
        raise ValueError(f"on_error must be 'skip' or 'keep', got {on_error!r}")
    images = spark.read.format("image").option("dropInvalid", on_error == "skip").load(path)
    name = F.regexp_extract(F.col("image.origin"), r"([^/]+)\.\w+$", 1)
    return images.select(name.alias("image_id"), "image")


def existing_images(spark: SparkSession, path: str, extension: str = "jpg") -> DataFrame:
    """Ids of the image files in a folder, from their names alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("image_id"))


def parse_run_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Add ``step``, ``split`` and ``loss`` to log lines, and ``ok``: whether the line is well-formed."""
    part = F.split(F.col(value), " ")
    parsed = lines.withColumns(
        {
            "step": F.get(part, F.lit(0)).try_cast("bigint"),
            "split": F.get(part, F.lit(1)),
            "loss": F.get(part, F.lit(2)).try_cast("double"),
        }
    )
    ok = F.col("step").isNotNull() & F.col("split").isin("train", "val") & F.col("loss").isNotNull() & (F.size(part) == 3)
    return parsed.withColumn("ok", F.coalesce(ok, F.lit(False)))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_log(spark.read.text(path)).filter("ok").select("step", "split", "loss")


def run_log_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a run log that do not parse."""
    return parse_run_log(spark.read.text(path)).filter("NOT ok").select("value")


def format_run_log(df: DataFrame) -> DataFrame:
    return df.select(F.format_string("%d %s %.6f", F.col("step"), F.col("split"), F.col("loss")).alias("value"))


def write_run_log(df: DataFrame, path: str) -> None:
    """Append lines ``step split loss``."""
    format_run_log(df).write.mode("append").text(path)


def read_labelled(spark: SparkSession, vectors: str, classes: str | None = None, label: str = "label",
                  class_key: str = "label", class_name: str = "class_name") -> DataFrame:
    """A labelled evaluation set, with ``class_name`` when a class table is given."""
    rows = spark.read.parquet(vectors)
    if classes is None:
        return rows
    names = spark.read.parquet(classes).select(F.col(class_key).alias(label), F.col(class_name).alias("class_name"))
    return rows.join(small(names), label, "left")


def read_split(spark: SparkSession, paths: SplitPaths, split: str, format: str = "tarshards", **options) -> DataFrame:
    """The shards of one split of a corpus."""
    return spark.read.format(format).options(**options).load(paths.path(split))


def write_batches(df: DataFrame, path: str, mode: str = "error") -> None:
    """Prepared batches as parquet by split and rank; a batch lies in one file, in order."""
    order = ["split", "rank", "batch_id"]
    (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order, "pos")
        .write.mode(mode)
        .partitionBy("split", "rank")
        .parquet(path)
    )
