"""From raw documents to token files: five stages, each a DataFrame to a DataFrame.

``run`` applies them to ``documents``, and writes the result of each as Parquet, which
the next one reads. Every stage but the last returns the columns of its input.
The first and third start the jobs that judge texts in Python themselves, some MB at a
time, and return what is left without the ids and texts found.
Stages take null, empty, repeated and additional values as the operators do;
columns beyond ``doc_id``, ``text``, ``lang`` and ``source`` are carried along whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import vlprep
from vlprep.llm import decontam, langid, mixing, neardup, tokenfile
from vlprep.llm.common import arrow_batches, read_table, small, stored
from vlprep.llm.queries import tokenizer_path
from vlprep.session import run_dir

# Python workers get the package's functions with the tasks; nothing to install on executors.
cloudpickle.register_pickle_by_value(vlprep)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
NEEDED = ("doc_id", "text", "lang", "source")
#: Most rows that Python gets at a time.
ROWS = 10_000


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with names of its own for the columns that no operator needs."""
    return docs.toDF(*[c if c in NEEDED else f"carried_{i}" for i, c in enumerate(docs.columns)])


def _hashed(plain: DataFrame) -> DataFrame:
    return plain.withColumn("text_hash", F.xxhash64(F.col("text").cast("string")))


def _without(hashed: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Rows of ``hashed`` whose id and text are not those of a row of ``found``, which is stored."""
    gone = stored(found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct(), name)
    return hashed.join(small(gone), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no text, no letter, or a guess that is more likely wrong than right.

    Learns from rows whose crc32(doc_id) mod 4 is not 2, as the registered query does.
    """
    plain = _plain(docs)
    hashed = _hashed(plain)
    with arrow_batches(spark, ROWS):
        model = langid.train(plain.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
        kept = _without(hashed, langid.identify(hashed, model, ["doc_id", "text_hash"]).filter("rejected"), "rejected")
    return kept.select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays; of repeated rows, one.

    Rows are told apart by id and text, so an id on rows of different texts loses only those that have a group elsewhere.
    """
    plain = _plain(docs)
    found = stored(neardup.near_duplicates(plain), "duplicates")
    row = ["doc_id", "text_hash"]
    # texts of one group under its smallest id: the first by hash stays
    first = found.filter("kept and group_id is not null").groupBy("doc_id", "group_id").agg(F.min("text_hash").alias("_first"), F.max("text_hash").alias("_last")).filter("_first != _last")
    extra = found.join(small(stored(first.select("doc_id", "group_id", "_first"), "same-ids")), ["doc_id", "group_id"]).filter("text_hash != _first")
    gone = stored(found.filter("not kept").select(*row).unionByName(extra.select(*row)).distinct(), "gone")
    hashed = _hashed(plain)
    kept = hashed.join(small(gone), row, "left_anti").select(*hashed.columns)
    again = stored(found.filter("kept and doc_id is not null").groupBy(*row).count().filter(F.col("count") > 1).select(*row), "repeated")
    once = kept.join(small(again), row, "left_anti").select(*plain.columns)
    repeated = kept.join(small(again), row, "left_semi").select(*plain.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words in benchmark passages go."""
    plain = _plain(docs)
    hashed = _hashed(plain)
    with arrow_batches(spark, ROWS):
        found = decontam.decontaminate(hashed, read_table(spark, sf_dir, "benchmark"), keep=["text_hash"])
        kept = _without(hashed, found.filter(decontam.contaminated()), "contaminated")
    return kept.select(*plain.columns).toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources come at weights of the square roots of their sizes.

    Files and rows in them are in that order, which the next stage keeps.
    """
    plain = _plain(docs)
    return mixing.mix_sources(plain).orderBy("position").select(*plain.columns).toDF(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents in their stored order, read back: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    The stored order is that of the numbers of the part files and of the rows in them; each file is encoded where it
    lies. A table that was not read from part files, or from several with one number, has none; its documents go by ``doc_id``.
    """
    try:
        part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)
        marked = docs.select("doc_id", "text", F.when(part != "", part.cast("long")).alias("_part"), F.col("_metadata.row_index").alias("_row"))
        files = docs.select(F.col("_metadata.file_path").alias("_file"), F.when(part != "", part.cast("long")).alias("_part")).distinct()
        placed = files.agg(F.count(F.lit(1)) == F.count_distinct("_part")).first()[0]
    except AnalysisException:
        placed = False
    return tokenfile.token_index(marked if placed else docs.select("doc_id", "text"), tokenizer_path(), placed=placed)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("write_tokens", write_tokens),
]

#: The classifier of the first stage can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = run_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
