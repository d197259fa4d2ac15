"""Session defaults and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vlprep.config import BROADCAST_ROWS


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches; on a cluster, use the one you are given."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vlprep")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; on a local master, a fresh one where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="vlprep-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/vlprep-{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the cluster's default file system where it names none."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if re.match(r"^[a-z][a-z0-9+.-]*:", path) or default.startswith("file:"):
        return path
    return f"{default.rstrip('/')}/{path.lstrip('/')}"


@contextmanager
def arrow_bytes(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Jobs started inside give Python about ``size`` bytes of rows at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once, so that later passes reread it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Mark ``df`` for broadcast when it is small enough, else leave the join to Spark.

    ``rows`` is an upper bound known beforehand; without one, the rows are counted.
    """
    ok = rows <= BROADCAST_ROWS if rows is not None else fits(df)
    return F.broadcast(df) if ok else df
