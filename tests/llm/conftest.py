import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import vlprep  # noqa: E402

cloudpickle.register_pickle_by_value(vlprep)

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs_of(spark):
    """A documents table from rows of (doc_id, text[, lang[, source]])."""

    def make(rows, partitions=3):
        full = [(*r, *([None] * (4 - len(r))), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make
