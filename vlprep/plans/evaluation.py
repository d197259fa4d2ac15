"""Evaluation of embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vlprep.operators.metrics import accuracy
from vlprep.operators.similarity import class_vectors, zero_shot


def zero_shot_report(vectors: DataFrame, classes: DataFrame | None = None, vector: str = "embedding", label: str = "label") -> DataFrame:
    """Correct, total and accuracy of zero-shot classification; class vectors default to the mean per label."""
    table = classes if classes is not None else class_vectors(vectors, vector, label)
    return accuracy(zero_shot(vectors, table, vector, label=label), "predicted", label)
