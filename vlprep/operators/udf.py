"""Hooks for user code: column functions, predicates and models.

Plain column expressions are preferred everywhere; functions on pandas batches
are for what columns cannot say. Operators chain with ``DataFrame.transform``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_columns(df: DataFrame, functions: dict[str, Column | Callable], types: dict[str, str] | None = None) -> DataFrame:
    """Map members by functions of their own, the others stay.

    A value is a column expression, a function from Column to Column, or, when
    ``types`` names its result type, a function on pandas series.
    """
    types = types or {}

    def expression(name, f):
        if isinstance(f, Column):
            return f
        if name in types:
            return F.pandas_udf(f, types[name])(F.col(name))
        return f(F.col(name))

    return df.withColumns({name: expression(name, f) for name, f in functions.items()})


def where_fn(df: DataFrame, predicate: Callable | Column, *columns: str) -> DataFrame:
    """Keep rows a predicate accepts: a column expression, or a function on pandas series."""
    if isinstance(predicate, Column):
        return df.filter(predicate)

    def test(*series: pd.Series) -> pd.Series:
        return predicate(*series)

    return df.filter(F.pandas_udf(test, "boolean")(*[F.col(c) for c in columns]))


def embed_table(df: DataFrame, loader: Callable[[], Callable], columns: list[str], keep: list[str], out: str = "embedding") -> DataFrame:
    """Vectors from a user's model.

    ``loader()`` runs once per Python worker and returns a function from a pandas
    frame of ``columns`` to one vector per row.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loader()
        for pdf in batches:
            done = pdf[keep].copy()
            done[out] = [list(map(float, v)) for v in model(pdf[columns])]
            yield done

    wanted = list(dict.fromkeys([*keep, *columns]))
    return df.select(*wanted).mapInPandas(score, f"{fields}, `{out}` array<float>")
