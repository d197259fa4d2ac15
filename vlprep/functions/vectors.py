"""Expressions on embedding arrays. Arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vlprep.config import SCALER_MAX, TEMPERATURE_INIT
from vlprep.functions.keys import hash_key, key_uniform


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, not once per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """Unit vector; the zero vector stays zero."""
    return let(F.greatest(norm(v), F.lit(eps)), lambda n: F.transform(as_double(v), lambda x: x / n))


def scaler(temperature: Column | float = TEMPERATURE_INIT, limit: float = SCALER_MAX) -> Column:
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return F.least(F.exp(t), F.lit(limit))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    z = F.transform(as_double(logits), lambda x: x / F.lit(float(temperature)))
    weights = let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    return let(
        weights,
        lambda w: let(
            F.aggregate(w, F.lit(0.0), lambda s, x: s + x),
            lambda total: F.transform(w, lambda x: x / total),
        ),
    )


def argmax(values: Column) -> Column:
    """Zero-based place of the largest value, the lowest one on ties."""
    return F.array_position(values, F.array_max(values)) - 1


def draw(probabilities: Column, u: Column) -> Column:
    """Zero-based place drawn by inverse distribution at ``u`` in [0, 1)."""
    end = F.aggregate(
        probabilities,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda acc, p: F.struct(
            (acc["sum"] + p).alias("sum"),
            (acc["n"] + F.when(acc["sum"] + p <= u, 1).otherwise(0)).alias("n"),
        ),
    )
    return F.least(end["n"], F.size(probabilities) - 1).cast("bigint")


def select_token(logits: Column, temperature: float, row_id, seed=0) -> Column:
    """Next token: the best one at temperature 0, else a seeded draw."""
    if temperature == 0:
        return argmax(logits)
    return draw(softmax(logits, temperature), key_uniform(hash_key(seed, row_id)))


def pool(tokens: Column, how: str, length: Column | None = None) -> Column:
    """``first`` vector, ``last`` valid vector, or all but the first (``rest``)."""
    if how == "first":
        return F.get(tokens, F.lit(0))
    if how == "last":
        n = length if length is not None else F.size(tokens)
        return F.get(tokens, n.cast("int") - 1)
    if how == "rest":
        return F.slice(tokens, F.lit(2), F.size(tokens))
    raise ValueError(f"pool must be 'first', 'last' or 'rest', got {how!r}")
