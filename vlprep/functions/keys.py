"""Seeded keys: the same row gets the same key whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, *cols) -> Column:
    """``md5("seed:a:b")`` as hex text; sorting by it is a seeded shuffle."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def key_number(key: Column, digits: int = 8) -> Column:
    """The leading hex digits of a key as a whole number."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def key_uniform(key: Column) -> Column:
    """A key as a number in [0, 1)."""
    return key_number(key) / F.lit(float(1 << 32))


def key_choice(key: Column, n: int) -> Column:
    """A key as a whole number in [0, n)."""
    return F.pmod(key_number(key), F.lit(n).cast("bigint"))


def digest(values: Column) -> Column:
    """Fingerprint of an array, for comparing arrays as text."""
    return F.md5(F.array_join(F.transform(values, lambda v: v.cast("string")), ","))
