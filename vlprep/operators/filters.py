"""Row filters: required members, text length, existing images, disjoint corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vlprep.config import LENGTH_HIGH, LENGTH_LOW, WORD_PATTERN
from vlprep.functions.arrays import length_between
from vlprep.functions.text import has_text, words_between


def to_columns(df: DataFrame, members: list[str], missing: str = "drop") -> DataFrame:
    """Keep the named members of each sample; samples lacking one are dropped, or fail the job."""
    if missing not in ("drop", "error"):
        raise ValueError(f"missing must be 'drop' or 'error', got {missing!r}")
    if missing == "drop":
        return df.select(*members).filter(reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in members]))
    return df.select(
        *[
            F.when(F.col(m).isNotNull(), F.col(m))
            .otherwise(F.raise_error(F.lit(f"sample without member {m!r}")).cast(df.schema[m].dataType))
            .alias(m)
            for m in members
        ]
    )


def filter_length(df: DataFrame, n: str | Column, low: int = LENGTH_LOW, high: int = LENGTH_HIGH) -> DataFrame:
    """Rows with ``low < n < high``."""
    return df.filter(length_between(F.col(n) if isinstance(n, str) else n, low, high))


def filter_captions(df: DataFrame, text: str, append_end: bool, pattern: str = WORD_PATTERN,
                    low: int = LENGTH_LOW, high: int = LENGTH_HIGH) -> DataFrame:
    """Rows whose text has a token count inside the window.

    The end token counts when ``append_end`` is set. Null and empty texts have no
    tokens at all and drop out; this needs no token ids, so it runs before any lookup.
    """
    extra = 1 if append_end else 0
    return df.filter(has_text(F.col(text)) & words_between(F.col(text), low - extra, high - extra, pattern))


def require_images(samples: DataFrame, images: DataFrame, key: str = "image_id") -> DataFrame:
    """Samples whose image exists. Ids are compared as text, as file names give them."""
    known = images.select(F.col(key).cast("string").alias("_image"))
    return samples.join(known, F.col(key).cast("string") == F.col("_image"), "left_semi")


def text_key(text: str | Column) -> Column:
    """Key under which two texts count as the same one."""
    return F.md5(F.lower(F.trim(F.col(text) if isinstance(text, str) else text)))


def text_keys(used: DataFrame, text: str = "text", key=text_key) -> DataFrame:
    """Distinct keys of the texts of ``used``.

    They are grouped by key and first digit, which is the same as by key but
    leaves a later join a shuffle of its own: only then can Spark split a hot text
    among the new rows.
    """
    keys = used.filter(F.col(text).isNotNull()).select(key(text).alias("_text_key"))
    return keys.withColumn("_digit", F.substring("_text_key", 1, 1)).distinct().select("_text_key")


def disjoint(new: DataFrame, used: DataFrame, text: str = "text", key=text_key) -> DataFrame:
    """Rows of ``new`` whose text does not occur in ``used``.

    The used keys are reduced to distinct ones first, so copies are not shuffled.
    """
    return without_keys(new, text_keys(used, text, key), text, key)


def without_keys(new: DataFrame, seen: DataFrame, text: str = "text", key=text_key) -> DataFrame:
    """Rows of ``new`` whose text has none of the keys of :func:`text_keys`."""
    return new.withColumn("_text_key", key(text)).join(seen, "_text_key", "left_anti").drop("_text_key")


def quality_filter(df: DataFrame, predicate: Column) -> DataFrame:
    """Filter on carried quality columns; reaches the parquet scan."""
    return df.filter(predicate)
