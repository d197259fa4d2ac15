"""Dialogues to fine-tuning batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.config import TEST_DIVISOR, VALIDATION_ROWS, WORD_PATTERN, LabelRule
from vlprep.functions.keys import hash_key
from vlprep.functions.text import hash_ids, words
from vlprep.operators.batching import assign_batches, make_labels, pad_batch
from vlprep.operators.dialogue import dialogue_samples, opening_prompts
from vlprep.operators.split import positional_split
from vlprep.plans.captions import RESERVED
from vlprep.session import cut


def dialogue_rows(turns: DataFrame, images: DataFrame | None = None, vocab_size: int = 50_000,
                  pattern: str = WORD_PATTERN, **options) -> DataFrame:
    """Token ids and prompt length of each valid dialogue."""
    samples = dialogue_samples(turns, images, **options)
    return samples.select(
        "conv_id",
        hash_ids(words(F.col("text"), pattern), vocab_size, RESERVED).alias("ids"),
        F.size(words(opening_prompts(F.col("messages")), pattern)).cast("bigint").alias("prompt_len"),
    )


def dialogue_batches(turns: DataFrame, size: int, rule: LabelRule, images: DataFrame | None = None, order: str = "conv_id",
                     **options) -> DataFrame:
    """Padded and labelled batches of dialogues, in order of ``conv_id``."""
    rows = dialogue_rows(turns, images, **options)
    return make_labels(pad_batch(assign_batches(rows, order, size, dear=True, like=turns)), rule)


def finetune_rows(turns: DataFrame, images: DataFrame, seed, val: int = VALIDATION_ROWS, test_div: int = TEST_DIVISOR, **options) -> DataFrame:
    """Dialogue rows with their split and the shuffle key of a first epoch.

    The split ranks the rows twice, so they are written once and reread.
    """
    rows = cut(dialogue_rows(turns, images, **options))
    return positional_split(rows, "conv_id", val, test_div, seed).withColumn("shuffle_key", hash_key(seed, F.lit(0), "conv_id"))
