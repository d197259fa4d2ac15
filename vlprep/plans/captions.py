"""Caption corpora to training batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.config import WORD_PATTERN, LabelRule
from vlprep.functions.keys import hash_key
from vlprep.functions.text import hash_ids, with_end, words
from vlprep.operators.batching import assign_batches, make_labels, pad_batch
from vlprep.operators.filters import filter_captions
from vlprep.operators.tokens import caption_samples

RESERVED = 2  # ids 0 (pad) and 1 (end of text)
END_ID = 1


def contrastive_rows(df: DataFrame, row_id: str, text: str, vocab_size: int, pattern: str = WORD_PATTERN) -> DataFrame:
    """Captions inside the length window with their ids, end token included."""
    kept = filter_captions(df.select(row_id, text), text, append_end=True, pattern=pattern)
    return kept.select(row_id, with_end(hash_ids(words(F.col(text), pattern), vocab_size, RESERVED), END_ID).alias("ids"))


def contrastive_batches(df: DataFrame, row_id: str, text: str, size: int, seed, vocab_size: int = 50_000,
                        drop_last: bool = False) -> DataFrame:
    """Shuffled, numbered batches of caption ids, not padded yet. Texts are read once."""
    rows = contrastive_rows(df, row_id, text, vocab_size).withColumn("shuffle_key", hash_key(seed, row_id))
    return assign_batches(rows, "shuffle_key", size, drop_last, dear=True)


def captioning_batches(df: DataFrame, row_id: str, text: str, size: int, prompts: Sequence[str], seed,
                       rule: LabelRule, vocab_size: int = 50_000) -> DataFrame:
    """Padded captioning batches with labels: prompt, caption, shuffle, batch, pad, label."""
    samples = caption_samples(df.select(row_id, text), row_id, text, prompts, seed=seed)
    rows = samples.select(
        row_id,
        hash_ids(F.col("full_tokens"), vocab_size, RESERVED).alias("ids"),
        F.size("prompt_tokens").cast("bigint").alias("prompt_len"),
        hash_key(seed, row_id).alias("shuffle_key"),
    )
    return make_labels(pad_batch(assign_batches(rows, "shuffle_key", size, dear=True)), rule)
