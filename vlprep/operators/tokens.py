"""Vocabulary building, id lookup and caption samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vlprep.config import BROADCAST_ROWS, SYSTEM_PROMPT, WORD_PATTERN
from vlprep.functions.text import has_text, message, pick_prompt, render_chat, system_message, words
from vlprep.operators.filters import filter_captions
from vlprep.operators.ranking import name_index, nth_smallest, row_count
from vlprep.session import arrow_bytes, cut


def word_counts(df: DataFrame, text: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """How often each word occurs: ``word``, ``n``."""
    return df.select(F.explode(words(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def build_vocab(df: DataFrame, text: str, size: int, pattern: str = WORD_PATTERN) -> DataFrame:
    """The ``size`` most frequent words, numbered by (count descending, word).

    Words are counted before they are shuffled, and the counts are written once. The
    ``size``-th count is found by counting counts, so only words that often are numbered; of those
    that have just this count, the first by name.
    """
    counts = cut(word_counts(df, text, pattern))
    least = nth_smallest(counts.select((-F.col("n")).alias("n")), "n", size)
    top = counts
    if least is not None:
        top = counts.filter(F.col("n") > -least)
        ties, n_top = counts.filter(F.col("n") == -least), row_count(top)
        top = top.unionByName(name_index(ties, "word", "_place").filter(F.col("_place") < size - n_top).drop("_place"))
    return name_index(top, [F.desc("n"), F.col("word")], "token_id", size).select("word", "n", "token_id")


def encode(df: DataFrame, tokens: str, vocab: DataFrame, unknown_id: int, row_id: str | None = None,
           method: str = "auto", out: str = "ids") -> DataFrame:
    """Replace words by their ids; words outside the vocabulary become ``unknown_id``.

    ``lookup`` ships the vocabulary to the tasks, no row is shuffled. ``join``
    works for vocabularies of any size; rows are told apart by a unique ``row_id``, and
    without one they are written once with a number for each. ``auto``
    takes the first when the vocabulary has at most ``BROADCAST_ROWS`` words.
    """
    if method not in ("auto", "lookup", "join"):
        raise ValueError(f"method must be 'auto', 'lookup' or 'join', got {method!r}")
    if method != "join":
        # bounded read: one row more than the limit is enough to know
        rows = vocab.select("word", "token_id").limit(BROADCAST_ROWS + 1).toPandas()
        if len(rows) <= BROADCAST_ROWS:
            return _encode_lookup(df, tokens, rows, unknown_id, out)
        if method == "lookup":
            raise ValueError(f"vocabulary has more than {BROADCAST_ROWS} words, use method='join'")
    if row_id is None:
        numbered = cut(df.withColumn("_row", F.monotonically_increasing_id()))
        return _encode_join(numbered, tokens, vocab, unknown_id, "_row", out).drop("_row")
    return _encode_join(df, tokens, vocab, unknown_id, row_id, out)


def _ids_of(df: DataFrame, tokens: str, rows: pd.DataFrame, unknown_id: int | None):
    """Column of ids by a vocabulary shipped to the tasks, which index it once; other words get ``unknown_id``."""
    shared = df.sparkSession.sparkContext.broadcast((rows["word"].tolist(), rows["token_id"].tolist()))

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, numbers = shared.value
        place = dict(zip(reversed(known), reversed(numbers)))  # of a repeated word the first counts
        for column in batches:
            # each distinct word of a batch is looked up once
            found = column.flatten().dictionary_encode()
            if pa.types.is_null(found.type.value_type):
                found = pa.array([None] * len(found), pa.string()).dictionary_encode()
            numbers_here = pa.array([place.get(w, unknown_id) for w in found.dictionary.to_pylist()] + [unknown_id], pa.int32())
            flat = numbers_here.take(pc.fill_null(found.indices, len(numbers_here) - 1))
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
            yield pa.ListArray.from_arrays(offsets, flat, mask=pc.is_null(column))

    return ids(F.col(tokens))


def _encode_lookup(df: DataFrame, tokens: str, rows: pd.DataFrame, unknown_id: int, out: str) -> DataFrame:
    return df.withColumn(out, _ids_of(df, tokens, rows, unknown_id))


#: Rows of the filter that tells which words a large vocabulary can hold; each has three times 63 bits.
BLOOM_SLOTS = 1 << 17


def _bloom_keys(word: str) -> dict:
    bit = lambda seed: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(word, F.lit(seed)), F.lit(63)).cast("int"))
    return {"_slot": F.pmod(F.xxhash64(word), F.lit(BLOOM_SLOTS)), "_b0": bit(1), "_b1": bit(2), "_b2": bit(3)}


def may_hold(words_: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows whose ``word`` may be in ``vocab``: all that are, and few others. Nothing of ``words_`` is shuffled."""
    bits = vocab.select("word").withColumns(_bloom_keys("word"))
    slots = bits.groupBy("_slot").agg(*[F.bit_or(f"_b{i}").alias(f"_m{i}") for i in range(3)])  # BLOOM_SLOTS rows at most
    near = words_.withColumns(_bloom_keys("word")).join(F.broadcast(slots), "_slot")
    fits_all = [F.col(f"_m{i}").bitwiseAND(F.col(f"_b{i}")) != 0 for i in range(3)]
    return near.filter(fits_all[0] & fits_all[1] & fits_all[2]).select(*words_.columns)


def _encode_join(df: DataFrame, tokens: str, vocab: DataFrame, unknown_id: int, row_id: str, out: str) -> DataFrame:
    # Ids follow frequency, so the hot words are the lowest ids: those are shipped (unless
    # a vocabulary of the user's own repeats them), and what is left for the shuffle has no hot key. Words that
    # no vocabulary holds stay where they are. The texts are read once.
    head = vocab.filter(F.col("token_id") < BROADCAST_ROWS).select("word", "token_id").limit(BROADCAST_ROWS + 1).toPandas()
    tail = vocab.filter(F.col("token_id") >= BROADCAST_ROWS)
    if len(head) > BROADCAST_ROWS:
        head, tail = head[:0], vocab
    # the job runs in here, so that Python gets a bounded number of bytes at a time
    with arrow_bytes(df.sparkSession):
        found = cut(df.withColumn("_ids", _ids_of(df, tokens, head, None)))
    each = found.select(row_id, "_ids", F.posexplode(tokens).alias("_at", "word")).filter(F.get("_ids", F.col("_at")).isNull())
    rest = may_hold(each.filter(F.col("word").isNotNull()).select(row_id, "_at", "word"), tail)
    # one lookup per distinct word and row
    asked = rest.groupBy("word", row_id).agg(F.collect_list("_at").alias("_ats"))
    known = asked.join(tail.select("word", F.col("token_id").cast("int").alias("_id")), "word").select(row_id, F.explode("_ats").alias("_at"), "_id")
    more = known.groupBy(row_id).agg(F.collect_list(F.struct("_at", "_id")).alias("_more")).select(row_id, "_more._at", "_more._id")

    # ids in place order, a word's null before the id found for it: the last of a place stays, and nulls left are unknown
    ids = F.transform("_ids", lambda x, i: F.struct(i.alias("_at"), x.alias("_id")))
    own = F.filter(F.arrays_zip("_at", "_id"), lambda x: (x["_at"] < F.size("_ids")) & F.get("_ids", x["_at"]).isNull())
    laid = F.array_sort(F.concat(ids, own))
    last = lambda x, i: ~F.get(F.col("_laid"), i + 1)["_at"].eqNullSafe(x["_at"])
    merged = F.transform(F.filter("_laid", last), lambda x: F.coalesce(x["_id"], F.lit(unknown_id)))
    plain = F.transform("_ids", lambda x: F.coalesce(x, F.lit(unknown_id)))
    joined = found.join(more, row_id, "left").withColumn("_laid", F.when(F.col("_at").isNotNull(), laid))
    return joined.withColumn(out, F.when(F.col("_laid").isNull(), plain).otherwise(merged)).drop("_ids", "_at", "_id", "_laid")


def caption_tokens(df: DataFrame, text: str, pattern: str = WORD_PATTERN, out: str = "tokens") -> DataFrame:
    """Words of each caption that passes the contrastive length window (end token counted)."""
    return filter_captions(df, text, append_end=True, pattern=pattern).withColumn(out, words(F.col(text), pattern))


def caption_samples(df: DataFrame, row_id: str, text: str, prompts: Sequence[str], seed=0,
                    pattern: str = WORD_PATTERN, system: str = SYSTEM_PROMPT) -> DataFrame:
    """Prompt, prompt-with-answer and caption words of each caption sample.

    The length window is on the caption words alone, without an end token.
    """
    kept = filter_captions(df.filter(has_text(F.col(text))), text, append_end=False, pattern=pattern)
    asked = kept.withColumn("prompt", pick_prompt(row_id, prompts, seed))
    head = [system_message(system), message("user", F.col("prompt"))]
    prompt_chat = render_chat(F.array(*head), add_generation_prompt=True)
    full_chat = render_chat(F.array(*head, message("assistant", F.col(text))))
    return asked.select(
        "*",
        words(prompt_chat, pattern).alias("prompt_tokens"),
        words(full_chat, pattern).alias("full_tokens"),
        words(F.col(text), pattern).alias("caption_tokens"),
    )


def encode_with(df: DataFrame, text: str, loader, out: str = "ids") -> DataFrame:
    """Token ids from a tokeniser of the user's own.

    ``loader()`` runs once per Python worker and returns a function from text to a list of ids.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = loader()
        for column in batches:
            yield column.map(lambda s: None if s is None else list(encoder(s)))

    return df.withColumn(out, ids(F.col(text)))
