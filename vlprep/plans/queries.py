"""The registered queries: each runs an operator over whole tables of ``sf_dir``."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vlprep.config import FINETUNE, PRETRAIN, STRICT, SplitPaths
from vlprep.functions import arrays, text, vectors
from vlprep.functions.keys import digest
from vlprep.operators import (
    batching,
    dialogue,
    filters,
    generation,
    images,
    metrics,
    ranking,
    shuffles,
    similarity,
    split,
    tokens,
    udf,
)
from vlprep.plans import captions, dialogues, evaluation
from vlprep.session import run_dir
from vlprep.sources import tables, tarshards
from vlprep.streaming import jobs

SEED = 7
VOCAB = 1000
PROMPTS = ("What does this picture show?", "Say in one sentence what can be seen here.", "Name the main things in the image.")
TITLE = r"(?s)<title>(.*?)</title>"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def six(value: Column) -> Column:
    return F.round(value, 6)


# ---- sources --------------------------------------------------------------


@query
def metadata_scan(spark, sf):
    title = F.regexp_extract("html", TITLE, 1)
    return tables.read_metadata(spark, f"{sf}/pages.parquet", "url", title, keep=["page_id"])


@query
def shard_listing(spark, sf):
    return split.shard_table(table(spark, sf, "documents"), "source")


@query
def labelled_scan(spark, sf):
    rows = tables.read_labelled(
        spark, f"{sf}/embeddings.parquet", f"{sf}/nation.parquet", class_key="n_nationkey", class_name="n_name"
    )
    return rows.select("vec_id", F.col("label").cast("bigint").alias("label"), "class_name")


@query
def run_log_scan(spark, sf):
    line = tables.format_run_log(
        table(spark, sf, "events").select(
            F.col("event_id").alias("step"),
            F.when(F.col("event_type") == "view", "val").when(F.col("event_type") == "error", "broken").otherwise("train").alias("split"),
            F.col("value").alias("loss"),
        )
    )
    return tables.parse_run_log(line).filter("ok").select("step", "split", "loss")


@query
def run_log_roundtrip(spark, sf):
    folder = run_dir(spark, "runlog")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("step"), F.lit("train").alias("split"), F.col("value").alias("loss"))
    tables.write_run_log(rows, folder)
    return tables.read_run_log(spark, folder)


@query
def json_member(spark, sf):
    return table(spark, sf, "events").select("event_id", text.json_member(F.col("props"), "k", "bigint").alias("k"))


def _documents_as_samples(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id"),
        F.format_string("%09d", F.col("doc_id")).alias("key"),
        F.encode(F.col("text"), "utf-8").alias("jpg"),
        F.to_json(F.struct(F.col("text").alias("caption"))).alias("json"),
    )


@query
def tar_roundtrip(spark, sf):
    folder = run_dir(spark, "tars")
    tarshards.write_shards(_documents_as_samples(spark, sf), folder, "doc_id", rows_per_shard=300)
    back = tarshards.with_captions(tarshards.good_samples(tarshards.read_shards(spark, folder, split_bytes=1 << 18)))
    return back.select(
        F.col("key").cast("bigint").alias("doc_id"),
        F.regexp_extract("shard", r"(\d+)-\w+\.tar$", 1).cast("bigint").alias("shard_idx"),
        F.md5("jpg").alias("jpg_md5"),
        F.md5("caption").alias("caption_md5"),
    )


@query
def dialogue_json_scan(spark, sf):
    folder = run_dir(spark, "dialogues")
    tables.write_dialogue_lines(_nested(spark, sf), folder)
    docs = tables.read_dialogues(spark, folder, layout="lines")
    content = F.get("conversations", F.lit(0))["content"]
    return docs.select(
        "image_id",
        F.size(content).cast("bigint").alias("n_messages"),
        F.md5(F.array_join(content["value"], "|")).alias("values_md5"),
    )


@query
def dialogue_array_scan(spark, sf):
    """Files that hold one JSON array each, cut where documents start."""
    folder = run_dir(spark, "dialogues")
    tables.write_dialogue_arrays(_nested(spark, sf), folder)
    docs = tables.read_dialogues(spark, folder, layout="split")
    content = F.get("conversations", F.lit(0))["content"]
    return docs.select(
        "image_id",
        F.size(content).cast("bigint").alias("n_messages"),
        F.md5(F.array_join(content["value"], "|")).alias("values_md5"),
    )


@query
def tar_listing(spark, sf):
    """Numbers and sizes of the shards that were written, without reading them."""
    folder = run_dir(spark, "tars")
    samples = _documents_as_samples(spark, sf).drop("json")
    tarshards.write_shards(samples, folder, "doc_id", rows_per_shard=300)
    listed = tables.list_shards(spark, f"{folder}/*.tar")
    return listed.select("shard_idx", F.regexp_extract("shard", r"(\d+)-\w+\.tar$", 1).cast("bigint").alias("number"), "bytes")


@query
def split_sources(spark, sf):
    """Training and validation shards in folders of their own, read by the name of the split."""
    folder = run_dir(spark, "splits")
    paths = SplitPaths(f"{folder}/train", f"{folder}/val")
    rows = split.split_shards(_documents_as_samples(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id"), "source", 0.2, SEED)
    parts = []
    for name in ("train", "val"):
        tarshards.write_shards(rows.filter(F.col("split") == name).select("doc_id", "key", "json"), paths.path(name), "doc_id", rows_per_shard=200)
        read = tables.read_split(spark, paths, name, columns="json")
        parts.append(tarshards.good_samples(read).select(F.col("key").cast("bigint").alias("doc_id"), F.lit(name).alias("split")))
    return parts[0].unionByName(parts[1])


@query
def tar_stream(spark, sf):
    """Caption words of the samples of shards as they come in."""
    folder = run_dir(spark, "tars")
    tarshards.write_shards(_documents_as_samples(spark, sf).drop("jpg"), f"{folder}/in", "doc_id", rows_per_shard=300)
    stream = tarshards.stream_shards(spark, f"{folder}/in", f"{folder}/log", columns="json", split_bytes=1 << 18)
    samples = tarshards.with_captions(tarshards.good_samples(stream)).select(F.col("key").cast("bigint").alias("doc_id"), "caption")
    jobs.stream_prepare(samples, f"{folder}/out", f"{folder}/state", text="caption").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", digest(F.col("tokens")).alias("tokens"))


@query
def batch_sink(spark, sf):
    folder = run_dir(spark, "batches")
    docs = table(spark, sf, "documents").select("doc_id", "source")
    rows = batching.assign_batches(split.split_shards(docs, "source", 0.2, SEED), "doc_id", 16)
    tables.write_batches(rows.withColumn("rank", F.col("batch_id") % 4), folder)
    return spark.read.parquet(folder).select("doc_id", F.col("split").cast("string").alias("split"), F.col("rank").cast("bigint").alias("rank"), "batch_id", "pos")


# ---- captions -------------------------------------------------------------


@query
def caption_filter(spark, sf):
    kept = tokens.caption_tokens(table(spark, sf, "documents").select("doc_id", "text"), "text")
    ids = text.with_end(text.hash_ids(F.col("tokens"), VOCAB, captions.RESERVED), captions.END_ID)
    return kept.select("doc_id", F.size(ids).cast("bigint").alias("n_tokens"), digest(ids).alias("ids"))


@query
def vocab_topk(spark, sf):
    return tokens.build_vocab(table(spark, sf, "documents"), "text", VOCAB)


def _encoded(spark, sf, method):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    vocab = tokens.build_vocab(docs, "text", VOCAB)
    listed = docs.select("doc_id", text.words(F.col("text")).alias("tokens"))
    out = tokens.encode(listed, "tokens", vocab, unknown_id=VOCAB, row_id="doc_id", method=method)
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.size(F.filter("ids", lambda x: x == VOCAB)).cast("bigint").alias("n_unknown"),
        digest(F.col("ids")).alias("ids"),
    )


@query
def encode_tokens(spark, sf):
    return _encoded(spark, sf, "lookup")


@query
def encode_tokens_join(spark, sf):
    return _encoded(spark, sf, "join")


@query
def encode_with_tokeniser(spark, sf):
    def loader():
        return lambda s: [len(w) for w in s.split(" ")]

    out = tokens.encode_with(table(spark, sf, "documents").select("doc_id", "text"), "text", loader)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), digest(F.col("ids")).alias("ids"))


@query
def prompt_pick(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.pick_prompt("doc_id", PROMPTS, seed=SEED).alias("prompt"))


@query
def caption_samples(spark, sf):
    out = tokens.caption_samples(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", PROMPTS, seed=SEED)
    return out.select(
        "doc_id",
        "prompt",
        F.size("prompt_tokens").cast("bigint").alias("n_prompt"),
        F.size("full_tokens").cast("bigint").alias("n_full"),
        F.size("caption_tokens").cast("bigint").alias("n_caption"),
        digest(F.col("full_tokens")).alias("full_digest"),
    )


@query
def quality_filter(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    carried = similarity.pair_by_key(docs, table(spark, sf, "labels"), "doc_id")
    kept = filters.quality_filter(carried, (F.col("quality") == 1) & (F.col("toxic") == 0))
    return kept.select("doc_id", "source", "n_chars", F.col("quality").cast("bigint").alias("quality"))


@query
def required_members(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    joined = docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality")), "doc_id", "left")
    return filters.to_columns(joined, ["doc_id", "lang", "quality"])


@query
def pair_by_key(spark, sf):
    left = table(spark, sf, "documents").select("doc_id", "lang")
    right = table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("bigint").alias("toxic"))
    return similarity.pair_by_key(left, right, "doc_id")


@query
def disjoint_corpus(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    used = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return filters.disjoint(docs, used).select("doc_id")


@query
def map_columns(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")

    def doubled(s: pd.Series) -> pd.Series:
        return s * 2

    return udf.map_columns(docs, {"lang": F.upper, "n_chars": doubled}, types={"n_chars": "bigint"})


@query
def where_fn(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return udf.where_fn(docs, lambda n, lang: (n > 500) & (lang == "en"), "n_chars", "lang")


@query
def where_unaccented(spark, sf):
    """A predicate that columns cannot say: texts without any accent, by decomposing their characters."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")

    def plain(t: str | None) -> bool:
        return t is not None and (t.isascii() or not any(map(unicodedata.combining, unicodedata.normalize("NFD", t))))

    return udf.where_fn(docs, lambda texts: texts.map(plain), "text").select("doc_id", "lang")


@query
def chained(spark, sf):
    """Operators put together with ``DataFrame.transform``."""
    return (
        table(spark, sf, "documents")
        .transform(filters.filter_captions, "text", append_end=True)
        .transform(udf.where_fn, F.col("lang") == "en")
        .transform(udf.map_columns, {"source": F.upper})
        .transform(split.split_shards, "source", 0.2, SEED)
        .transform(lambda df: ranking.exact_rank(df.select("doc_id", "source", "split"), "doc_id", "place"))
        .transform(batching.assign_batches, "doc_id", 16)
        .select("doc_id", "source", "split", "batch_id", "pos")
    )


@query
def embed_table(spark, sf):
    def loader():
        return lambda pdf: [(len(t), t.count("e")) for t in pdf["text"]]

    out = udf.embed_table(table(spark, sf, "documents"), loader, ["text"], ["doc_id"])
    return out.select(
        "doc_id",
        F.get("embedding", F.lit(0)).cast("double").alias("n_chars"),
        F.get("embedding", F.lit(1)).cast("double").alias("n_e"),
    )


# ---- order, batches, splits -----------------------------------------------


@query
def exact_rank(spark, sf):
    return ranking.exact_rank(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query
def seeded_shuffle(spark, sf):
    return shuffles.shuffle_positions(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED)


@query
def shuffled_rows(spark, sf):
    return shuffles.shuffle(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", SEED)


@query
def buffer_shuffle(spark, sf):
    ranked = ranking.exact_rank(table(spark, sf, "documents").select("doc_id"), "doc_id", "place")
    return shuffles.buffer_shuffle(ranked, "place", "doc_id", SEED, size=100)


@query
def shard_shuffle(spark, sf):
    return shuffles.shuffle_shards(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", SEED)


@query
def batches(spark, sf):
    return batching.assign_batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 48)


@query
def batches_drop_last(spark, sf):
    return batching.assign_batches(table(spark, sf, "documents").select("doc_id"), "doc_id", 48, drop_last=True)


@query
def batch_order(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    rows = batching.assign_batches(docs, "doc_id", 32)
    return shuffles.shuffle_batches(rows, "batch_id", -(-docs.count() // 32), SEED, epoch=1)


@query
def epochs(spark, sf):
    return shuffles.epochs(table(spark, sf, "documents").select("doc_id"), "doc_id", 2, SEED)


@query
def positional_split(spark, sf):
    return split.positional_split(table(spark, sf, "documents").select("doc_id"), "doc_id", val=100, seed=SEED)


@query
def head_rows(spark, sf):
    return split.head_rows(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 64)


@query
def tail_rows(spark, sf):
    return split.tail_from(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 64)


@query
def shard_split(spark, sf):
    return split.split_shards(table(spark, sf, "documents").select("doc_id", "source"), "source", 0.2, SEED)


@query
def rank_assign(spark, sf):
    return split.assign_ranks(table(spark, sf, "documents").select("doc_id", "source"), "source", world=8, workers=4)


@query
def resample(spark, sf):
    return split.resample_shards(table(spark, sf, "documents").select("doc_id", "source"), "source", 12, SEED)


@query
def pad_and_mask(spark, sf):
    rows = captions.contrastive_batches(table(spark, sf, "documents"), "doc_id", "text", 32, SEED, VOCAB)
    padded = batching.pad_batch(rows)
    return padded.select(
        "doc_id",
        "batch_id",
        "pos",
        F.col("batch_len").cast("bigint").alias("batch_len"),
        arrays.seq_len(F.col("attention_mask")).cast("bigint").alias("seq_len"),
        digest(F.col("input_ids")).alias("input_ids"),
        digest(F.col("attention_mask")).alias("attention_mask"),
    )


@query
def batch_summary(spark, sf):
    rows = captions.contrastive_batches(table(spark, sf, "documents"), "doc_id", "text", 32, SEED, VOCAB)
    return batching.batch_summary(rows)


@query
def dataset_report(spark, sf):
    docs = table(spark, sf, "documents").select("source", text.count_words(F.col("text")).alias("n_words"))
    return metrics.dataset_report(docs, "source", "n_words")


@query
def step_budget(spark, sf):
    return metrics.step_budget(table(spark, sf, "documents"), "source", 8, 2, 2)


# ---- dialogues ------------------------------------------------------------


def _turns(spark, sf):
    return table(spark, sf, "conversations")


def _images(spark, sf):
    return table(spark, sf, "labels").select(F.col("doc_id").alias("conv_id"))


@query
def require_images(spark, sf):
    return filters.require_images(_turns(spark, sf), _images(spark, sf), "conv_id").select("conv_id", "turn")


@query
def chat_render(spark, sf):
    return dialogue.whole_chats(_turns(spark, sf), add_generation_prompt=True).select("conv_id", F.md5("chat").alias("chat_md5"))


@query
def turn_pairs(spark, sf):
    return dialogue.pair_turns(_turns(spark, sf)).select(
        "conv_id", "pair", "question_role", "answer_role", F.md5("question").alias("question"), F.md5("answer").alias("answer")
    )


@query
def dialogue_samples(spark, sf):
    out = dialogue.dialogue_samples(_turns(spark, sf), _images(spark, sf))
    return out.select("conv_id", "n_pairs", F.md5("text").alias("text_md5"))


@query
def dialogue_samples_truncated(spark, sf):
    out = dialogue.dialogue_samples(_turns(spark, sf), on_dangling="truncate", keep_empty=True)
    return out.select("conv_id", "n_pairs", F.md5("text").alias("text_md5"))


def _nested(spark, sf):
    lists = dialogue.first_messages(_turns(spark, sf), max_pairs=None)
    content = F.transform(
        "messages",
        lambda m: F.struct(
            F.when(m["role"] == "assistant", "gpt").otherwise(m["role"]).alias("from"), m["content"].alias("value")
        ),
    )
    return lists.select(
        F.col("conv_id").alias("image_id"),
        F.array(F.struct(F.lit("first turns").alias("topic"), content.alias("content"))).alias("conversations"),
    )


@query
def nested_samples(spark, sf):
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"))
    out = dialogue.nested_samples(_nested(spark, sf), known)
    return out.select("image_id", "conv_no", "n_pairs", F.md5("text").alias("text_md5"))


@query
def history_prompts(spark, sf):
    out = dialogue.history_prompts(_turns(spark, sf), chunk=4)
    return out.withColumn("prompt_tail", F.md5("prompt_tail"))


@query
def whole_prompts(spark, sf):
    """Of the last answer of every conversation."""
    answers = dialogue.history_prompts(_turns(spark, sf), chunk=4)
    last = answers.groupBy("conv_id").agg(F.max_by(F.struct("turn", "prior_chunks", "n_messages", "prompt_tail"), "n_messages").alias("m"))
    out = dialogue.whole_prompts(last.select("conv_id", "m.*"), dialogue.transcript_chunks(_turns(spark, sf), chunk=4))
    return out.withColumn("prompt", F.md5("prompt"))


@query
def transcript_chunks(spark, sf):
    return dialogue.transcript_chunks(_turns(spark, sf), chunk=4).withColumn("text", F.md5("text"))


def _labels(spark, sf, rule):
    rows = dialogues.dialogue_batches(_turns(spark, sf), 16, rule, vocab_size=VOCAB)
    return rows.select(
        "conv_id", "batch_id", "pos", "prompt_len",
        digest(F.col("input_ids")).alias("input_ids"),
        digest(F.col("attention_mask")).alias("attention_mask"),
        digest(F.col("labels")).alias("labels"),
    )


@query
def labels_pretrain(spark, sf):
    return _labels(spark, sf, PRETRAIN)


@query
def labels_finetune(spark, sf):
    return _labels(spark, sf, FINETUNE)


@query
def labels_strict(spark, sf):
    return _labels(spark, sf, STRICT)


@query
def label_stats(spark, sf):
    return batching.label_stats(dialogues.dialogue_batches(_turns(spark, sf), 16, STRICT, vocab_size=VOCAB))


def _extended(spark, sf, brackets):
    rows = dialogues.dialogue_batches(_turns(spark, sf), 16, STRICT, vocab_size=VOCAB)
    wide = batching.extend_prefix(rows, brackets=brackets, image_id=VOCAB + 2, start_id=VOCAB + 3, end_id=VOCAB + 4)
    return wide.select(
        "conv_id",
        F.size("input_ids").cast("bigint").alias("n_positions"),
        digest(F.col("input_ids")).alias("input_ids"),
        digest(F.col("attention_mask")).alias("attention_mask"),
        digest(F.col("labels")).alias("labels"),
    )


@query
def prefix_extend(spark, sf):
    return _extended(spark, sf, True)


@query
def prefix_extend_linear(spark, sf):
    return _extended(spark, sf, False)


@query
def captioning_batches(spark, sf):
    rows = captions.captioning_batches(table(spark, sf, "documents"), "doc_id", "text", 32, PROMPTS, SEED, PRETRAIN, VOCAB)
    return rows.select("doc_id", "batch_id", "pos", digest(F.col("input_ids")).alias("input_ids"), digest(F.col("labels")).alias("labels"))


@query
def finetune_split(spark, sf):
    rows = dialogues.finetune_rows(_turns(spark, sf), _images(spark, sf), SEED, val=10, vocab_size=VOCAB)
    return rows.select("conv_id", "split", F.size("ids").cast("bigint").alias("n_tokens"), "shuffle_key")


@query
def clean_response(spark, sf):
    response = F.concat(
        F.col("role"),
        F.when(F.col("turn") % 2 == 0, " \n<|im_start|>").otherwise("\n"),
        F.col("text"),
        F.when(F.col("turn") % 3 == 0, "\n").otherwise("<|im_end|>\n "),
    )
    return _turns(spark, sf).select(
        "conv_id", "turn", F.md5(text.clean_response(response, F.length("role"))).alias("answer_md5")
    )


# ---- generation -----------------------------------------------------------


@query
def truncate_generation(spark, sf):
    ids = F.transform(text.words(F.col("text")), lambda w: F.length(w) % 12)
    rows = table(spark, sf, "documents").select("doc_id", ids.alias("ids"))
    rows = rows.withColumns({"mask": arrays.mask(F.col("ids"), F.size("ids")), "prompt_len": F.least(F.lit(4), F.size("ids"))})
    out = generation.truncate_generation(rows, "ids", "mask", "prompt_len", stop_id=0)
    return out.select(
        "doc_id", F.size("answer_ids").cast("bigint").alias("n_kept"), F.col("finish_index").cast("bigint").alias("finish_index"), digest(F.col("answer_ids")).alias("answer_ids")
    )


@query
def generate_table(spark, sf):
    def loader():
        def step(rows):
            logits = np.zeros((len(rows), 50))
            logits[np.arange(len(rows)), [(r[-1] * 7 + 3) % 50 for r in rows]] = 1.0
            return logits

        return step

    start = table(spark, sf, "documents").select(
        "doc_id", F.array((F.col("doc_id") % 50).cast("int"), (F.col("n_chars") % 50).cast("int")).alias("ids")
    )
    out = generation.generate_table(start, "doc_id", "ids", loader, stop_id=24, max_steps=12)
    return out.select("doc_id", F.size("output_ids").cast("bigint").alias("n_ids"), "finish_index", digest(F.col("output_ids")).alias("output_ids"))


@query
def select_token(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        vectors.select_token(v, 0, "vec_id").alias("greedy"),
        vectors.select_token(v, 0.1, "vec_id", SEED).alias("drawn"),
    )


# ---- vectors --------------------------------------------------------------


@query
def l2_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5 + 2))
    rows = table(spark, sf, "embeddings").select("vec_id", scaled.alias("v"))
    unit = rows.select("vec_id", "v", vectors.l2_normalize(F.col("v")).alias("u"))
    return unit.select(
        "vec_id",
        six(vectors.norm(F.col("v"))).alias("norm"),
        six(vectors.dot(F.col("u"), F.col("v"))).alias("own_dot"),
        six(F.get("u", F.lit(0))).alias("first"),
        six(F.element_at("u", -1)).alias("last"),
    )


@query
def softmax_probs(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", vectors.softmax(F.col("embedding"), 0.5).alias("p"))
    return rows.select(
        "vec_id",
        six(F.array_max("p")).alias("top"),
        six(F.get("p", F.lit(0))).alias("first"),
        six(F.aggregate("p", F.lit(0.0), lambda s, x: s - x * F.log(x))).alias("entropy"),
    )


@query
def scaled_dot(spark, sf):
    unit = F.array(*[F.lit(1.0 if i % 2 == 0 else -1.0) for i in range(64)])
    return table(spark, sf, "embeddings").select(
        "vec_id",
        six(vectors.dot(F.col("embedding"), unit) * vectors.scaler()).alias("score"),
        six(vectors.scaler(F.col("label").cast("double"))).alias("clamped"),
    )


@query
def argmax_by(spark, sf):
    each = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    rounded = each.select(F.col("label").cast("bigint").alias("label"), F.col("at").cast("bigint").alias("at"), F.round(F.col("x").cast("double"), 1).alias("x"))
    return ranking.argmax_by(rounded, "label", "x", "at")


WEIGHTS = np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(4)])
BIAS = np.array([0.0, 0.1, 0.2, 0.3])


@query
def project(spark, sf):
    out = similarity.project(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding", WEIGHTS, BIAS)
    return out.select("vec_id", *[six(F.get("projected", F.lit(i))).alias(f"y{i}") for i in range(4)])


@query
def pool_tokens(spark, sf):
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    rows = table(spark, sf, "embeddings").select("vec_id", grid.alias("t"), (F.col("vec_id") % 8 + 1).alias("n"))
    total = lambda v: six(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")))
    return rows.select(
        "vec_id",
        total(vectors.pool(F.col("t"), "first")).alias("first"),
        total(vectors.pool(F.col("t"), "last", F.col("n"))).alias("last"),
        total(F.flatten(vectors.pool(F.col("t"), "rest"))).alias("rest"),
    )


def _two_towers(spark, sf):
    """Even ids are images, the odd id after each is its text."""
    rows = table(spark, sf, "embeddings").withColumn("key", F.expr("vec_id div 2"))
    image = rows.filter("vec_id % 2 = 0").select("key", F.col("key").alias("place"), F.col("embedding").alias("image_vec"))
    caption = rows.filter("vec_id % 2 = 1").select("key", F.col("embedding").alias("text_vec"))
    return image, caption


def _stretched(df, vector):
    """Vectors of several lengths, as towers give them before they are normalised."""
    return df.withColumn(vector, F.transform(vector, lambda x: x * (F.col("key") % 3 + 1)))


@query
def gather_ranks(spark, sf):
    return similarity.gather_ranks(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 16, 4)


@query
def concat_ranks(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"))
    return similarity.concat_ranks([rows.filter("label < 5"), rows.filter("label >= 5")])


@query
def batch_pairs(spark, sf):
    pairs = similarity.gather_ranks(similarity.pair_by_key(*_two_towers(spark, sf), "key"), "place", 16, 4)
    # tiles of 24 rows: each batch of 64 is split
    out = similarity.batch_pairs(pairs, scaler=10.0, block=24, batch_size=64)
    return out.select("batch_id", "pos", *[six(F.col(c)).alias(c) for c in ("own", "image_lse", "text_lse")], "best")


def _contrastive(spark, sf, world):
    image, caption = _two_towers(spark, sf)
    out = similarity.contrastive_report(_stretched(image, "image_vec"), _stretched(caption, "text_vec"), micro=16, world=world)
    return out.select("batch_id", "n_pairs", *[six(F.col(c)).alias(c) for c in ("image_loss", "text_loss", "loss")])


@query
def contrastive_global(spark, sf):
    return _contrastive(spark, sf, 4)


@query
def contrastive_local(spark, sf):
    return _contrastive(spark, sf, 1)


@query
def class_prompts(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("label"), text.class_prompt(F.lower("n_name")).alias("prompt")
    )


def _zero_shot(spark, sf, **options):
    rows = table(spark, sf, "embeddings")
    out = similarity.zero_shot(rows, similarity.class_vectors(rows), **options)
    return out.select("vec_id", F.col("label").cast("bigint").alias("label"), "predicted", six(F.col("score")).alias("score"))


@query
def zero_shot(spark, sf):
    return _zero_shot(spark, sf)


@query
def zero_shot_blocks(spark, sf):
    return _zero_shot(spark, sf, class_block=4)


@query
def zero_shot_accuracy(spark, sf):
    out = evaluation.zero_shot_report(table(spark, sf, "embeddings"))
    return out.select("correct", "total", six(F.col("accuracy")).alias("accuracy"))


# ---- images: grey 8 x 8 pixels made of the vectors -------------------------


def _pixels_of(vector: Column) -> Column:
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 255)))
    hexes = F.transform(vector, lambda x: F.lpad(F.hex(level(x)), 2, "0"))
    return F.unhex(F.array_join(hexes, ""))


def _grey_images(spark, sf):
    image = F.struct(
        F.lit("").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"),
        F.lit(0).alias("mode"), F.col("data"),
    )
    rows = table(spark, sf, "embeddings").select("vec_id", _pixels_of(F.col("embedding")).alias("data"))
    return rows.select("vec_id", image.alias("image"))


@query
def image_normalize(spark, sf):
    out = images.normalize_images(_grey_images(spark, sf))
    return out.select(
        "vec_id",
        F.size("pixels").cast("bigint").alias("n_values"),
        *[F.round(F.get("pixels", F.lit(i)).cast("double"), 4).alias(f"v{i}") for i in (0, 63, 64, 191)],
    )


@query
def image_resize(spark, sf):
    out = images.resize_images(_grey_images(spark, sf), 4, "nearest")
    return out.select("vec_id", F.col("image.width").cast("bigint").alias("width"), F.col("image.nChannels").cast("bigint").alias("channels"), F.lower(F.hex("image.data")).alias("data"))


@query
def image_resize_bilinear(spark, sf):
    out = images.resize_images(_grey_images(spark, sf), 4)
    return out.select("vec_id", F.col("image.width").cast("bigint").alias("width"), F.lower(F.hex("image.data")).alias("data"))


@query
def image_folder(spark, sf):
    """Image files keyed by their names, next to a file that is no image."""
    folder = run_dir(spark, "images")
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("name"), _pixels_of(F.col("embedding")).alias("data"))
    images.write_grey_pngs(rows.unionByName(spark.createDataFrame([("read me", None)], "name string, data binary")), folder, 8, 8)
    out = tables.read_images(spark, folder)
    return out.select("image_id", F.col("image.width").cast("bigint").alias("width"), F.lower(F.hex("image.data")).alias("data"))


@query
def image_patches(spark, sf):
    pixels = images.normalize_images(_grey_images(spark, sf), mean=(0.0, 0.0, 0.0), std=(1.0, 1.0, 1.0))
    out = images.patchify(pixels.withColumns({"height": F.lit(8), "width": F.lit(8)}), "vec_id", 4)
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.select("vec_id", "patch", F.size("values").cast("bigint").alias("n_values"), F.round(total, 4).alias("total"), F.round(F.get("values", F.lit(5)).cast("double"), 4).alias("v5"))


@query
def image_decode(spark, sf):
    def loader():
        return lambda data: np.frombuffer(data, dtype=np.uint8).reshape(8, 8, 1)

    rows = table(spark, sf, "embeddings").select("vec_id", _pixels_of(F.col("embedding")).alias("jpg"))
    # labels stand for samples whose bytes are cut short
    rows = rows.withColumn("jpg", F.when(F.col("vec_id") % 7 == 3, F.substring("jpg", 1, 10)).otherwise(F.col("jpg")))
    out = images.decode_images(rows, loader)
    return out.select("vec_id", F.col("image").isNotNull().cast("bigint").alias("decoded"), F.lower(F.hex("image.data")).alias("data"))


@query
def attach_images(spark, sf):
    samples = dialogue.dialogue_samples(_turns(spark, sf)).select("conv_id", "n_pairs")
    bytes_of = _grey_images(spark, sf).withColumnRenamed("vec_id", "conv_id")
    out = images.attach_images(samples, bytes_of, "conv_id")
    return out.select("conv_id", "n_pairs", F.lower(F.hex("image.data")).alias("data"))


# ---- metrics --------------------------------------------------------------


@query
def val_loss(spark, sf):
    out = metrics.mean_loss(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 10)
    return out.select("user_id", "n_batches", six(F.col("mean_loss")).alias("mean_loss"))


@query
def accum_loss(spark, sf):
    out = metrics.accumulate_loss(table(spark, sf, "events"), "event_id", "value", 8)
    return out.select("step", "n_micro", six(F.col("loss")).alias("loss"))


@query
def rank_mean(spark, sf):
    rows = table(spark, sf, "events").select(F.expr("event_id div 16").alias("step"), (F.col("user_id") % 4).alias("rank"), "value")
    return metrics.rank_mean(rows, "step", "rank", "value").select("step", "n_ranks", six(F.col("loss")).alias("loss"))


@query
def every_k(spark, sf):
    return metrics.every_k(table(spark, sf, "events").select("event_id", "value"), "event_id", 100)


@query
def take_per_group(spark, sf):
    return ranking.take_per_group(table(spark, sf, "events").select("event_type", "event_id", "value"), "event_type", "event_id", 25)


@query
def masked_mean(spark, sf):
    rows = captions.captioning_batches(table(spark, sf, "documents"), "doc_id", "text", 32, PROMPTS, SEED, STRICT, VOCAB)
    losses = rows.withColumn("losses", F.transform("input_ids", lambda x: (x % 13) / 13.0))
    out = metrics.masked_mean(losses, "losses", "labels", "batch_id")
    return out.select("batch_id", "n_tokens", six(F.col("loss")).alias("loss"))


# ---- streams, run to the end of the given files -----------------------------


def _stream(spark, sf, name):
    # as a pattern the path may be a file or a folder of files; a stream takes a plain path for a folder
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("basePath", sf).parquet(f"{sf}/{{{name}}}.parquet")


@query
def stream_prepare(spark, sf):
    folder = run_dir(spark, "stream")
    source = _stream(spark, sf, "documents").select("doc_id", "text")
    jobs.stream_prepare(source, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id", digest(F.col("tokens")).alias("tokens"))


@query
def stream_disjoint(spark, sf):
    folder = run_dir(spark, "stream")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    used = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    source = _stream(spark, sf, "documents").select("doc_id", "text")
    jobs.stream_disjoint(source, used, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("doc_id")


@query
def stream_batches(spark, sf):
    folder = run_dir(spark, "stream")
    source = _stream(spark, sf, "documents").select("doc_id")
    jobs.stream_batches(source, f"{folder}/out", f"{folder}/state", "doc_id", 48).awaitTermination()
    return jobs.complete_batches(spark, f"{folder}/out", 48).select("doc_id", "batch_id", "pos")


@query
def run_log_metrics(spark, sf):
    lines = tables.format_run_log(
        table(spark, sf, "events").select(
            F.col("event_id").alias("step"), F.when(F.col("event_type") == "view", "val").otherwise("train").alias("split"), F.col("value").alias("loss")
        )
    )
    out = jobs.run_log_metrics(lines, 1000)
    return out.select("split", "bucket", "n_lines", six(F.col("mean_loss")).alias("mean_loss"), "last_step", "last_loss")


@query
def stream_run_log(spark, sf):
    folder = run_dir(spark, "stream")
    lines = tables.format_run_log(
        table(spark, sf, "events").select(
            F.col("event_id").alias("step"), F.when(F.col("event_type") == "view", "val").otherwise("train").alias("split"), F.col("value").alias("loss")
        )
    )
    lines.write.text(f"{folder}/log")

    def sink(changed: DataFrame, epoch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    jobs.stream_run_log(spark, f"{folder}/log", sink, f"{folder}/state", 1000).awaitTermination()
    # update mode: the newest epoch of a bucket holds its state
    out = spark.read.parquet(f"{folder}/out")
    newest = out.groupBy("split", "bucket").agg(F.max_by(F.struct("n_lines", "mean_loss", "last_step", "last_loss"), "epoch").alias("s"))
    return newest.select("split", "bucket", "s.n_lines", six(F.col("s.mean_loss")).alias("mean_loss"), "s.last_step", "s.last_loss")
