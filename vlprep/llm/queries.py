"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vlprep.llm.common import held_out, read_table
from vlprep.llm.oracle import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def tokenizer_path() -> str:
    """The public tokenizer's file, in the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op2_near_duplicates(spark, sf):
    """Contract: 4-word shingles, Jaccard at least 0.8, over the whole of ``documents``."""
    from vlprep.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf, "documents"), n=4).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op4_decontamination(spark, sf):
    """Contract: windows of 13 words; contaminated from a twentieth of the words hit."""
    from vlprep.llm.decontam import contaminated, decontaminate

    found = decontaminate(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


@query
def op5_language(spark, sf):
    """Contract: rows whose crc32(doc_id) mod 4 is 2 teach nothing."""
    from vlprep.llm import langid

    docs = read_table(spark, sf, "documents")
    held = held_out(4, 2)
    model = langid.train(docs.filter(~held))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_token_files(spark, sf):
    """Contract: ids of the whole texts by a public byte-level tokenizer, end id 2, in order of doc_id."""
    from vlprep.llm.tokenfile import token_index

    return token_index(read_table(spark, sf, "documents"), tokenizer_path())


@query
def op1_quality(spark, sf):
    """Contract: labels of rows whose crc32(doc_id) mod 5 is 0 teach nothing; predicted from 0.3."""
    from vlprep.llm import quality

    docs = read_table(spark, sf, "documents")
    held = held_out(5, 0)
    chain = quality.train(docs, read_table(spark, sf, "labels").filter(~held))
    scored = quality.score(docs, chain)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_chat_windows(spark, sf):
    """Contract: all conversations and one more, -7, whose texts hold control strings; read back from the stored windows."""
    from vlprep.llm import chat
    from vlprep.llm.common import stored

    turns = read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    return chat.digests(stored(chat.windows(turns.unionByName(extra)), "windows"))


@query
def op10_mixing(spark, sf):
    """All of ``documents`` at weights of the square roots of the sources' sizes."""
    from vlprep.llm.mixing import mix_sources

    return mix_sources(read_table(spark, sf, "documents").select("doc_id", "source"))


@query
def op3_licences(spark, sf):
    """Licence sentences and licences of all ``documents``."""
    from vlprep.llm.licences import scan

    found = scan(read_table(spark, sf, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


@query
def op8_secrets(spark, sf):
    """Candidates of all ``documents``, judged by a forest trained on findings planted into pieces of their texts."""
    from vlprep.llm.secrets import find_secrets

    return find_secrets(read_table(spark, sf, "documents"))


@query
def op7_embedding_duplicates(spark, sf):
    """Contract: cosine at least 0.98 within a label, over all of ``embeddings``."""
    from vlprep.llm.embdedup import near_duplicate_vectors

    return near_duplicate_vectors(read_table(spark, sf, "embeddings"))


@query
def op11_html_text(spark, sf):
    """Contract: main text of every page, whole."""
    from vlprep.llm.htmltext import extract

    return extract(read_table(spark, sf, "pages"))


@query
def op12_lexical_search(spark, sf):
    """Contract: the 10 best of all ``documents`` for each ``benchmark`` item."""
    from vlprep.llm.search import search

    return search(read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"), k=10)


@query
def op13_hard_negatives(spark, sf):
    """Contract: anchors are ids divisible by 100; ids divisible by 7 get the next label."""
    from vlprep.llm.negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label)


__all__ = ["QUERIES", "SQL", "tokenizer_path"]
