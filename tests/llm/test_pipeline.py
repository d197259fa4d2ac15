import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
import corpus_pipeline as cp
from test_decontam import brute as contaminated
from test_neardup import brute as duplicates
from vlprep.llm import decontam, langid
from vlprep.llm.queries import QUERIES, SQL, tokenizer_path


def test_registered():
    names = spark_entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(SQL) <= set(names)


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        from vlprep.llm.common import stored

        kept = stored(out, f"test-{name}")
        seen.append((name, docs, kept))
        docs = spark.read.parquet(kept.inputFiles()[0].rsplit("/", 1)[0])
    return seen


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    for _, docs, out in stages[:-1]:
        assert out.columns == docs.columns and [k for _, k in out.dtypes] == [k for _, k in docs.dtypes]


def test_language_stage_keeps_what_has_letters(stages):
    _, docs, out = stages[0]
    gone = ids(docs) - ids(out)
    assert len(gone) <= 0.01 * docs.count()


def test_duplicates_stage_keeps_one_of_each_group(stages):
    _, docs, out = stages[1]
    found = duplicates(texts(docs), 5)
    assert ids(out) == {i for i, (_, c) in found.items() if i == c}


def test_decontamination_stage(stages, spark, sf):
    _, docs, out = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(out) == {i for i, n, hit, _ in contaminated(texts(docs), items) if not (hit > 0 and 20 * hit >= n)}


def test_last_stages_keep_all_in_the_mixed_order(stages, spark, sf):
    from tokenizers import Tokenizer

    from vlprep.llm.mixing import mix_sources

    _, docs, mixed = stages[3]
    order = [r["doc_id"] for r in mix_sources(docs).orderBy("position").collect()]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in stages[4][2].collect())
    assert [d for _, d, _, _ in got] == order
    tokenizer, text, start = Tokenizer.from_file(tokenizer_path()), dict(texts(docs)), 0
    for begin, doc, n, crc in got:
        found = np.array([*tokenizer.encode(text[doc], add_special_tokens=False).ids, 2], "<u4")
        assert (begin, n, crc) == (start, len(found), zlib.crc32(found.tobytes()))
        start += n


def test_ids_on_rows_of_different_texts(spark, docs_of, sf):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = docs_of([(5, a), (9, a), (3, b), (5, b), (6, "one of a kind here"), (6, "another one of its kind there"), (6, "one of a kind here")])
    kept = sorted((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, sf).collect())
    assert kept == sorted([(5, a), (3, b), (6, "one of a kind here"), (6, "another one of its kind there")])
    # both texts of one id in one group: one of them stays
    again = cp.near_duplicates(spark, docs_of([(7, a), (7, a + " x"), (8, a)]), sf).collect()
    assert len(again) == 1 and again[0]["doc_id"] == 7


def test_files_of_one_number_go_by_id(spark, docs_of, sf, tmp_path):
    for rows in ([(i, f"text {i}") for i in range(20)], [(100 - i, f"text {i}") for i in range(20)]):
        docs_of(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    got = cp.write_tokens(spark, spark.read.parquet(f"{tmp_path}/docs"), sf).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [*range(20), *range(81, 101)]


def test_odd_rows_pass_every_stage(spark, docs_of, sf):
    rows = [(1, "the same words here again and again"), (1, "the same words here again and again"), (2, None), (None, "another text with words"), (3, ""), (4, "x" * 200_000)]
    docs = docs_of([(*r, "en", None) for r in rows]).withColumn("position", F.lit(1)).withColumn("hits", F.lit("h")).withColumn("carried_0", F.lit(0))
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if name != "write_tokens":
            assert out.columns == docs.columns
            docs = out
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == [(False, 1), (False, 4), (True, None)]
    empty = docs_of([]).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf).collect() == []


def test_python_gets_some_mb_of_texts_at_a_time(spark, docs_of, sf, monkeypatch):
    def watched(inner):
        def rows(batches, **given):
            def few():
                for batch in batches:
                    if batch.nbytes > 8 << 20:
                        raise ValueError(f"{batch.nbytes} bytes")
                    yield batch

            yield from inner(few(), **given)

        return rows

    for module, name in ((langid, "_guess_rows"), (decontam, "_document_rows"), (decontam, "_verdict_rows")):
        monkeypatch.setattr(module, name, watched(getattr(module, name)))
    docs = docs_of([(i, f"number {i} " + "some words of a long text " * 400, "en") for i in range(1200)], partitions=1)
    for stage in (cp.language_id, cp.decontaminate):
        assert stage(spark, docs, sf).count() == 1200


def test_each_text_of_an_id_is_judged(spark, docs_of, sf):
    bad = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(1, bad), (1, "the same id on other words"), (None, bad), (None, "no id at all on these words"), (2, bad), (2, bad), (3, None)]
    kept = cp.decontaminate(spark, docs_of(rows), sf).collect()
    assert sorted(r["text"] or "" for r in kept) == ["", "no id at all on these words", "the same id on other words"]
    kept = cp.language_id(spark, docs_of([(1, "7 7"), (1, "the same id on other words", "en"), (None, "..."), (None, "no id on these words", "en"), (None, None)]), sf).collect()
    assert sorted(r["text"] for r in kept) == ["no id on these words", "the same id on other words"]
