import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vlprep.llm import decontam

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[j : j + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, found = words(text), set()
        mask = [False] * len(w)
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if hit := windows.get(tuple(w[j : j + n])):
                    found |= hit
                    mask[j : j + n] = [True] * n
        out.append((doc, len(w), sum(mask), sorted(found)))
    return sorted(out, key=str)


def result(docs, items):
    rows = decontam.decontaminate(docs, items).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in rows), key=str)


def test_equals_brute_force(spark, docs_of):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(30)] + ["é", "ñandú", "7"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([13, 14, 20, 40, 60, 1, 2, 5, 12, 0])] + [(20, "a a a a a a a a a a a a a a a a a"), (21, None), (22, "V1, v2; V3!")]
    docs = []
    for i in range(60):
        parts = [text(rng.choice([0, 3, 30, 200]))]
        for _ in range(rng.choice([0, 1, 2])):
            own = (rng.choice(items)[1] or "").split()
            begin = rng.randrange(len(own) + 1)
            parts += [" ".join(own[begin : begin + rng.choice([6, 12, 13, 14, 60])]), text(rng.choice([0, 1, 50]))]
        docs.append((i, ", ".join(parts)))
    docs += [(100, None), (101, ""), (102, "... --- !!!"), (103, "a " * 400), (None, items[3][1]), (104, items[2][1]), (104, text(20))]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert result(docs_of(docs), table) == brute(docs, items)


def test_every_shared_span_has_a_fingerprint():
    rng = np.random.default_rng(2)
    for _ in range(200):
        shared = rng.integers(0, 3, 13).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint64), shared, rng.integers(0, 3, 9).astype(np.uint64)])
        b = np.concatenate([rng.integers(0, 3, rng.integers(0, 20)).astype(np.uint64), shared])
        x, y = (set(decontam.fingerprints(v, [])[0].tolist()) for v in (a, b))
        assert x & y


def test_odd_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert result(docs_of([(1, "a b")]), none) == [(1, 2, 0, [])]
    assert result(docs_of([]).limit(0), none) == []
    items = spark.createDataFrame([("x", "one two three")], "item_id string, text string")
    docs = docs_of([(1, "One two three")]).withColumn("hits", F.lit(5)).withColumn("item_id", F.lit(6))
    assert result(docs, items) == [(1, 3, 3, ["x"])]
    spans = decontam.decontaminate(docs, items).first()["spans"]
    assert [(s["begin"], s["end"]) for s in spans] == [(0, 3)]
    long = "z " * 200_000 + "one two three"
    assert result(docs_of([(1, long)]), items) == [(1, 200_003, 3, ["x"])]


def test_runs_of_equal_prints(spark, docs_of):
    """Texts of one word, or of a few in turn: as many places to lay an item as there are words, but few rows."""
    items = [(1, "z " * 1000), (2, "a b " * 200), (3, "q r s " * 30 + "end"), (4, "z z z"), (5, "a b a")]
    docs = [(1, "z " * 20_000), (2, "x " + "a b " * 3000 + "y"), (3, "q r s " * 500 + "end"), (4, "start " + "r s q " * 100), (5, "z " * 12 + "a " * 3), (6, "b " + "z " * 14)]
    docs += [(7, "a b " * 6 + "c " + "b a " * 9), (8, ("z " * 15 + "k ") * 50)]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert result(docs_of(docs), table) == brute(docs, items)
    own = decontam.Words([b"z " * 20_000], decontam.WORD_BYTES).of(0)
    found, first, last, step = decontam.runs(*decontam.fingerprints(own, []))
    assert len(found) == 1 and step[0] == 1


def test_kept_columns(spark, docs_of):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = docs_of([(1, "one two three four")])
    for c in ("hits", "_doc", "l0", "l1", "c0", "ways", "item_id"):
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    got = decontam.decontaminate(docs, items, keep=["hits", "_doc", "l0", "l1", "c0", "ways", "item_id"]).first()
    assert got["n_hit"] == 3 and all(got[c] == f"mine {c}" for c in ("hits", "_doc", "l0", "l1", "c0", "ways", "item_id"))
    with pytest.raises(ValueError, match="n_words"):
        decontam.decontaminate(docs.withColumn("n_words", F.lit(1)), items, keep=["n_words"])


def test_rule(spark):
    rows = spark.createDataFrame([(0, 0), (0, 5), (1, 20), (1, 21), (5, 100)], "n_hit long, n_words long")
    assert [r[0] for r in rows.select(decontam.contaminated()).collect()] == [False, False, True, False, True]
