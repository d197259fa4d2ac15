"""Language ID, quality and secrets: what they learn, and odd tables."""

import itertools
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vlprep.llm import langid, quality, secrets

ALPHABETS = {"en": ["the", "th", "er", "ing", "and", "on"], "de": ["sch", "ung", "der", "ä", "ch", "ein"], "fr": ["eau", "é", "tion", "le", "ou", "è"]}


def prose(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def languages(n=240):
    rng = random.Random(2)
    return [(i, prose(rng, ALPHABETS[lang], rng.choice([4, 30, 200])), lang) for i, lang in zip(range(n), itertools.cycle(ALPHABETS))]


def test_language_of_unseen_texts(spark, docs_of):
    rows = languages()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    docs = docs_of(rows)
    model = langid.train(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r["doc_id"]: r for r in langid.identify(docs, model, ["doc_id"]).collect()}
    right = [got[i]["lang_pred"] == lang for i, _, lang in held]
    assert sum(right) >= 0.95 * len(right)
    assert all(0 <= r["score"] <= 1 and r["rejected"] == (r["score"] < langid.REJECT_BELOW) for r in got.values())


def test_language_of_odd_texts(spark, docs_of):
    model = langid.train(docs_of(languages(60)))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "a"), (5, "É"), (None, "the and thing"), (6, "the " * 400_000), (6, "the")]
    got = {(r["doc_id"], r["score"] > 0): r["lang_pred"] for r in langid.identify(docs_of(rows), model, ["doc_id"]).collect()}
    assert got[1, False] == got[2, False] == got[3, False] == "und"
    assert {got[4, True], got[5, True], got[None, True], got[6, True]} <= set(ALPHABETS)
    assert langid.train(docs_of([(1, "text", None), (2, None, "en")])) is None
    assert [r["lang_pred"] for r in langid.identify(docs_of([(1, "text")]), None, ["doc_id"]).collect()] == ["und"]
    assert langid.identify(docs_of([]).limit(0), model, ["doc_id"]).collect() == []
    one = langid.train(docs_of([(i, "only one", "en") for i in range(3)]))
    assert langid.identify(docs_of([(1, "more")]), one, ["doc_id", "text"]).first()["lang_pred"] == "en"


def test_guess_does_not_depend_on_neighbours():
    """Subwords of a text are the same alone and among others."""
    texts = [b"", b"ab", b"the ", b" x  y", "é".encode()]
    slots, owners = langid.subwords(texts)
    for i, t in enumerate(texts):
        alone, _ = langid.subwords([t])
        assert sorted(slots[owners == i].tolist()) == sorted(alone.tolist())


def lines(rng, good, n):
    if good:
        return "\n".join(prose(rng, ALPHABETS["en"], rng.randint(5, 15)) for _ in range(n))
    kind = rng.choice(["shout", "marks"])
    one = lambda: " ".join(w.upper() + "!!" if kind == "shout" else w + "%%%" for w in prose(rng, ALPHABETS["en"], 9).split())
    return "\n".join(one() for _ in range(n))


def test_quality_of_unseen_texts(spark, docs_of):
    rng = random.Random(8)
    rows = [(i, lines(rng, i % 4 > 0, rng.choice([1, 3, 12])), "en") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(240) if i % 3] + [(5, None), (None, 1), (8, 0)], "doc_id long, quality int")
    docs = docs_of(rows)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert min(got[i] for i in range(0, 240, 3) if i % 4) > max(got[i] for i in range(0, 240, 3) if i % 4 == 0)


def test_quality_of_odd_texts(spark, docs_of):
    rng = random.Random(9)
    docs = docs_of([(i, lines(rng, i % 2 > 0, 3)) for i in range(40)])
    chain = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (None, "x"), (4, "one\n" * 20_000), (4, "y" * 1_000_000)]
    got = quality.score(docs_of(rows), chain).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    assert quality.train(docs, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert quality.score(docs_of([(1, "a")]), None).first()["score"] == 0.5


def test_marginals_equal_sums_over_all_labellings():
    rng = np.random.default_rng(3)
    chain = quality.Chain(np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    chain.step = rng.normal(size=(2, 2))
    first = np.array([0, 1, 5, 8])
    lead = rng.normal(size=8)
    good, steps = chain.marginals(lead, first, pairs=True)
    expected, sums = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        weight = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weight[y] = np.exp(sum(lead[a + i] * v for i, v in enumerate(y)) + sum(chain.step[p, q] for p, q in zip(y, y[1:])))
        total = sum(weight.values())
        for y, w in weight.items():
            expected[a:b] += np.array(y) * w / total
            for p, q in zip(y, y[1:]):
                sums[p, q] += w / total
    np.testing.assert_allclose(good, expected, rtol=1e-9)
    np.testing.assert_allclose(steps, sums, rtol=1e-9)


def test_secrets(spark, docs_of):
    rng = random.Random(4)
    code = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hexed, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    rows = []
    for i in range(0, 120, 4):
        rows += [
            (i, f"some text AKIA{code(upper, 16)} more"),
            (i + 1, f'token = "{code(hexed, 40)}" and'),
            (i + 2, f"card {code('0123456789', 16)} paid"),
            (i + 3, f"commit {code(hexed, 40)} fixed"),
        ]
    got = {r["doc_id"]: r for r in secrets.find_secrets(docs_of(rows)).collect()}
    assert {i: r["secret"] for i, r in got.items()} == {i: i % 4 < 2 for i in range(120)}
    value = rows[0][1].split()[2]
    assert rows[0][1][got[0]["begin"] : got[0]["begin"] + got[0]["length"]] == value


def test_secrets_in_odd_texts(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "no candidates here"), (4, "password=abcdef1234567890"), (None, "a1b2c3d4e5f6g7 " * 300)]
    got = secrets.find_secrets(docs_of(rows)).collect()
    assert len([r for r in got if r["doc_id"] == 4]) == 1 and len([r for r in got if r["doc_id"] is None]) == 300
    starts = sorted(r["begin"] for r in got if r["doc_id"] is None)
    assert starts == [15 * k for k in range(300)]
    assert secrets.find_secrets(docs_of([]).limit(0)).collect() == []
    bare = docs_of(rows).select("doc_id", "text").withColumn("value", F.lit(1)).withColumn("label", F.lit(2))
    assert len(secrets.find_secrets(bare).collect()) == 301


def test_secrets_with_a_late_digit(spark, docs_of):
    late = "qWeRtYuIoPaSdFgHjKlZ" * 3 + "7xyzab"
    got = secrets.find_secrets(docs_of([(1, f"token = {late} end"), (2, "x" * 200_000), (3, "y" * 200_000 + "1")])).collect()
    assert sorted((r["doc_id"], r["begin"], r["length"]) for r in got) == [(1, 8, len(late)), (3, 0, 200_001)]


def test_findings_held_back(spark, sf):
    """The forest tells planted findings that it has not seen."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taught = secrets.planted_findings(docs)
    kinds = {r["kind"]: r["count"] for r in taught.groupBy("kind").count().collect()}
    assert len(kinds) == 13 and min(kinds.values()) > 100
    rows = secrets.held_back(secrets.described(taught, secrets.known_words(docs, taught))).select("kind", "label", "secret").collect()
    hit = sum(r["label"] == 1 and r["secret"] for r in rows)
    precision, recall = hit / sum(r["secret"] for r in rows), hit / sum(r["label"] for r in rows)
    print("held back:", len(rows), "precision", precision, "recall", recall)
    assert len(rows) > 500 and precision > 0.95 and recall > 0.95


def test_open_candidates(spark, docs_of):
    """Values assigned to a credential's name, whatever their characters; marks of the sentence are no part of them."""
    texts = {
        1: ("db password: qW!x#zT", "qW!x#zT"), 2: ('SECRET_TOKEN="aBcDeFgHiJk"', "aBcDeFgHiJk"), 3: ("(pwd=Zx9!), then", "Zx9!"), 4: ("api_key => kJh.Gf-Ds.", "kJh.Gf-Ds"),
        5: ("auth:\n  'p@ss:w0rd'", "p@ss:w0rd"), 6: ("passphrase := éàü$ßñ1", "éàü$ßñ1"),
    }
    found = {r["doc_id"]: r for r in secrets.candidates(docs_of([(i, t) for i, (t, _) in texts.items()])).collect()}
    for i, (text, value) in texts.items():
        assert found[i]["value"] == value and text[found[i]["begin"] : found[i]["begin"] + len(value)] == value
    none = docs_of([(1, "the author: someone wrote"), (2, "token"), (3, "password: abc"), (4, "a secret he kept")])
    assert secrets.candidates(none).count() == 0


def test_same_verdict_in_tables_of_other_sizes(spark, docs_of):
    filler = "some words of the text that stand in every document"
    rows = [(0, 'token = "6f1e9a0c44b87d2235f0aa91c3be7d10c2ffab17"'), (1, "card 4742604793956271"), (2, "password: Zr7!kQ#p2"), (3, "password: words of the text")]
    verdicts = []
    for n in (1_000, 20_000):
        got = secrets.find_secrets(docs_of([*rows, *((10 + i, f"{filler} {i}") for i in range(n))])).collect()
        verdicts.append({r["doc_id"]: r["secret"] for r in got})
    assert verdicts[0] == verdicts[1] == {0: True, 1: False, 2: True, 3: False}


def test_language_keeps_columns(spark, docs_of):
    docs = docs_of([(1, "the words of it", "en"), (2, None, None)])
    for c in ("_text", "_lettered", "l0", "l1", "c0"):
        docs = docs.withColumn(c, F.lit(f"mine {c}"))
    got = langid.identify(docs, langid.train(docs), ["doc_id", "_text", "_lettered", "l0", "l1", "c0"]).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["en", "und"] and all(r[c] == f"mine {c}" for r in got for c in ("_text", "_lettered", "l0", "l1", "c0"))
    with pytest.raises(ValueError, match="score"):
        langid.identify(docs.withColumn("score", F.lit(1)), None, ["score"])


WORKERS = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from vlprep.session import local_session
spark = local_session(3, shuffle_partitions=3)
spark.sparkContext.setLogLevel("ERROR")

def here(rows):
    for batch in rows:
        try:
            import vlprep
            found = True
        except ModuleNotFoundError:
            found = False
        batch["id"] = int(found)
        yield batch

assert spark.range(3).mapInPandas(here, "id long").agg({{"id": "max"}}).first()[0] == 0, "workers can import the package"
for name in {names!r}:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count(), flush=True)
"""


@pytest.mark.parametrize("names", [["op1_quality", "op5_language", "op12_lexical_search", "op13_hard_negatives"], ["op4_decontamination", "op6_token_files", "op11_html_text", "op2_near_duplicates"]])
def test_workers_without_the_package(tmp_path, names):
    """The functions reach workers that cannot import the package."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", WORKERS.format(repo=repo, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
