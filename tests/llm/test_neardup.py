import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vlprep.llm import neardup
from vlprep.llm.common import Words, components, grams

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, n):
    """Shingle counts and components by comparing every pair."""
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for size in [1, 2, 3, 4, 5, 8, 20, 60, 200, 700]:
        for _ in range(6):
            base = [rng.choice(words) for _ in range(size)]
            for copy in range(rng.choice([1, 1, 4])):
                text = list(base)
                for _ in range(copy * max(1, size // 60)):
                    text[rng.randrange(len(text))] = rng.choice(words)
                rows.append((i, rng.choice([" ", "\t", " \n "]).join(text)))
                i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, " \n\t "), (i + 3, rows[30][1].upper())]


@pytest.mark.parametrize("n", [4, 5])
def test_equals_brute_force(spark, docs_of, n):
    rows = corpus()
    got = neardup.near_duplicates(docs_of(rows), n=n).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows, n)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_chains_through_a_crowd(spark, docs_of):
    """Steps of a few words: neighbours link, ends don't; all of it is one component."""
    words = [f"x{i}" for i in range(300)]
    rows = [(1000 - k, " ".join(words[k * 5 : k * 5 + 200])) for k in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(rows), n=4).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4).items()}
    assert set(got.values()) == {981}


def test_odd_tables(spark, docs_of):
    assert neardup.near_duplicates(docs_of([]).limit(0)).collect() == []
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (9, "A B C D E F")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs_of(rows)).collect()), key=str)
    assert got == [(7, 7, True), (7, 7, True), (9, 7, False), (None, None, True)]
    clash = docs_of(rows[:1]).withColumn("sketch", F.lit(1)).withColumn("band", F.lit(2)).withColumn("class_id", F.lit(3))
    assert len(neardup.near_duplicates(clash).collect()) == 1


def test_ids_on_rows_of_different_texts(spark, docs_of):
    """Every row goes by its own text: what one text of an id links with does not touch the other's links."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (9, a), (3, b), (5, b), (4, b + " x"), (7, c), (7, c + " y"), (2, "a0 a1 a2"), (2, None)]
    got = neardup.near_duplicates(docs_of(rows), n=4).select("doc_id", "component_id", "kept", "group_id", "n_shingles").collect()
    by = {(r["doc_id"], r["n_shingles"], r["component_id"]): r for r in got}
    # 5 and 9 by text a; 3, 4 and 5 by text b; both texts of 7
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [
        (2, 2, True), (2, 2, True), (3, 3, True), (4, 3, False), (5, 3, False), (5, 5, True), (7, 7, True), (7, 7, True), (9, 5, False),
    ]
    groups = {(r["doc_id"], r["component_id"]): r["group_id"] for r in got if r["group_id"] is not None}
    assert groups[5, 5] == groups[9, 5] != groups[5, 3] == groups[3, 3] == groups[4, 3] and len(by) == 9


def test_an_id_on_texts_that_link_each_elsewhere(spark, docs_of):
    words = lambda x, n=40: " ".join(f"{x}{i}" for i in range(n))
    rows = [(1, words("p")), (1, words("q")), (1, words("r")), (20, words("p") + " z"), (30, words("q") + " z"), (40, words("r") + " z")]
    got = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs_of(rows), n=4).collect()}
    assert got == {(1, 1), (20, 1), (30, 1), (40, 1)}
    groups = neardup.near_duplicates(docs_of(rows), n=4).select("group_id").distinct().count()
    assert groups == 3


def test_sketch_estimates_jaccard():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8, 0.95):
        a = rng.integers(0, 2**64, 5000, dtype=np.uint64)
        same = int(2 * len(a) * share / (1 + share))
        b = np.concatenate([a[:same], rng.integers(0, 2**64, len(a) - same, dtype=np.uint64)])
        x, y = (neardup.sketch(np.unique(v))[None] for v in (a, b))
        found, used = neardup.estimate(x, y)
        assert used[0] == neardup.BUCKETS
        assert abs(found[0] - share) < 5 * np.sqrt(share * (1 - share) / neardup.BUCKETS) + 0.01


def test_sketch_keeps_zeros_and_mantissa():
    rest = (1 << 40) + (0b101 << 37)  # 23 leading zeros in the fraction of bucket 0
    value = -(-rest // neardup.BUCKETS)
    register = int(neardup.sketch(np.array([value], np.uint64))[0]) - 1
    exact = value * neardup.BUCKETS
    assert register >> neardup.MANTISSA == 64 - exact.bit_length()
    mask = (1 << neardup.MANTISSA) - 1
    assert register & mask == (exact >> (exact.bit_length() - 1 - neardup.MANTISSA)) & mask


def test_words_of_long_and_empty_texts():
    long = b"y" * 3_000_000
    words = Words([b"", b"Ab  cD", long, b"ab"], neardup.WORD_BYTES)
    assert [len(words.of(i)) for i in range(4)] == [0, 2, 1, 1]
    assert words.of(1)[0] == words.of(3)[0]
    assert len(grams(words.of(1), 3)) == 0
    assert Words.count([b"", b"Ab  cD", long, b"ab"], neardup.WORD_BYTES).tolist() == [0, 2, 1, 1]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, k) for k in range(501, 560)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["id"]: r["component_id"] for r in got} == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}
