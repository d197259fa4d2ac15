import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vlprep.llm import search as S
from vlprep.llm.search import Segment, search, term_counts


def terms_of(text):
    lower = (text or "").translate(str.maketrans(S.UPPER, S.LOWER))
    return re.findall(S.TERM, lower)


def brute(docs, items, k=10):
    """The contract in plain Python: every document scored for every item."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n, size = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for (i, c), s in zip(counted, sizes):
            m = 10 + (90 * s * n) // size if size else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_terms():
    text = "Ab-cD ÄB_9x\x00y z 'q' 123 " * 3
    n, counts = term_counts(text.encode())
    assert n == len(terms_of(text)) and {k.decode(): v for k, v in counts.items()} == Counter(terms_of(text))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(random.Random(2).choices(["a", "bb", "ccc", "d" * 50], k=3000)).encode()
    whole = term_counts(text)
    monkeypatch.setattr(S, "PIECE", 64)
    assert term_counts(text) == whole


def corpus(rng, n, vocabulary=400):
    """Words of very different frequency, topics, copies and ties."""
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    docs = []
    for i in range(n):
        topic = rng.randrange(8)
        text = rng.choices(words, weights, k=rng.randint(0, 60)) + rng.choices(words[topic * 40 : topic * 40 + 40], k=rng.randint(0, 30))
        docs.append((i, " ".join(text)))
    docs += [(n + i, docs[3][1]) for i in range(25)]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("short, block, segment, merge", [(256, 128, 250_000, 200_000), (10, 8, 3_000, 60), (0, 3, 700, 200_000)])
def test_against_brute_force(spark, docs_of, monkeypatch, short, block, segment, merge):
    for name, value in {"SHORT_LIST": short, "BLOCK": block, "SEGMENT_POSTINGS": segment, "QUERY_TERMS": merge}.items():
        monkeypatch.setattr(S, name, value)
    rng = random.Random(short)
    docs = corpus(rng, 900)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(400)], k=rng.randint(1, 25)))) for i in range(12)]
    items += [(50, docs[3][1]), (51, "W0 w1 W2"), (52, "w0"), (53, "nothing"), (54, ""), (55, None), (None, "w5 w7")]
    assert rows_of(search(docs_of(docs, 4), items_of(spark, items))) == brute(docs, items)


def test_blocks_are_skipped_and_bounds_hold(monkeypatch):
    monkeypatch.setattr(S, "SHORT_LIST", 128)
    monkeypatch.setattr(S, "BLOCK", 64)
    rng = np.random.default_rng(7)
    n, vocabulary = 2000, 30
    sizes = rng.integers(5, vocabulary, n)
    terms = np.concatenate([np.sort(rng.choice(vocabulary, s, replace=False)) for s in sizes])
    values = rng.integers(1, 1000, len(terms)) * np.where(np.repeat(np.arange(n) % 50 == 0, sizes) & (terms < 10), 50, 1)  # a topic
    segment = Segment.from_row(Segment.build(np.arange(n), sizes, terms, values).to_row())
    wanted = np.zeros(vocabulary, np.int64)
    query = np.array([1, 4, 9])
    wanted[query] = 1
    truth = segment.scores(np.arange(n), wanted)
    short, long = segment.lists(query)
    assert not len(short) and len(long) == 3
    for least in (1, 2000, 60_000, int(truth.max()), int(truth.max()) + 1):
        found = {int(d): int(s) for docs, scores in segment.beyond(short, long, wanted, least) for d, s in zip(docs, scores)}
        assert all(truth[d] == s for d, s in found.items())
        assert set(np.flatnonzero(truth >= least)) <= set(found)
        if least > 50_000:
            assert len(found) < n / 3  # most blocks were skipped
    for i in range(len(segment.block_starts) - 1):
        c = np.searchsorted(segment.list_blocks, i, "right") - 1
        end = min(segment.block_starts[i + 1], segment.list_starts[segment.frequent[c] + 1])
        docs = segment.list_docs[segment.block_starts[i] : end]
        for f, place in enumerate(segment.frequent):
            one = np.zeros(vocabulary, np.int64)
            one[segment.list_terms[place]] = 1
            assert segment.summaries[i, f] == segment.scores(docs, one).max()


def test_odd_rows(spark, docs_of):
    docs = [(1, None), (2, ""), (3, "--- ..."), (None, "alpha beta"), (4, "alpha beta"), (4, "alpha beta"), (4, "gamma"), (5, "Alpha " * 300_000), (6, "delta")]
    items = [(1, "ALPHA"), (1, "gamma"), (2, "beta alpha, beta"), (3, "?"), (4, "delta")]
    got = rows_of(search(docs_of(docs).withColumn("terms", F.lit(1)).withColumn("n", F.lit("x")), items_of(spark, items).withColumn("term", F.lit("y"))))
    assert got == brute(docs, items)
    assert search(docs_of(docs[:3]), items_of(spark, items)).count() == 0
    assert search(docs_of(docs).limit(0), items_of(spark, items)).count() == 0
    assert search(docs_of(docs), items_of(spark, items).limit(0)).count() == 0
