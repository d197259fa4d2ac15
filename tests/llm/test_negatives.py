import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vlprep.llm import negatives
from vlprep.llm.negatives import hard_negatives, primes, products, reconstruct, residues

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, positives=5, wanted=10):
    """The contract in plain Python, over (id, vector, label)."""
    fit = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if None not in (i, v, c) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, av, ac in {(i, tuple(v), c) for i, v, c in fit if i % 100 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, c) for i, v, c in fit)
        for s, p, c in [t for t in scored if t[2] == ac and t[1] != a][:positives]:
            far = [t for t in scored if t[2] != ac and 30 * -s <= 100 * -t[0] <= 90 * -s][:wanted]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(far)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for size, top in ((1, 5), (64, 300), (64, 10**6), (768, 2**20), (3, 2**29)):
        a, b = rng.integers(-top, top + 1, (17, size)), rng.integers(-top, top + 1, (23, size))
        a[0], b[0], b[1] = top, top, -top
        bound = size * top * top
        moduli = primes(size, bound)
        assert math.prod(moduli) > 4 * bound and size * (max(moduli) // 2) ** 2 <= negatives.EXACT
        got = products([residues(a, p) for p in moduli], [residues(b, p) for p in moduli], moduli)
        want = a.astype(object) @ b.astype(object).T
        assert (got.astype(object) == want).all()


def test_reconstruct_small():
    moduli = [7, 5, 3]
    for x in range(-26, 27):
        assert reconstruct([np.array([x % p]) for p in moduli], moduli)[0] == x


def test_too_large_fails():
    with pytest.raises(ValueError):
        primes(1 << 24, 1 << 60)


def data(rng, n, size=8, labels=3):
    x = rng.normal(size=(n, size))
    x[: n // 3] = x[0] + 0.2 * rng.normal(size=(n // 3, size))  # a crowd
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(int(i), v.tolist(), int(c)) for i, v, c in zip(rng.permutation(n) + 1, x, rng.integers(0, labels, n))]


@pytest.mark.parametrize("tile, anchor_bytes", [(1024, 8 << 20), (7, 300)])
def test_against_brute_force(spark, monkeypatch, tile, anchor_bytes):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", anchor_bytes)
    rng = np.random.default_rng(tile)
    rows = data(rng, 700)
    rows += [(10_000 + i, rows[5][1], i % 3) for i in range(40)]  # ties, an anchor among them
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = rows_of(hard_negatives(df))
    assert got == brute(rows) and len(got) > 100


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = data(rng, 300, labels=2)
    nan, inf = float("nan"), float("inf")
    odd = [(None, rows[0][1], 1), (900, None, 1), (901, rows[0][1], None), (902, [nan] * 8, 0), (903, [inf] + [0.0] * 7, 0), (904, [None] * 8, 1)]
    odd += [(905, [], 0), (1000, [], 1), (906, rows[0][1][:3], 1), (100, [30.0, -20.5] * 4, 0), (-100, rows[7][1], 1), (-100, rows[7][1], 1), rows[11], rows[11]]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    assert rows_of(hard_negatives(df)) == brute(rows + odd)
    assert hard_negatives(df.limit(0)).count() == 0
    assert hard_negatives(df.filter("vec_id = 100")).count() == 0
    assert hard_negatives(df.filter("vec_id = 101")).count() == 0


def test_own_anchors_and_window(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.5, 0.0], 1), (4, [0.25, 0.9], 1), (5, [0.95, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(hard_negatives(df, F.col("vec_id") == 1, positives=1, negatives=2, window=(20, 60)))
    assert got == [(1, 2, 1, 3, 65536, 32768), (1, 2, 2, 4, 65536, 16384)]
