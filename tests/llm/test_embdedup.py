import numpy as np

from vlprep.llm import embdedup


def table(spark, rows, kind="array<float>"):
    return spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int").repartition(3)


def brute(rows, threshold=0.98):
    good = {}
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good[i] = (label, len(v), x / np.linalg.norm(x))
    parent, links = {i: i for i, _, _ in rows}, dict.fromkeys((i for i, _, _ in rows), 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(good)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if good[a][:2] == good[b][:2] and good[a][2] @ good[b][2] >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i, _, _ in rows}


def vectors(n=700, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=24).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    for i in range(n, n + 150):  # near ones, some of another label
        _, base, label = rows[int(rng.integers(0, 60))]
        rows.append((i, (np.array(base) + rng.normal(size=24) * rng.choice([0, 0.02, 0.15, 0.25])).tolist(), int(rng.choice([label, label, 1]))))
    centre = rng.normal(size=24)
    rows += [(i, (centre * rng.uniform(0.5, 2) + rng.normal(size=24) * 0.02).tolist(), 2) for i in range(n + 150, n + 350)]  # a dense crowd
    return rows


def test_equals_brute_force(spark):
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in vectors()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_duplicate_vectors(table(spark, rows)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.99 * true
    assert all(got[i][0] <= want[i][0] for i in want)


def test_odd_vectors(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, one, 0), (2, [2.0, 4.0, 6.0], 0), (3, one, 1), (4, one, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0),
        (8, [1.0, float("nan"), 3.0], 0), (9, [float("inf"), 2.0, 3.0], 0), (10, [1.0, 2.0], 0), (11, [], 0), (12, one, 0), (13, [-0.0, 1.0, 0.0], 5),
        (14, [0.0, 1.0, -0.0], 5), (15, [1e30, 2e30, 3e30], 7), (16, [1e-30, 2e-30, 3e-30], 7),
    ]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_duplicate_vectors(table(spark, rows)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(rows).items()}
    assert embdedup.near_duplicate_vectors(table(spark, [])).collect() == []
    twice = embdedup.near_duplicate_vectors(table(spark, [(1, one, 0), (1, one, 0), (None, one, 0)])).collect()
    assert sorted(((r["vec_id"], r["n_links"]) for r in twice), key=str) == [(1, 1), (1, 1), (None, 0)]


def test_equal_vectors_in_numbers(spark):
    rows = [(i, [1.0, 0.5, 0.25], 0) for i in range(3000)]
    got = embdedup.near_duplicate_vectors(table(spark, rows)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(2999, 0)}


def crowd(rng, centre, n, spread):
    noise = rng.normal(size=(n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return np.cos(spread) * centre + np.sin(spread) * noise


def two_crowds(n=60, d=64, seed=1, apart=0.985):
    """Vectors of two crowds of one label: all cosines inside a crowd above those across, which are about ``apart``."""
    rng = np.random.default_rng(seed)
    a, b = np.linalg.qr(rng.normal(size=(d, 2)))[0].T
    spread = np.arccos(0.998) / np.sqrt(2)
    return np.vstack([crowd(rng, a, n, spread), crowd(rng, apart * a + np.sqrt(1 - apart**2) * b, n, spread)])


def test_crowds_that_fill_their_lists(spark):
    x = two_crowds()
    rows = [(i, [float(np.float32(v)) for v in row], 0) for i, row in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_duplicate_vectors(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_crossings_join_crowds(spark, monkeypatch):
    x = np.vstack([two_crowds(), two_crowds(seed=2, apart=0.9)])
    vec = [v / np.linalg.norm(v) for v in x]
    coded = spark.createDataFrame([(i, i // 120, bytearray(v.tobytes())) for i, v in enumerate(vec)], "node long, part long, exact binary")
    pairs = [(i, j) for i in range(240) for j in range(i) if i // 60 == j // 60]
    close = spark.createDataFrame(pairs, "a long, b long")
    found = spark.createDataFrame([(i, i // 60 * 60) for i in range(240)], "id long, component_id long")
    for tile in (1024, 16):
        monkeypatch.setattr(embdedup, "TILE", tile)
        links = {(r["a"], r["b"]) for r in embdedup._crossings(coded, close, found, 0.98).collect()}
        assert links and {(a // 60, b // 60) for a, b in links if a // 60 != b // 60} == {(1, 0)}


def test_labels_the_search_misses_are_compared_whole(spark, monkeypatch):
    for name, value in {"ROUNDS": 1, "LEAST_TABLES": 1, "MISSED": 0.9, "LEAF": 2}.items():
        monkeypatch.setattr(embdedup, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 24))
    rows = [(i, [float(np.float32(v)) for v in row], i % 2) for i, row in enumerate(np.vstack([x, x + rng.normal(size=x.shape) * 0.12]))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_duplicate_vectors(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_labels_with_few_pairs_are_not_compared_whole(spark, monkeypatch):
    seen = []
    original = embdedup.stored
    monkeypatch.setattr(embdedup, "stored", lambda df, name: seen.append(name) or original(df, name))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[5990:] = x[:10] + 0.1 * rng.normal(size=(10, 32)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_duplicate_vectors(table(spark, rows)).collect()}
    assert "whole-parts" not in seen and "failed-parts" in seen
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = {i for i in range(10) if unit[i] @ unit[5990 + i] >= 0.98}
    assert len(pairs) > 5
    assert got == {i: (1, i if i < 10 else i - 5990) if (i if i < 10 else i - 5990) in pairs else (0, i) for i in range(6000)}


def test_tables_follow_the_angle():
    for bits in range(25):
        n = embdedup.tables_for(bits, 0.98)
        miss = (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** n
        assert n >= 8 and miss <= 1e-3 and n < 60
