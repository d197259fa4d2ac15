import numpy as np
import pytest
from pyspark.sql import functions as F

from vlprep.operators import similarity
from vlprep.operators.metrics import accuracy
from vlprep.plans.evaluation import zero_shot_report


def vectors(spark, n, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    rows = [(i, a[i].tolist(), b[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "place bigint, image_vec array<double>, text_vec array<double>"), a, b


def brute(a, b, scale):
    z = a @ b.T * scale
    lse = lambda m: np.log(np.exp(m - m.max(axis=1, keepdims=True)).sum(axis=1)) + m.max(axis=1)
    return z, lse(z), lse(z.T)


@pytest.mark.parametrize("n, micro, world, block", [(40, 5, 4, 1024), (40, 5, 4, 7), (33, 16, 1, 5), (64, 64, 1, 16), (1, 4, 1, 2)])
@pytest.mark.parametrize("scale", [1.0, 50.0])
def test_pairs_match_brute_force(spark, n, micro, world, block, scale):
    df, a, b = vectors(spark, n)
    rows = similarity.batch_pairs(similarity.gather_ranks(df, "place", micro, world), scaler=scale, block=block, batch_size=micro * world).collect()
    size = micro * world
    assert len(rows) == n
    for batch in range(-(-n // size)):
        part = slice(batch * size, min((batch + 1) * size, n))
        z, row, col = brute(a[part], b[part], scale)
        got = sorted((r for r in rows if r.batch_id == batch), key=lambda r: r.pos)
        assert [r.pos for r in got] == list(range(len(z)))
        assert [r.own for r in got] == pytest.approx(list(np.diag(z)))
        assert [r.image_lse for r in got] == pytest.approx(list(row))
        assert [r.text_lse for r in got] == pytest.approx(list(col))
        assert [r.best for r in got] == list(z.argmax(axis=1))


def test_loss_of_large_batch_in_tiles(spark):
    df, a, b = vectors(spark, 8192 // 4, dim=4)
    pairs = similarity.batch_pairs(similarity.gather_ranks(df, "place", 2048, 1), block=512, batch_size=2048)
    loss = similarity.contrastive_loss(pairs).collect()
    z, row, col = brute(a, b, np.exp(0.07))
    d = np.diag(z)
    assert len(loss) == 1 and loss[0].loss == pytest.approx(((row - d).mean() + (col - d).mean()) / 2)


def test_pairs_leave_tiles_as_sums_only(spark):
    df, _, _ = vectors(spark, 600)
    pairs = similarity.batch_pairs(similarity.gather_ranks(df, "place", 600, 1), block=200, batch_size=600)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Join" not in plan


def test_report_joins_towers_by_key(spark):
    df, a, b = vectors(spark, 12)
    report = similarity.contrastive_report(
        df.select(F.col("place").alias("key"), "place", "image_vec"), df.select(F.col("place").alias("key"), "text_vec"), 3, 2
    ).collect()
    assert sorted(r.n_pairs for r in report) == [6, 6]


def test_report_normalises_towers(spark):
    df, a, b = vectors(spark, 6)
    stretched = df.withColumn("text_vec", F.transform("text_vec", lambda x: x * (F.col("place") + 1)))
    sides = lambda d: (d.select(F.col("place").alias("key"), "place", "image_vec"), d.select(F.col("place").alias("key"), "text_vec"))
    one, other, raw = (
        similarity.contrastive_report(*sides(d), 6, normalize=n).first().loss for d, n in ((df, True), (stretched, True), (stretched, False))
    )
    assert one == pytest.approx(other) and other != pytest.approx(raw)
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    z, row, col = brute(a, b, np.exp(0.07))
    assert one == pytest.approx(((row - np.diag(z)).mean() + (col - np.diag(z)).mean()) / 2)


@pytest.mark.parametrize("options", [{}, {"class_block": 3}, {"class_block": 1}, {"class_block": 11}])
def test_zero_shot_takes_lowest_label_on_ties(spark, options):
    rng = np.random.default_rng(3)
    images, classes = rng.integers(-2, 3, size=(120, 4)), rng.integers(-2, 3, size=(11, 4))
    df = spark.createDataFrame([(i, images[i].astype(float).tolist(), int(i % 11)) for i in range(120)], "id bigint, embedding array<double>, label int")
    table = spark.createDataFrame([(j, classes[j].astype(float).tolist()) for j in range(11)], "label int, class_vec array<double>")
    out = similarity.zero_shot(df, table, **options)
    expected = (images @ classes.T).argmax(axis=1)
    got = {r.id: (r.predicted, r.score) for r in out.collect()}
    assert got == {i: (int(expected[i]), float((images @ classes.T).max(axis=1)[i])) for i in range(120)}
    row = accuracy(out).first()
    assert row.correct == int((expected == np.arange(120) % 11).sum()) and row.total == 120


def test_null_vectors_have_no_prediction(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id bigint, embedding array<double>")
    table = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 1.0])], "label int, class_vec array<double>")
    for options in ({}, {"class_block": 1}):
        got = {r.id: r.predicted for r in similarity.zero_shot(df, table, **options).collect()}
        assert got == {1: 0, 2: None, 3: 5}


def test_images_are_not_exchanged(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id bigint, embedding array<double>")
    table = spark.createDataFrame([(j, [1.0, float(j)]) for j in range(9)], "label int, class_vec array<double>")
    for options in ({}, {"class_block": 2}):
        out = similarity.zero_shot(df, table, **options)
        assert out.count() == 40
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_accuracy_of_nothing(spark):
    df = spark.createDataFrame([], "predicted bigint, label bigint")
    row = accuracy(df).first()
    assert (row.correct, row.total, row.accuracy) == (0, 0, None)


def test_projection_equals_numpy_and_keeps_nulls(spark):
    df, a, _ = vectors(spark, 30)
    w, b = np.arange(24).reshape(3, 8) / 7, np.array([1.0, 2.0, 3.0])
    holes = df.withColumn("image_vec", F.when(F.col("place") % 5 != 2, F.col("image_vec")))
    got = {r.place: r.projected for r in similarity.project(holes, "image_vec", w, b).collect()}
    for i in range(30):
        if i % 5 == 2:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(list(a[i] @ w.T + b))


def test_float_vectors_are_scored_in_double(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    row = zero_shot_report(df).first()
    e = np.array([r.embedding for r in df.orderBy("vec_id").collect()], dtype=np.float64)
    y = np.array([r.label for r in df.orderBy("vec_id").collect()])
    means = np.stack([e[y == k].mean(axis=0) for k in sorted(set(y))])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    assert row.correct == int((np.array(sorted(set(y)))[(e @ means.T).argmax(axis=1)] == y).sum())


def test_pair_by_key(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2)], "key string, x int")
    right = spark.createDataFrame([("b", 3), ("c", 4)], "key string, y int")
    assert [tuple(r) for r in similarity.pair_by_key(left, right, "key").collect()] == [("b", 2, 3)]
