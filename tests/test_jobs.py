import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from vlprep.operators import generation, metrics, tokens, udf
from vlprep.operators.filters import disjoint
from vlprep.plans.queries import QUERIES
from vlprep.streaming import jobs

TEXTS = "id bigint, text string"


def drop(spark, rows, path, name):
    spark.createDataFrame(rows, TEXTS).coalesce(1).write.parquet(f"{path}/{name}")


def source(spark, path):
    return spark.readStream.schema(TEXTS).parquet(f"{path}/*")


def test_stream_prepare_equals_batch(spark, tmp_path):
    first, second = [(i, "w " * (i % 5)) for i in range(20)], [(20 + i, "w " * 130) for i in range(3)] + [(30, "ok then")]
    drop(spark, first, tmp_path / "in", "a")
    args = (f"{tmp_path}/out", f"{tmp_path}/state")
    jobs.stream_prepare(source(spark, tmp_path / "in"), *args).awaitTermination()
    drop(spark, second, tmp_path / "in", "b")
    jobs.stream_prepare(source(spark, tmp_path / "in"), *args).awaitTermination()
    expected = tokens.caption_tokens(spark.createDataFrame(first + second, TEXTS), "text")
    got = spark.read.parquet(args[0])
    assert sorted(got.select("id", "tokens").collect()) == sorted(expected.select("id", "tokens").collect())


def test_stream_disjoint_equals_batch(spark, tmp_path):
    used = spark.createDataFrame([(0, "B"), (1, "b ")], TEXTS)
    rows = [(1, "a"), (2, " b"), (3, "c"), (4, "B")]
    drop(spark, rows, tmp_path / "in", "a")
    jobs.stream_disjoint(source(spark, tmp_path / "in"), used, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    expected = disjoint(spark.createDataFrame(rows, TEXTS), used)
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(expected.collect())


def test_stream_batches_carry_the_open_batch_and_survive_a_replay(spark, tmp_path):
    folder = f"{tmp_path}/out"
    run = lambda: jobs.stream_batches(source(spark, tmp_path / "in"), folder, f"{tmp_path}/state", "id", 8).awaitTermination()
    drop(spark, [(i, "x") for i in range(21)], tmp_path / "in", "a")
    run()
    assert jobs.complete_batches(spark, folder, 8).count() == 16
    drop(spark, [(100 + i, "x") for i in range(12)], tmp_path / "in", "b")
    run()
    whole = lambda: sorted((r.batch_id, r.pos, r.id) for r in jobs.complete_batches(spark, folder, 8).collect())
    got = whole()
    assert [(b, p) for b, p, _ in got] == [(i // 8, i % 8) for i in range(32)]
    # the third batch holds the five left over and the first three of the second drop
    assert [i for b, _, i in got if b == 2] == [16, 17, 18, 19, 20, 100, 101, 102]
    jobs.append_batches(spark, spark.createDataFrame([(100 + i, "x") for i in range(12)], TEXTS), 1, "id", 8, folder, jobs.batch_owner(spark, folder))
    assert whole() == got
    # another checkpoint may not go on, nor begin anew, in the same folder
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        jobs.stream_batches(source(spark, tmp_path / "in"), folder, f"{tmp_path}/other", "id", 8).awaitTermination()
    with pytest.raises(ValueError, match="another checkpoint"):
        jobs.append_batches(spark, spark.createDataFrame([(1, "x")], TEXTS), 0, "id", 8, folder, "other")
    with pytest.raises(ValueError, match="lacks epoch 6"):
        jobs.append_batches(spark, spark.createDataFrame([(1, "x")], TEXTS), 7, "id", 8, folder, jobs.batch_owner(spark, folder))
    assert whole() == got


def test_padded_complete_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1] * (i % 3 + 1)) for i in range(7)], "id bigint, ids array<int>")
    jobs.append_batches(spark, rows, 0, "id", 3, f"{tmp_path}/o")
    out = jobs.complete_batches(spark, f"{tmp_path}/o", 3, "ids").collect()
    assert len(out) == 6 and all(len(r.input_ids) == 3 and sum(r.attention_mask) == len(r.ids) for r in out)


def test_run_log_stream_updates_changed_buckets(spark, tmp_path):
    seen = {}

    def sink(changed, epoch):
        for r in changed.collect():
            seen[r.split, r.bucket] = (epoch, r.n_lines, r.mean_loss, r.last_step, r.last_loss)

    run = lambda: jobs.stream_run_log(spark, f"{tmp_path}/log", sink, f"{tmp_path}/state", 10).awaitTermination()
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.txt").write_text("0 train 4.0\n5 train 2.0\n0 val 9.0\nbroken line\n")
    run()
    first = seen["train", 0][0]
    (tmp_path / "log" / "b.txt").write_text("9 train 3.0\n10 train 1.0\n10 val 7.0\n")
    run()
    assert seen["train", 0][1:] == (3, 3.0, 9, 3.0) and seen["train", 0][0] > first
    assert seen["train", 1][1:] == (1, 1.0, 10, 1.0) and seen["val", 0][0] == first
    lines = spark.read.text(f"{tmp_path}/log")
    metrics_now = jobs.run_log_metrics(lines, 10)
    assert metrics_now.count() == len(seen)
    assert tuple(jobs.latest_validation(metrics_now).first()) == (10, 7.0)


def test_losses(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (0, 2, 99.0), (1, 3, 5.0)], "event int, step bigint, loss double")
    assert {r.event: (r.n_batches, r.mean_loss) for r in metrics.mean_loss(df, "event", "step", "loss", 2).collect()} == {0: (2, 2.0), 1: (1, 5.0)}
    assert {r.step: r.loss for r in metrics.accumulate_loss(df, "step", "loss", 2).collect()} == {0: 2.0, 1: 52.0}
    ranks = spark.createDataFrame([(0, 0, 1.0), (0, 0, 1.0), (0, 1, 4.0)], "step int, rank int, loss double")
    assert tuple(metrics.rank_mean(ranks, "step", "rank", "loss").first()) == (0, 2, 3.0)


@pytest.mark.parametrize("n, last, kept", [(11, True, [0, 4, 8, 10]), (11, False, [0, 4, 8]), (9, True, [0, 4, 8]), (0, True, [])])
def test_every_k(spark, n, last, kept):
    assert sorted(r.id for r in metrics.every_k(spark.range(n), "id", 4, last).collect()) == kept


def test_step_budget_and_report(spark):
    df = spark.createDataFrame([("a", i) for i in range(35)] + [("b", 5)], "shard string, n int")
    assert {r.shard: (r.n_rows, r.n_batches, r.n_steps) for r in metrics.step_budget(df, "shard", 4, 2, 3).collect()} == {"a": (35, 8, 12), "b": (1, 0, 0)}
    row = metrics.dataset_report(df, "shard", "n").filter("shard = 'a'").first()
    assert (row.n_samples, row.total_len, row.min_len, row.max_len) == (35, 595, 0, 34)


def test_masked_mean_without_labels_is_null(spark):
    df = spark.createDataFrame([([1.0, 2.0], [-100, 3]), ([4.0, 8.0], [1, 1])], "l array<double>, y array<int>")
    row = metrics.masked_mean(df, "l", "y").first()
    assert (row.n_tokens, row.loss) == (3, pytest.approx(14 / 3))
    assert metrics.masked_mean(df.withColumn("y", F.array(F.lit(-100), F.lit(-100))), "l", "y").first().loss is None


def test_user_functions(spark):
    df = spark.range(6).withColumn("s", F.lit("x"))
    out = udf.map_columns(df, {"id": lambda c: c + 1, "s": lambda s: s.str.upper()}, types={"s": "string"})
    assert [tuple(r) for r in out.collect()] == [(i + 1, "X") for i in range(6)]
    assert [r.id for r in df.transform(lambda d: udf.where_fn(d, lambda v: v % 2 == 1, "id")).collect()] == [1, 3, 5]
    assert udf.where_fn(df, F.col("id") > 3).count() == 2


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    folder = str(tmp_path)

    def loader():
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda pdf: np.stack([pdf["id"], pdf["id"] * 2], axis=1)

    df = spark.range(0, 50_000, 1, 2)
    out = udf.embed_table(df, loader, ["id"], ["id"]).collect()
    assert all(r.embedding == [r.id, r.id * 2] for r in out) and len(list(tmp_path.iterdir())) <= 2


@pytest.fixture
def chain():
    """Loader of a model: the next id is one more; id 5 is the stop."""

    def loader():
        def step(rows):
            z = np.zeros((len(rows), 8))
            z[np.arange(len(rows)), [(r[-1] + 1) % 8 for r in rows]] = 9.0
            return z

        return step

    return loader


def test_generation_stops_before_the_stop_id(spark, chain):
    df = spark.createDataFrame([(1, [3]), (2, [5, 6]), (3, [0])], "id bigint, ids array<int>")
    got = {r.id: (r.output_ids, r.finish_index) for r in generation.generate_table(df, "id", "ids", chain, 5, max_steps=4).collect()}
    assert got == {1: ([3, 4], 2), 2: ([5, 6, 7, 0, 1, 2], None), 3: ([0, 1, 2, 3, 4], None)}


def test_drawn_generation_does_not_depend_on_grouping(spark, chain):
    df = spark.range(40).select("id", F.array((F.col("id") % 8).cast("int")).alias("ids"))
    run = lambda d, n: sorted(generation.generate_table(d, "id", "ids", chain, 5, 4.0, 6, 1, n).collect())
    assert run(df, 256) == run(df.repartition(5), 3)


def test_generation_cut_operator(spark):
    df = spark.createDataFrame([([1, 7, 2, 7, 3], [1, 1, 1, 1, 0], 2)], "ids array<int>, m array<int>, p int")
    row = generation.truncate_generation(df, "ids", "m", "p", 7).first()
    assert row.answer_ids == [1, 7, 2] and row.finish_index == 3


@pytest.mark.parametrize("by", [None, "source"])
@pytest.mark.parametrize("name", ["stream_prepare", "stream_disjoint", "stream_batches"])
def test_streamed_tables_may_be_folders(spark, tmp_path, name, by):
    rows = [(i, f"w {i // 2}" * (i % 4 > 0), "ab"[i % 2]) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    (docs.write.partitionBy(by) if by else docs.write).parquet(f"{tmp_path}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet-old")
    docs.filter("doc_id < 20").select("doc_id").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    if name == "stream_prepare":
        assert sorted(r.doc_id for r in got) == [i for i in range(100) if i % 4]
    elif name == "stream_disjoint":
        used = {rows[i][1] for i in range(20)}
        assert sorted(r.doc_id for r in got) == [i for i, text, _ in rows if text not in used]
    else:
        assert sorted(map(tuple, got)) == [(i, i // 48, i % 48) for i in range(96)]
