import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vlprep.functions.keys import hash_key
from vlprep.operators import batching, ranking, shuffles, split

SIZES = [(0, False), (1, True), (10, True), (11, False), (500, True), (500, False)]


def ids(spark, n, seed=0):
    values = random.Random(seed).sample(range(-(10**12), 10**12), n)
    return spark.createDataFrame([(v,) for v in values], "id bigint")


@pytest.mark.parametrize("n, dear", SIZES)
def test_integer_rank(spark, n, dear):
    df = ids(spark, n)
    got = {r.id: r.pos for r in ranking.exact_rank(df, "id", dear=dear).collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))} and len(got) == n


@pytest.mark.parametrize("n, dear", SIZES)
def test_hash_rank_does_not_depend_on_partitions(spark, n, dear):
    df = ids(spark, n).withColumn("k", hash_key(3, "id"))
    ranks = [{r.id: r.pos for r in ranking.exact_rank(df.repartition(p), "k", dear=dear).collect()} for p in (1, 7)]
    keys = {r.id: r.k for r in df.collect()}
    assert ranks[0] == ranks[1] == {v: i for i, v in enumerate(sorted(keys, key=keys.get))}


def test_clustered_integers_fill_many_buckets(spark):
    # one far outlier must not put the others into a single range
    df = spark.range(20_000).union(spark.createDataFrame([(10**18,)], "id bigint"))
    add = ranking.int_buckets(df, "id", 64)
    largest = add(df).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert largest < 1000


def test_more_ranges_for_more_rows(spark):
    df = spark.range(30_000).select((F.col("id") * F.col("id")).alias("id"))
    counts = [ranking.int_buckets(df, "id", 16, r)(df).groupBy("_bucket").count() for r in (10**6, 100)]
    assert counts[0].count() == 16 and 200 < counts[1].count() <= 16 * 19
    assert counts[1].agg(F.max("count")).first()[0] < 1000


def test_dear_rank_computes_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(pdf):
        for p in pdf:
            seen.add(len(p))
            yield p

    df = spark.range(100).mapInPandas(count, "id bigint").withColumn("k", hash_key(1, "id"))
    assert ranking.exact_rank(df, "k", dear=True).agg(F.sum("pos")).first()[0] == 99 * 50
    assert seen.value == 100


def test_rank_rejects_other_types(spark):
    with pytest.raises(ValueError):
        ranking.exact_rank(spark.range(1).withColumn("x", F.lit(1.5)), "x")


@pytest.mark.parametrize("width", [None, 4, 1000])
def test_rank_in_group_with_a_hot_group(spark, width):
    rows = [("hot", i * 3) for i in range(500)] + [(f"g{i % 40}", i) for i in range(200)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t bigint")
    got = ranking.rank_in_group(df, "g", "t", width=width).collect()
    expected = {}
    for g in {g for g, _ in rows}:
        expected.update({(g, t): i for i, t in enumerate(sorted(t for h, t in rows if h == g))})
    assert {(r.g, r.t): r.pos for r in got} == expected


def test_name_index_range_path_equals_sorted_path(spark, monkeypatch):
    import vlprep.session

    names = spark.createDataFrame([(f"shard-{i * 37 % 101:04d}",) for i in range(101)], "s string")
    plain = {r.s: r.i for r in ranking.name_index(names, "s", "i").collect()}
    monkeypatch.setattr(vlprep.session, "fits", lambda df, rows=0: False)
    ranged = {r.s: r.i for r in ranking.name_index(names, "s", "i").collect()}
    assert plain == ranged == {s: i for i, s in enumerate(sorted(plain))}


def test_running_start(spark):
    df = spark.range(300).withColumn("w", F.col("id") % 7).withColumn("k", hash_key(0, "id"))
    rows = sorted(ranking.running_start(df, "k", "w").collect(), key=lambda r: r.k)
    total = 0
    for r in rows:
        assert r.start == total
        total += r.w


def test_argmax_takes_lowest_index_on_ties(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 5.0), (1, 2, 5.0), (2, 3, -1.0)], "k int, i bigint, s double")
    assert {r.k: r.best for r in ranking.argmax_by(df, "k", "s", "i").collect()} == {1: 1, 2: 3}


def test_take_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    out = ranking.take_per_group(df, "g", "id", 4)
    assert sorted(r.id for r in out.collect()) == list(range(12))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 4, Partial" in plan


@pytest.mark.parametrize("n, dear", SIZES)
@pytest.mark.parametrize("drop_last", [False, True])
def test_batches_hold_every_row_once(spark, n, drop_last, dear):
    rows = batching.assign_batches(ids(spark, n), "id", 10, drop_last, dear).collect()
    assert len(rows) == (n - n % 10 if drop_last else n)
    assert sorted((r.batch_id, r.pos) for r in rows) == [(i // 10, i % 10) for i in range(len(rows))]
    assert [r.id for r in sorted(rows, key=lambda r: (r.batch_id, r.pos))] == sorted(r.id for r in rows)


def test_large_batch_size(spark):
    rows = batching.assign_batches(spark.range(20_000), "id", 8192).groupBy("batch_id").count().collect()
    assert {r.batch_id: r["count"] for r in rows} == {0: 8192, 1: 8192, 2: 20_000 - 2 * 8192}


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51, 61])
def test_positional_split_sizes(spark, n):
    rows = split.positional_split(ids(spark, n), "id", val=50, seed=2).collect()
    by = {s: {r.id for r in rows if r.split == s} for s in ("val", "test", "train")}
    assert sum(map(len, by.values())) == len(rows) == n
    assert len(by["val"]) == min(n, 50) and len(by["test"]) == max(n - 50, 0) // 10
    assert by["val"] == set(sorted(r.id for r in rows)[:50])


def test_head_and_tail(spark):
    df = ids(spark, 40)
    head = {r.id for r in split.head_rows(df, "id", 15).collect()}
    tail = {r.id for r in split.tail_from(df, "id", 15).collect()}
    everything = sorted(head | tail)
    assert head == set(everything[:15]) and len(tail) == 25


def shards(spark):
    rows = [("hot", i) for i in range(300)] + [(f"s{i % 9}", 300 + i) for i in range(150)]
    return spark.createDataFrame(rows, "shard string, id bigint")


def test_shuffle_positions_match_the_sorted_shuffle(spark):
    df = ids(spark, 200)
    listed = [r.id for r in shuffles.shuffle(df, "id", 5).collect()]
    placed = sorted(shuffles.shuffle_positions(df, "id", 5).collect(), key=lambda r: r.pos)
    assert listed == [r.id for r in placed] and listed != sorted(listed)


def test_shard_shuffle_keeps_rows_of_a_shard_together_and_in_order(spark):
    rows = sorted(shuffles.shuffle_shards(shards(spark), "shard", "id", 4).collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(450))
    runs = [rows[0].shard] + [b.shard for a, b in zip(rows, rows[1:]) if a.shard != b.shard]
    assert len(runs) == len(set(runs)) == 10 and runs != sorted(runs)
    assert all(a.id < b.id for a, b in zip(rows, rows[1:]) if a.shard == b.shard)


def test_buffer_shuffle_moves_rows_inside_their_block_only(spark):
    df = spark.range(95).select("id", F.col("id").alias("place"))
    rows = shuffles.buffer_shuffle(df, "place", "id", 1, size=10).collect()
    assert sorted(r.pos for r in rows) == list(range(95))
    assert all(r.pos // 10 == r.place // 10 for r in rows) and any(r.pos != r.place for r in rows)


def test_batch_shuffle_keeps_batches_whole(spark):
    df = batching.assign_batches(spark.range(100), "id", 8)
    a = {r.batch_id: r.batch_pos for r in shuffles.shuffle_batches(df, "batch_id", seed=1, epoch=0).collect()}
    b = {r.batch_id: r.batch_pos for r in shuffles.shuffle_batches(df, "batch_id", seed=1, epoch=1).collect()}
    assert a == {r.batch_id: r.batch_pos for r in shuffles.shuffle_batches(df, "batch_id", 13, seed=1).collect()}
    assert sorted(a.values()) == list(range(13)) == sorted(b.values()) and a != b


def test_epochs_cover_all_rows_with_new_keys(spark):
    rows = shuffles.epochs(spark.range(20), "id", 3, 0).collect()
    assert len(rows) == 60 and len({r.epoch_key for r in rows}) == 60


def test_shard_split_is_disjoint_and_complete(spark):
    rows = split.split_shards(shards(spark), "shard", 0.4, 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, set()).add(r.split)
    assert len(rows) == 450 and all(len(s) == 1 for s in by.values())
    assert {s for group in by.values() for s in group} == {"train", "val"}


def test_rank_assignment(spark):
    rows = split.assign_ranks(shards(spark), "shard", 4, 2).select("shard", "shard_idx", "rank", "worker").distinct().collect()
    assert {r.shard: r.shard_idx for r in rows} == {s: i for i, s in enumerate(sorted(r.shard for r in rows))}
    assert all(r.rank == r.shard_idx % 4 and r.worker == r.shard_idx // 4 % 2 for r in rows)


def test_resampling_repeats_whole_shards(spark):
    df = shards(spark)
    rows = split.resample_shards(df, "shard", 25, 1).collect()
    sizes = {r.shard: r["count"] for r in df.groupBy("shard").count().collect()}
    draws = {}
    for r in rows:
        draws.setdefault(r.draw, []).append(r.shard)
    assert sorted(draws) == list(range(25))
    assert all(len(set(s)) == 1 and len(s) == sizes[s[0]] for s in draws.values())


def test_resampling_without_broadcast_is_the_same(spark, monkeypatch):
    import vlprep.session as session

    plain = split.resample_shards(shards(spark), "shard", 25, 1).collect()
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(split, "BROADCAST_ROWS", 4)
    assert sorted(split.resample_shards(shards(spark), "shard", 25, 1).collect()) == sorted(plain)


def test_nth_smallest(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(ranking, "FEW_ROWS", 5)
    values = [int(v) for v in rng.integers(-(2**63), 2**63 - 1, 400)] + [2**63 - 1, -(2**63), 0, 0, 0, 7]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "v long").repartition(7)
    keys = df.select(hash_key(1, "v").alias("v")).filter("v is not null")
    texts = sorted(r.v for r in keys.collect())
    for n in (1, 200, 406):
        assert ranking.nth_smallest(df, "v", n) == sorted(values)[n - 1]
        assert ranking.nth_smallest(keys, "v", n) == texts[n - 1]
    assert ranking.nth_smallest(df, "v", 407) is None and ranking.nth_smallest(df.limit(0), "v", 1) is None
    assert ranking.nth_smallest(spark.range(10).select((F.col("id") % 3).alias("v")), "v", 5) == 1


def test_halves_by_selection(spark):
    df = spark.createDataFrame([(None, "n0"), (None, "n1")] + [(i * i, f"r{i}") for i in range(50)], "at long, name string")
    for n in (0, 1, 2, 30, 60):
        head, tail = split.head_rows(df, "at", n), split.tail_from(df, "at", n)
        assert head.count() == min(n, 52) and tail.count() == max(0, 52 - n)
        if n > 2:
            assert sorted(r.name for r in head.collect()) == sorted(["n0", "n1"] + [f"r{i}" for i in range(n - 2)][:50])
            # a filter: no row is numbered or moved
            plan = head._jdf.queryExecution().executedPlan().toString()
            assert "Window" not in plan and "Exchange" not in plan


def test_limits_of_ranges_need_no_merging_task(spark):
    """Neither the limits nor the counts go through a task whose input grows with the number of tasks."""
    seen = []
    original = type(spark.range(1)).collect

    def collect(self):
        seen.append(self._jdf.queryExecution().executedPlan().toString())
        return original(self)

    df = spark.range(0, 10_000, 1, 40)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df), "collect", collect)
        ranking.int_buckets(df, "id")
        ranking.nth_smallest(df, "id", 77)
    assert seen and not any("SinglePartition" in p for p in seen)


def test_padded_batches_compute_their_input_once(spark, sf):
    from vlprep.plans.queries import QUERIES

    for name in ("pad_and_mask", "captioning_batches"):
        out = QUERIES[name](spark, sf)
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan
