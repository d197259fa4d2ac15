"""No row is lost to nulls or to bounds, at any size."""

import pytest
from pyspark.sql import functions as F

from vlprep.functions.keys import hash_key
from vlprep.operators import dialogue, filters, ranking, shuffles, similarity, split


@pytest.mark.parametrize("n", [1, 5, 1000, 100_000])
@pytest.mark.parametrize("dear", [False, True])
@pytest.mark.parametrize("hashed", [False, True])
def test_null_orders_come_first(spark, n, dear, hashed):
    order = F.when(F.col("id") % 7 > 0, hash_key(1, "id") if hashed else F.col("id"))
    df = spark.range(n).withColumn("o", order)
    got = ranking.exact_rank(df, "o", dear=dear)
    nulls = -(-n // 7)
    assert got.agg(F.count_distinct("pos"), F.max("pos")).first() == (n, n - 1)
    assert got.filter("o is null").agg(F.count("*"), F.max("pos")).first() == (nulls, nulls - 1)
    assert got.filter("o is not null").withColumn("b", F.lag("pos").over(ranking.W.orderBy("o"))).filter("b >= pos").count() == 0


def test_plain_text_is_no_order(spark):
    words = spark.createDataFrame([("zeta",), ("apple",)], "o string")
    with pytest.raises(Exception, match="not a lower-case hex key"):
        ranking.exact_rank(words, "o").collect()


def test_null_groups_stay(spark):
    rows = [(i, None if i % 3 == 0 else f"s{i % 3}") for i in range(90)] + [(None, "s1"), (None, None)]
    df = spark.createDataFrame(rows, "id long, shard string")
    assert ranking.rank_in_group(df, "shard", "id").groupBy("shard").agg(F.count_distinct("pos")).count() == 3
    assert ranking.rank_in_group(df, "shard", "id", width=16).count() == 92
    assert split.assign_ranks(df, "shard", 2).count() == 92
    assert shuffles.shuffle_shards(df, "shard", "id", 1).agg(F.count_distinct("pos"), F.max("pos")).first() == (92, 91)
    drawn = split.resample_shards(df, "shard", 60, seed=2).groupBy("draw").count().count()
    assert drawn == 60


def test_rows_outside_a_stated_bound_fail(spark):
    rows = spark.range(30).select(F.lit(0).cast("long").alias("batch_id"), F.col("id").alias("pos"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("image_vec"))
    with pytest.raises(Exception, match="place outside batches"):
        similarity.batch_pairs(rows.withColumn("text_vec", F.col("image_vec")), batch_size=20, block=10).collect()
    with pytest.raises(Exception, match="no place for batch"):
        shuffles.shuffle_batches(spark.range(40).select((F.col("id") % 4).alias("b")), "b", 3).collect()


def test_null_role_is_no_system_message(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, None, "lost"), (1, 2, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert dialogue.dialogue_samples(turns).count() == 0
    assert dialogue.dialogue_samples(turns, on_dangling="truncate", keep_empty=True).count() == 0
    assert dialogue.pair_turns(turns).count() == 2


def test_image_ids_are_text(spark):
    images = spark.createDataFrame([("8",), ("009",), ("cover",)], "image_id string")
    samples = spark.createDataFrame([(8,), (9,)], "image_id long")
    assert [r[0] for r in filters.require_images(samples, images).collect()] == [8]
