"""One key holding a third of all rows: results stay whole, and no task gets the whole group."""

import pytest
from pyspark.sql import functions as F

from vlprep.operators import filters, images, metrics, ranking, shuffles, similarity, split, tokens

N = 60_000


@pytest.fixture
def small_limits(spark):
    """Joins by shuffle only, with skew found at test sizes."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    for k in settings:
        spark.conf.unset(k)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def hot(spark, n=N):
    """A third of the rows share key 0, text and shard; the others are spread."""
    is_hot = F.col("id") % 3 == 0
    return spark.range(0, n, 1, 8).select(
        "id",
        F.when(is_hot, 0).otherwise(F.col("id")).alias("image_id"),
        F.when(is_hot, "same text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"),
        F.when(is_hot, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("shard"),
        F.sha2(F.col("id").cast("string"), 512).alias("payload"),
    )


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_hot_text_is_split_in_the_anti_join(spark, small_limits):
    used = spark.createDataFrame([("text 1",), ("text 2",), ("other",)] + [("same",)] * 5, "text string").repartition(4)
    out = filters.disjoint(hot(spark), used)
    assert out.count() == N - 2
    assert "skew=true" in final_plan(out)


def test_hot_image_is_split_in_the_joins(spark, small_limits):
    pictures = spark.range(0, N, 1, 8).select(F.col("id").alias("image_id"), F.lit(b"x").alias("data"))
    for out in (images.attach_images(hot(spark), pictures), filters.require_images(hot(spark), pictures)):
        assert out.count() == N
        assert "skew=true" in final_plan(out)


def test_hot_shard_positions(spark):
    out = shuffles.shuffle_shards(hot(spark), "shard", "id", 1)
    assert out.agg(F.countDistinct("pos"), F.max("pos")).first()[:] == (N, N - 1)
    buckets = ranking.int_buckets(hot(spark), "id")(hot(spark)).groupBy("shard", "_bucket").count()
    assert buckets.agg(F.max("count")).first()[0] < N / 100


def test_hot_shard_draws_are_not_shuffled(spark):
    out = split.resample_shards(hot(spark), "shard", 4, 2)
    sizes = {r.shard: r["count"] for r in hot(spark).groupBy("shard").count().collect()}
    drawn = out.select("draw", "shard").distinct().collect()
    assert out.count() == sum(sizes[r.shard] for r in drawn)
    assert "SortMergeJoin" not in final_plan(out)


def test_hot_word_is_counted_before_the_shuffle(spark):
    df = hot(spark).select(F.repeat(F.lit("the "), 20).alias("text"))
    vocab = tokens.build_vocab(df, "text", 10)
    assert [(r.word, r.n) for r in vocab.collect()] == [("the", N * 20)]
    plan = tokens.word_counts(df, "text")._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_hot_group_reports(spark):
    rows = {r.shard: r.n_samples for r in metrics.dataset_report(hot(spark).withColumn("n", F.length("text")), "shard", "n").collect()}
    assert rows["hot"] == N // 3 and sum(rows.values()) == N
    first = ranking.take_per_group(hot(spark), "shard", "id", 5)
    assert first.filter("shard = 'hot'").count() == 5


def test_hot_label_class_vectors(spark):
    df = hot(spark).select((F.col("image_id") % 7).alias("label"), F.array(F.lit(3.0), F.lit(4.0)).alias("embedding"))
    rows = similarity.class_vectors(df).collect()
    assert len(rows) == 7 and all(r.class_vec == pytest.approx([0.6, 0.8]) for r in rows)
