from collections import Counter

from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_key
from pairloom.operators import distribution, positions


def test_positions_are_a_permutation_in_key_order(spark):
    df = spark.range(1000).withColumnRenamed("id", "n").withColumn("id", F.col("n").cast("string"))
    placed = positions.shuffled_position(df).withColumn("k", hash_key("id", 42)).orderBy("position").collect()
    assert [row.position for row in placed] == list(range(1000))
    assert [row.k for row in placed] == sorted(row.k for row in placed)


def test_short_last_batch(spark):
    batches = positions.with_batch(spark.range(7), 3).collect()
    assert Counter(row.batch for row in batches) == {0: 3, 1: 3, 2: 1}


def test_no_rows(spark):
    assert positions.with_batch(spark.range(0), 3).count() == 0


def weighted(spark, inverse):
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("label")
    )
    weights = df.groupBy("label").agg((F.count("*") / 3000).alias("share"))
    return positions.weighted_position(df, weights, "label", inverse=inverse).collect()


def test_weighted_order_prefers_frequent_labels(spark):
    rows = weighted(spark, inverse=False)
    assert sorted(row.position for row in rows) == list(range(3000))
    first = Counter(row.label for row in rows if row.position < 1500)
    assert first["rare"] < 60


def test_inverse_weights_prefer_rare_labels(spark):
    rows = weighted(spark, inverse=True)
    assert sorted(row.position for row in rows) == list(range(3000))
    assert Counter(row.label for row in rows if row.position < 600)["rare"] > 200


def test_sample(spark):
    df = spark.range(1000)
    picked = {row.id for row in distribution.sample_rows(df, 200).collect()}
    assert len(picked) == 200 and picked == {row.id for row in distribution.sample_rows(df, 200).collect()}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.25,), (0.5,), (0.75,), (1.0,), (None,)], "v double")
    counts = {row.bin: row.n for row in distribution.histogram(df, "v").collect()}
    assert counts == {1: 1, 3: 1, 6: 1, 8: 1, 10: 1, **{b: 0 for b in (2, 4, 5, 7, 9)}}


def test_histogram_of_one_value(spark):
    rows = distribution.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).orderBy("bin").collect()
    assert [(row.lower, row.n) for row in rows] == [(1.5, 0), (1.75, 0), (2.0, 2), (2.25, 0)]


def test_histogram_without_rows(spark):
    assert distribution.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_label_distribution(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (0.5,)], "score double")
    shares = {row.score: row.share for row in distribution.label_distribution(df).collect()}
    assert shares == {0.0: 0.5, 0.25: 0.0, 0.5: 0.25, 0.75: 0.0, 1.0: 0.25}


def test_levels_without_rows_are_left_out(spark):
    df = spark.createDataFrame([(str(i), "a" if i % 3 else "b") for i in range(30)], "id string, kind string")
    shares = spark.createDataFrame([("a", 2 / 3), ("b", 1 / 3), ("absent", 0.0)], "kind string, share double")
    for inverse in (False, True):
        placed = positions.weighted_position(df, shares, "kind", inverse=inverse)
        assert sorted(row.position for row in placed.collect()) == list(range(30))
