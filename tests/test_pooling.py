import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import pooling


def vectors(spark):
    rows = [("a", [1.0, 2.0], 1, 0.5), ("a", [3.0, None], 1, 2.0), ("a", [9.0, 9.0], 0, -1.0), ("a", None, 1, 7.0), ("b", [5.0, 6.0], 0, 1.0)]
    return spark.createDataFrame(rows, "g string, v array<double>, m int, s double").repartition(3)


def values(df):
    return {(r.g, r.place): r.value for r in df.collect()}


def test_mean_pool(spark):
    found = values(pooling.mean_pool(vectors(spark), "g", "v", F.col("m") == 1))
    assert found == pytest.approx({("a", 0): 2.0, ("a", 1): 1.0, ("b", 0): 0.0, ("b", 1): 0.0})


@pytest.mark.parametrize("rows", [0, 200_000])
def test_attention_pool(spark, monkeypatch, rows):
    from pairloom import session

    monkeypatch.setattr(session, "SMALL_SIDE_ROWS", rows)
    found = values(pooling.attention_pool(vectors(spark).filter("v IS NOT NULL"), "g", "v", F.col("s")))
    w = np.exp(np.array([0.5, 2.0, -1.0]))
    want = np.array([[1.0, 2.0], [3.0, 0.0], [9.0, 9.0]]).T @ w / w.sum()
    assert found == pytest.approx({("a", 0): want[0], ("a", 1): want[1], ("b", 0): 5.0, ("b", 1): 6.0})


def test_vectors_are_added_whole(spark):
    plan = pooling.mean_pool(vectors(spark), "g", "v", F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")
