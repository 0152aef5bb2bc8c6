import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import metrics

RNG = np.random.default_rng(3)
Y = RNG.choice([0, 0.25, 0.5, 0.75, 1.0], 200)
P = np.clip(Y + RNG.normal(0, 0.3, 200), -1, 2)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(float(y), float(p)) for y, p in zip(Y, P)], "y double, p double")


def value(df, name, y="y", p="p"):
    return df.agg(metrics.loss(name)(F.col(y), F.col(p))).first()[0]


def test_pearson(df):
    got = df.agg(metrics.pearson(F.col("y"), F.col("p"))).first()[0]
    assert got == pytest.approx(np.corrcoef(Y, P)[0, 1])


def test_pearson_without_spread(spark):
    flat = spark.createDataFrame([(0.5, 1.0), (0.7, 1.0)], "y double, p double")
    single = flat.limit(1)
    empty = flat.limit(0)
    for frame in (flat, single, empty):
        assert frame.agg(metrics.pearson(F.col("y"), F.col("p"))).first()[0] is None


def test_losses(df):
    var_y, var_p = Y.var(ddof=1), P.var(ddof=1)
    cov = np.cov(Y, P)[0, 1]
    low = var_y + var_p + (P.mean() - Y.mean()) ** 2 + 1e-6
    assert value(df, "MSE") == pytest.approx(((Y - P) ** 2).mean())
    assert value(df, "PCC") == pytest.approx(1 - cov / math.sqrt(var_y * var_p))
    assert value(df, "CCC1") == pytest.approx(1 - 2 * cov / low)
    assert value(df, "CCC2") == pytest.approx(-2 * cov * 199 / low)
    logits = np.maximum(P, 0) - P * Y + np.log1p(np.exp(-np.abs(P)))
    assert value(df, "BCEWithLogits") == pytest.approx(logits.mean())


def test_bce_limits(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.5)], "y double, p double")
    assert value(df, "BCE") == pytest.approx((100 + 100 + 0 + math.log(2)) / 4)


def test_cross_entropy(spark):
    df = spark.createDataFrame([(2, [1000.0, 0.0, 1000.0, 0.0, 0.0]), (0, [0.0] * 5)], "y int, p array<double>")
    assert value(df, "CE") == pytest.approx((math.log(2) + math.log(5)) / 2)


def test_scorers(df):
    got = df.agg(*[s(F.col("y"), F.col("p")).alias(n) for n, s in metrics.SCORERS.items()]).first()
    assert got.neg_mean_absolute_error == pytest.approx(-np.abs(Y - P).mean())
    assert got.neg_mean_squared_error == pytest.approx(-((Y - P) ** 2).mean())
    assert got.r2 == pytest.approx(1 - ((Y - P) ** 2).sum() / ((Y - Y.mean()) ** 2).sum())


def test_r2_of_constant_label(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert df.agg(metrics.r2(F.col("y"), F.col("p"))).first()[0] == 1.0
    assert df.agg(metrics.r2(F.col("y"), F.col("p") + 1)).first()[0] == 0.0


def test_unknown_names():
    with pytest.raises(ValueError):
        metrics.loss("HINGE")
    with pytest.raises(ValueError):
        metrics.scorer("accuracy")


def test_missing_and_impossible_probabilities(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, None), (None, 0.5), (0.0, 0.0)], "y double, p double")
    got = df.agg(metrics.bce(F.col("y"), F.col("p")).alias("loss")).first().loss
    assert got == pytest.approx(-np.log(0.9) / 2)
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(1.0, 1.7)], "y double, p double").agg(metrics.bce(F.col("y"), F.col("p"))).collect()
