import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pairloom.config import ElasticNetGrid
from pairloom.plans import moments

RNG = np.random.default_rng(7)
N = 400
Y = RNG.choice([0, 0.25, 0.5, 0.75, 1.0], N)
X = np.stack([Y + RNG.normal(0, s, N) for s in (0.2, 0.4, 0.8)], axis=1)
SIDE = np.where(np.arange(N) % 5 == 0, "test", "train")
FEATURES = ["a", "b", "c"]
GRID = ElasticNetGrid(alpha=(0.0, 0.02, 0.2), fit_intercept=(True, False), l1_ratio=(0.0, 0.4, 1.0))


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, 0, str(side), float(y), *map(float, x)) for side, y, x in zip(SIDE, Y, X)]
    return spark.createDataFrame(data, "fold int, split int, side string, score double, a double, b double, c double")


def with_bits(rows):
    return rows.withColumn("test_splits", (F.col("side") == "test").cast("int")).repartition(3)


@pytest.fixture(scope="module")
def fits(rows):
    return moments.elastic_net_fits(moments.split_moments(with_bits(rows), FEATURES, "score", 1), 3, GRID).toPandas()


def one(fits, sample="train", split=0, **params):
    keep = (fits["sample"] == sample) & (fits["split"] == split)
    for name, value in params.items():
        keep &= fits[name] == value
    return fits[keep].iloc[0]


def test_sums(rows):
    got = moments.moments(rows, FEATURES, "score", ["side"]).filter("side = 'test'").first()
    t = SIDE == "test"
    assert got.n == t.sum()
    assert got.xx_a_b == pytest.approx(np.cov(X[t, 0], X[t, 1], bias=True)[0, 1])
    assert got.xy_c == pytest.approx(np.cov(X[t, 2], Y[t], bias=True)[0, 1])


def test_far_from_zero(spark, rows):
    """The slopes of shifted features are those of the features."""
    shifted = rows.withColumns({f: F.col(f) + 1e7 for f in FEATURES})
    found = []
    for df in (rows, shifted):
        fits = moments.elastic_net_fits(moments.split_moments(with_bits(df), FEATURES, "score", 1), 3, GRID).toPandas()
        found.append(np.array([*one(fits, alpha=0.0, fit_intercept=True, l1_ratio=0.4).coef]))
    assert found[1] == pytest.approx(found[0], abs=1e-5)


def test_missing_predictions_are_an_error(spark, rows):
    gone = rows.withColumn("a", F.when(F.col("a") > 0.5, F.col("a")))
    with pytest.raises(Exception, match="missing"):
        moments.moments(gone, FEATURES, "score", ["fold"]).collect()
    with pytest.raises(Exception, match="missing"):
        moments.split_moments(with_bits(gone), FEATURES, "score", 1).collect()


def test_sides_by_subtraction(spark):
    """All rows less the test rows give the train rows' own moments, however far from zero the values lie."""
    chance = np.random.default_rng(1)
    data = [(i % 2, int(chance.integers(0, 8)), float(v), float(v * 0.3 + 1e6), float(-v)) for i, v in enumerate(chance.normal(1e4, 3, 500))]
    rows = spark.createDataFrame(data, "fold int, test_splits int, score double, a double, b double").repartition(4)
    found = moments.by_side(moments.split_moments(rows, ["a", "b"], "score", 3), ["a", "b"], "score").collect()
    assert len(found) == 2 * 3 * 2
    for row in found:
        mine = np.array([d[2:] for d in data if d[0] == row.fold and (d[1] >> row.split & 1) == (row.side == "test")])
        assert row.n == len(mine) and row.y == pytest.approx(mine[:, 0].mean(), rel=1e-12)
        assert row.yy == pytest.approx(mine[:, 0].var(), rel=1e-9)
        assert row.xx_a_b == pytest.approx(np.cov(mine[:, 1], mine[:, 2], bias=True)[0, 1], rel=1e-9)
        assert row.xy_a == pytest.approx(np.cov(mine[:, 1], mine[:, 0], bias=True)[0, 1], rel=1e-9)


def test_sides_without_rows(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, 2.0), (0, 1, 3.0, 5.0)], "fold int, test_splits int, score double, a double")
    found = {r.side: r for r in moments.by_side(moments.split_moments(rows, ["a"], "score", 1), ["a"], "score").collect()}
    assert (found["test"].n, found["test"].y, found["train"].n, found["train"].xx_a_a) == (2, 2, 0, 0)


def test_all_rows_are_both_sides(spark, rows, fits):
    exact = np.linalg.lstsq(np.column_stack([X, np.ones(N)]), Y, rcond=None)[0]
    fit = one(fits, split=moments.ALL_ROWS, alpha=0.0, fit_intercept=True, l1_ratio=0.4)
    assert [*fit.coef, fit.intercept] == pytest.approx(exact, abs=1e-8)


def test_no_penalty_is_least_squares(fits):
    t = SIDE == "train"
    exact = np.linalg.lstsq(np.column_stack([X[t], np.ones(t.sum())]), Y[t], rcond=None)[0]
    fit = one(fits, alpha=0.0, fit_intercept=True, l1_ratio=0.4)
    assert [*fit.coef, fit.intercept] == pytest.approx(exact, abs=1e-8)
    plain = one(fits, alpha=0.0, fit_intercept=False, l1_ratio=0.4)
    assert plain.coef == pytest.approx(np.linalg.lstsq(X[t], Y[t], rcond=None)[0], abs=1e-8)


def test_gradient_vanishes(fits):
    t = SIDE == "train"
    for fit in fits[(fits["sample"] == "train") & (fits["split"] == 0)].itertuples():
        w = np.array(fit.coef)
        residual = Y[t] - X[t] @ w - fit.intercept
        gradient = -X[t].T @ residual / t.sum() + fit.alpha * (1 - fit.l1_ratio) * w
        l1 = fit.alpha * fit.l1_ratio
        active = w != 0
        assert np.allclose(gradient[active], -l1 * np.sign(w[active]), atol=1e-7)
        assert (np.abs(gradient[~active]) <= l1 + 1e-7).all()


def test_scores_from_sums(fits):
    t = SIDE == "test"
    fit = one(fits, "test", alpha=0.02, fit_intercept=True, l1_ratio=0.4)
    p = X[t] @ np.array(fit.coef) + fit.intercept
    assert fit.neg_mean_squared_error == pytest.approx(-((Y[t] - p) ** 2).mean())
    assert fit.r2 == pytest.approx(1 - ((Y[t] - p) ** 2).sum() / ((Y[t] - Y[t].mean()) ** 2).sum())
    assert fit.corr_scorer == pytest.approx(np.corrcoef(Y[t], p)[0, 1])


def test_agrees_with_spark_ml(rows, fits):
    train = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.filter("side = 'train'"))
    std = float(Y[SIDE == "train"].std())
    for alpha, ratio in ((0.02, 0.4), (0.2, 1.0), (0.2, 0.0)):
        model = moments.linear_regression(alpha, ratio, True, std).fit(train)
        fit = one(fits, alpha=alpha, fit_intercept=True, l1_ratio=ratio)
        assert model.coefficients.toArray() == pytest.approx(np.array(fit.coef), abs=2e-5)


def test_absolute_errors(spark, rows, fits):
    got = moments.absolute_errors(with_bits(rows), spark.createDataFrame(fits), FEATURES, "score").toPandas()
    fit = one(fits, "test", alpha=0.2, fit_intercept=True, l1_ratio=0.4)
    t = SIDE == "test"
    p = X[t] @ np.array(fit.coef) + fit.intercept
    row = got[(got["setting"] == fit.setting) & (got["sample"] == "test")].iloc[0]
    assert row.neg_mean_absolute_error == pytest.approx(-np.abs(Y[t] - p).mean())
    assert len(got) == 2 * 18


def test_best_fit_is_refitted_on_all_rows(spark, rows, fits):
    best = moments.best_fits(spark.createDataFrame(fits)).first()
    tested = fits[(fits["sample"] == "test") & (fits["split"] == 0)]
    assert best.cv_score == pytest.approx(tested["corr_scorer"].max())
    predicted = moments.with_linear_prediction(rows, spark.createDataFrame([best]), FEATURES)
    first = predicted.filter(F.col("en").isNull()).count()
    assert first == 0
