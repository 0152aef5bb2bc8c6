import pytest
from pyspark.sql import functions as F

from pairloom.functions import metrics
from pairloom.operators import evaluation, training_log
from pairloom.plans import stacking


def test_duplicate_prediction_is_an_error(spark):
    rows = [("1", 0, 0.5, "v", 0.1), ("1", 0, 0.5, "v", 0.2)]
    long = spark.createDataFrame(rows, "id string, fold int, score double, version string, pred double")
    with pytest.raises(Exception, match="duplicate entry for v"):
        stacking.combined_oof(long, ["v"]).collect()


def test_pivot_leaves_gaps_null(spark):
    rows = [("1", 0, 0.5, "v", 0.1), ("2", 0, 0.5, "w", 0.2)]
    long = spark.createDataFrame(rows, "id string, fold int, score double, version string, pred double")
    got = {row.id: (row.v, row.w) for row in stacking.combined_oof(long, ["v", "w"]).collect()}
    assert got == {"1": (0.1, None), "2": (None, 0.2)}


def test_columns_of_fold_one_leave_fold_ten():
    names = ["id", "v_fold_1", "v_fold_10", "w_fold_1"]
    assert stacking.columns_of_fold(names, 1) == ["v_fold_1", "w_fold_1"]


def test_best_model_takes_the_first_of_equals(spark):
    rows = [("b", "em_test_set", 0.9), ("a", "em_test_set", 0.9), ("c", "em_train_set", 1.0), ("d", "em_test_set", None)]
    means = spark.createDataFrame(rows, "model string, dataset string, score double")
    best = evaluation.best_model(means)
    assert best.first().model == "a"
    assert stacking.gate(best).first().kind == "single"
    assert stacking.gate(best, ("a",)).first().kind == "meta"


def test_batched_loss_differs_from_the_global_one(spark):
    rows = [(0, 0.0, 1.0), (0, 1.0, 2.0), (0, 0.0, 0.0), (1, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "batch int, y double, p double")
    losses = {name: metrics.loss(name)(F.col("y"), F.col("p")) for name in ("MSE", "PCC")}
    got = {row.loss: row for row in evaluation.batched_loss(df, losses).collect()}
    assert got["MSE"].last_loss == 16.0
    assert got["MSE"].avg_loss == pytest.approx((2 + 16) / 4)
    whole = df.filter("batch = 0").agg(losses["PCC"]).first()[0]
    assert got["PCC"].last_loss is None and got["PCC"].avg_loss == pytest.approx(whole)


def epochs(spark, scores):
    rows = [("r", 0, epoch, score) for epoch, score in enumerate(scores, 1)]
    return spark.createDataFrame(rows, "run string, fold int, epoch int, score double")


def test_early_stop(spark):
    got = training_log.early_stopping(epochs(spark, [0.5, 0.6, 0.55, 0.58, 0.6, 0.59, 0.57, 0.9]), 5).first()
    assert (got.best_epoch, got.best_score, got.last_epoch, got.stopped) == (2, 0.6, 7, 1)


def test_no_early_stop(spark):
    got = training_log.early_stopping(epochs(spark, [0.1, 0.05, 0.2]), 5).first()
    assert (got.best_epoch, got.best_score, got.last_epoch, got.stopped) == (3, 0.2, 3, 0)


def test_meter(spark):
    steps = spark.createDataFrame([("r", 0, 1.0, 1), ("r", 1, 4.0, 2)], "run string, step bigint, loss double, n bigint")
    rows = training_log.running_meter(steps, ["run"]).orderBy("step").collect()
    assert [row.avg for row in rows] == [1.0, 3.0]


def test_meter_over_many_chunks(spark):
    steps = spark.range(1000).selectExpr("'hot' AS run", "id AS step", "cast(id AS double) AS loss", "id % 3 + 1 AS n")
    wide = training_log.running_meter(steps, ["run"], steps_per_chunk=7).orderBy("step").collect()
    total = weight = 0
    for row in wide:
        total, weight = total + row.loss * row.n, weight + row.n
        assert row.avg == pytest.approx(total / weight)
    assert len(wide) == 1000


def test_band_runs_out_and_back(spark):
    rows = [("test", x, 0.5 + x / 10, 0.1, True) for x in (1.0, 2.0, 3.0)]
    curve = spark.createDataFrame(rows, "sample string, depth double, mean_r2 double, std_r2 double, kind boolean")
    band = evaluation.curve_rows(curve, "depth", ["kind"], "r2").filter("part = 'band'").orderBy("ord").collect()
    assert [row.x for row in band] == [1, 2, 3, 3, 2, 1]
    assert [round(row.y, 6) for row in band] == [0.7, 0.8, 0.9, 0.7, 0.6, 0.5]


def test_summary_and_best_setting(spark):
    rows = [(a, s, "test", v) for a, v0 in ((1, 0.2), (2, 0.4)) for s, v in enumerate((v0, v0 + 0.2))]
    scores = spark.createDataFrame(rows, "a int, split int, sample string, corr_scorer double")
    summary = evaluation.split_summary(scores, ["a"], ["corr_scorer"])
    assert {row.a: round(row.std_corr_scorer, 9) for row in summary.collect()} == {1: 0.1, 2: 0.1}
    best = evaluation.best_setting(summary, ["a"])
    assert best.first().a == 2 and best.first().best_score == pytest.approx(0.5)
    assert evaluation.setting_slice(summary, best, ["a"]).count() == 1
