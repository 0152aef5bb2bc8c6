from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.config import RunConfig
from pairloom.operators import positions
from pairloom.plans import training_tables
from pairloom.queries import common as c


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return c.folded(spark, sf_dir)


@pytest.mark.parametrize("balance", [None, "label", "context"])
def test_batches_hold_every_training_row_once(rows, balance):
    batches = training_tables.training_batches(rows, 1, RunConfig(balance_by=balance)).collect()
    expected = {row.id for row in rows.filter("fold <> 1").collect()}
    assert len(batches) == len(expected) and {row.id for row in batches} == expected
    sizes = Counter(row.batch for row in batches)
    assert set(sizes) == set(range(len(sizes)))
    assert all(n == 32 for batch, n in sizes.items() if batch < len(sizes) - 1)


def test_value_without_share_is_an_error(spark, rows):
    weights = spark.createDataFrame([(0.0, 1.0)], "score double, share double")
    with pytest.raises(Exception, match="has no share"):
        positions.weighted_position(rows, weights, "score").collect()


def test_regression_report(rows):
    scored = rows.select("id", "score", (F.col("score") * 0.5 + 0.1).alias("output"))
    report = training_tables.validation_report(scored, RunConfig()).first()
    assert report.loss == "MSE" and report.score == pytest.approx(1.0)
    exact = scored.agg(F.avg((F.col("score") - F.col("output")) ** 2)).first()[0]
    assert report.avg_loss == pytest.approx(exact)


def test_class_report(rows):
    level = F.col("score") * 4
    logits = F.array(*[-F.abs(level - k) for k in range(5)])
    config = RunConfig(loss="CE", target_size=5)
    report = training_tables.validation_report(rows.select("id", "score", logits.alias("output")), config).first()
    assert report.loss == "CE" and report.score == pytest.approx(1.0) and 0 < report.avg_loss < 1.7


def test_best_epoch(spark):
    log = spark.createDataFrame([("r", 0, e, s) for e, s in enumerate((0.1, 0.3, 0.2))], "run string, fold int, epoch int, score double")
    assert training_tables.best_epochs(log, RunConfig(patience=1)).first().best_epoch == 1
