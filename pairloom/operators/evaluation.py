"""Leaderboards, fold means, batched losses and split summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import metrics


def score_models(df: DataFrame, models: list[str], label: str = "score", by: tuple[str, ...] = ("fold",)) -> DataFrame:
    """Pearson score of every prediction column for each group, in one aggregation.

    The scores are aggregated as columns, so the rows are read once and never multiplied; only
    the few result rows are turned to long form.
    """
    wide = df.groupBy(*by).agg(*[metrics.pearson(F.col(label), F.col(m)).alias(m) for m in models])
    return wide.unpivot([F.col(c) for c in by], models, "model", "score")


def mean_leaderboard(leaderboard: DataFrame) -> DataFrame:
    """Mean score over folds; null scores do not count."""
    return leaderboard.groupBy("model", "dataset").agg(F.avg("score").alias("score"))


def best_model(mean_scores: DataFrame, dataset: str = "em_test_set") -> DataFrame:
    """The best model on the test side, the first by name among equals."""
    ranked = mean_scores.filter((F.col("dataset") == dataset) & F.col("score").isNotNull())
    return ranked.orderBy(F.desc("score"), "model").limit(1)


def batched_loss(batches: DataFrame, losses: dict[str, Column], batch: str = "batch") -> DataFrame:
    """Loss of the last batch and the mean over batches, weighted by their size.

    All ``losses`` come from one grouping. A batch without a value of a loss has no weight in it.
    """
    per_batch = batches.groupBy(batch).agg(*[loss.alias(name) for name, loss in losses.items()], F.count("*").alias("_n"))

    def both(name: str) -> Column:
        weight = F.sum(F.when(F.col(name).isNotNull(), F.col("_n")))
        return F.struct(
            F.lit(name).alias("loss"),
            F.max_by(name, batch).alias("last_loss"),
            F.try_divide(F.sum(F.col(name) * F.col("_n")), weight).alias("avg_loss"),
        )

    return per_batch.agg(F.array(*[both(name) for name in losses]).alias("_rows")).select(F.inline("_rows"))


def split_summary(scores: DataFrame, params: list[str], values: list[str]) -> DataFrame:
    """Mean and population deviation over splits for each setting and sample."""
    parts = []
    for value in values:
        parts += [F.avg(value).alias(f"mean_{value}"), F.stddev_pop(value).alias(f"std_{value}")]
    return scores.groupBy(*params, "sample").agg(*parts)


def best_setting(summary: DataFrame, params: list[str], by: str = "mean_corr_scorer") -> DataFrame:
    """The setting with the highest mean test score, the first in parameter order among equals."""
    tested = summary.filter((F.col("sample") == "test") & F.col(by).isNotNull())
    return tested.orderBy(F.desc(by), *params).limit(1).select(*params, F.col(by).alias("best_score"))


def setting_slice(summary: DataFrame, best: DataFrame, fixed: list[str]) -> DataFrame:
    """Rows that agree with the best setting on the ``fixed`` parameters."""
    return summary.join(best.select(*fixed), fixed, "left_semi")


def curve_rows(curve: DataFrame, x: str, series: list[str], value: str) -> DataFrame:
    """Line and band of one parameter: means in order, then upper edge out and lower edge back."""
    keep = [*series, "sample", F.col(x).cast("double").alias("x")]
    mean, std = F.col(f"mean_{value}"), F.col(f"std_{value}")
    turn = Window.partitionBy(*series, "sample").orderBy("x")
    placed = curve.select(*keep, mean.alias("_mean"), std.alias("_std")).withColumns(
        {"_up": F.row_number().over(turn), "_n": F.count("*").over(Window.partitionBy(*series, "sample"))}
    )
    line = placed.select(*series, "sample", F.lit("line").alias("part"), F.col("_up").alias("ord"), "x", F.col("_mean").alias("y"))
    test = placed.filter(F.col("sample") == "test")
    upper = test.select(
        *series, "sample", F.lit("band").alias("part"), F.col("_up").alias("ord"), "x", (F.col("_mean") + F.col("_std")).alias("y")
    )
    lower = test.select(
        *series,
        "sample",
        F.lit("band").alias("part"),
        (2 * F.col("_n") + 1 - F.col("_up")).alias("ord"),
        "x",
        (F.col("_mean") - F.col("_std")).alias("y"),
    )
    return line.unionByName(upper).unionByName(lower)


def pivot_predictions(long: DataFrame, names: list[str], keys: list[str], name: Column, value: str = "pred") -> DataFrame:
    """One column for each prediction set; a set that holds a key twice is an error."""
    named = long.withColumn("_name", name)
    cells = []
    for wanted in names:
        hit = F.col("_name") == wanted
        cells += [F.count_if(hit).alias(f"_n_{wanted}"), F.max(F.when(hit, F.col(value))).alias(f"_v_{wanted}")]
    wide = named.groupBy(*keys).agg(*cells)
    checked = [
        F.when(F.col(f"_n_{wanted}") > 1, F.raise_error(F.lit(f"duplicate entry for {wanted}")).cast("double"))
        .otherwise(F.col(f"_v_{wanted}"))
        .alias(wanted)
        for wanted in names
    ]
    return wide.select(*keys, *checked)


def row_mean(columns: list[str]) -> Column:
    """Mean of prediction columns in one row, without moving it."""
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns)
