"""Stacking: meta-learners over out-of-fold predictions, leaderboard, gate, stacked scores."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.config import StackConfig
from pairloom.functions import metrics
from pairloom.operators import evaluation, fold_encoder
from pairloom.operators.rank_cuts import assign_split, with_test_splits
from pairloom.plans import forest, moments
from pairloom.session import small_side, written

LEARNERS = ("en", "rf")


def combined_oof(long: DataFrame, versions: list[str]) -> DataFrame:
    """(id, fold, score) with one prediction column for each version; fits refuse rows with a gap."""
    return evaluation.pivot_predictions(long, versions, ["id", "fold", "score"], F.col("version"))


def fold_column(version, fold) -> Column:
    return F.concat_ws("_fold_", version, F.col(fold).cast("string"))


def fold_matrix(long: DataFrame, versions: list[str], folds: list[int]) -> DataFrame:
    """One column for each version and fold of the test predictions."""
    names = [f"{version}_fold_{fold}" for version in versions for fold in folds]
    return evaluation.pivot_predictions(long, names, ["id"], fold_column("version", "fold"))


def columns_of_fold(columns: list[str], fold: int) -> list[str]:
    """Columns whose name ends in the fold, so that fold 1 does not take fold 10."""
    return [name for name in columns if name.endswith(f"_fold_{fold}")]


def with_fold_digits(df: DataFrame, folds: list[int]) -> tuple[DataFrame, list[str]]:
    """The fold as binary digits, counted from 1; the largest fold number gives their count."""
    encoder = fold_encoder.digits(folds)
    return encoder.encoded(df), list(encoder.names)


def gate(best: DataFrame, learners: tuple[str, ...] = LEARNERS) -> DataFrame:
    """Go on with a meta-learner if one wins, with the single model otherwise."""
    kind = F.when(F.col("model").isin(list(learners)), "meta").otherwise("single")
    return best.select("model", kind.alias("kind"), "score")


@dataclass
class Stack:
    """What meta-training leaves behind: tables, and one model for each fold."""

    leaderboard: DataFrame
    mean_scores: DataFrame
    best: DataFrame
    predictions: DataFrame
    features: list[str]
    linear: DataFrame | None = None
    linear_scores: DataFrame | None = None
    forest_scores: DataFrame | None = None
    forests: dict = field(default_factory=dict)
    encoder: fold_encoder.FoldEncoder | None = None


def train_stack(oof: DataFrame, config: StackConfig) -> Stack:
    """Meta-training over all folds.

    ``oof`` holds id, fold, score and the version columns. Splits, sums and scores are grouped by
    fold, so that all folds share one job; only forest fits are one job each.
    """
    for learner in config.learners:
        if learner not in LEARNERS:
            raise ValueError(f"unknown meta-learner {learner!r}, choose from {LEARNERS}")
    versions = list(config.versions)
    features = versions
    parted = assign_split(oof, "score", config.test_size, config.seed, groups=("fold",), name="part")
    folds = sorted(row.fold for row in oof.select("fold").distinct().collect())
    encoder = fold_encoder.fit_encoder(config.encode_fold, folds)
    if encoder is not None:
        parted = encoder.encoded(parted)
        features = versions + list(encoder.names)
    rows = written(parted, "meta-rows")
    training = rows.filter(F.col("part") == "train")
    marked = with_test_splits(training, "score", config.n_splits, config.test_size, config.seed + 1, groups=("fold",))
    marked = written(marked, "meta-splits")
    predicted = rows
    linear = linear_scores = rf_scores = None
    forests = {}
    if "en" in config.learners:
        packed = moments.split_moments(marked, features, "score", config.n_splits)
        fits = small_side(moments.elastic_net_fits(packed, len(features), config.elastic_net))
        absolute = moments.absolute_errors(marked, fits, features, "score")
        linear_scores = fits.filter(F.col("split") != moments.ALL_ROWS).join(
            absolute, ["fold", "split", "setting", "sample"]
        )
        linear = small_side(moments.best_fits(fits))
        predicted = moments.with_linear_prediction(predicted, linear, features, "en")
    if "rf" in config.learners:
        kept = forest.stored_rows(marked, features)
        rf_scores = forest.forest_scores(kept, folds, config.n_splits, config.forest)
        forests = forest.refitted(kept, forest.best_settings(rf_scores))
        predicted = forest.with_forest_prediction(predicted, forests, features)
    models = versions + list(config.learners)
    dataset = F.concat(F.lit("em_"), F.col("part"), F.lit("_set")).alias("dataset")
    scored = predicted.select("fold", dataset, "score", *models)
    leaderboard = small_side(evaluation.score_models(scored, models, by=("fold", "dataset")))
    mean_scores = evaluation.mean_leaderboard(leaderboard)
    best = small_side(evaluation.best_model(mean_scores))
    return Stack(leaderboard, mean_scores, best, predicted, features, linear, linear_scores, rf_scores, forests, encoder)


GRIDS = {
    "linear": (moments.PARAMS, [("l1_ratio", "fit_intercept"), ("alpha", "fit_intercept")]),
    "forest": (forest.PARAMS, [(name, None) for name in forest.PARAMS]),
}


def grid_report(scores: DataFrame, params: list[str], axes: list[tuple[str, str | None]]) -> tuple[DataFrame, DataFrame]:
    """Mean and deviation of every setting, and for each metric and axis the curve through each fold's best setting."""
    summary = evaluation.split_summary(scores, ["fold", *params], list(metrics.SCORERS))
    curves = []
    for value in metrics.SCORERS:
        tested = summary.filter((F.col("sample") == "test") & F.col(f"mean_{value}").isNotNull())
        order = F.struct(F.col(f"mean_{value}"), *[-F.col(p).cast("double") for p in params])
        best = tested.groupBy("fold").agg(F.max_by(F.struct(*params), order).alias("_best"))
        for x, series in axes:
            fixed = [p for p in params if p not in (x, series)]
            chosen = summary.join(best, "fold").filter(reduce(and_, [F.col(p) == F.col(f"_best.{p}") for p in fixed], F.lit(True)))
            lines = ["fold"] + ([series] if series else [])
            curve = evaluation.curve_rows(chosen, x, lines, value)
            label = F.col(series).cast("string") if series else F.lit(None).cast("string")
            marked = curve.withColumns({"metric": F.lit(value), "param": F.lit(x), "series": label})
            curves.append(marked.select("fold", "metric", "param", "series", "sample", "part", F.col("ord").cast("long"), "x", "y"))
    return summary, reduce(DataFrame.unionByName, curves)


def save_stack(stack: Stack, path: str) -> None:
    """Grids, their summaries and curves, and what scoring needs: features, winner and meta-models."""
    for kind, scores in (("linear", stack.linear_scores), ("forest", stack.forest_scores)):
        if scores is not None:
            kept = written(scores, f"{kind}-scores")
            kept.write.parquet(f"{path}/grid/{kind}/scores")
            summary, curves = grid_report(kept, *GRIDS[kind])
            summary.write.parquet(f"{path}/grid/{kind}/summary")
            curves.write.parquet(f"{path}/grid/{kind}/curves")
    spark = stack.best.sparkSession
    winner = stack.best.first()
    folds = sorted(stack.forests)
    row = (winner.model if winner else None, stack.features, stack.linear is not None, folds, stack.encoder is not None)
    schema = "model string, features array<string>, linear boolean, forests array<int>, encoder boolean"
    if stack.encoder is not None:
        stack.encoder.save(spark, f"{path}/models/fold-encoder")
    spark.createDataFrame([row], schema).write.parquet(f"{path}/meta")
    if stack.linear is not None:
        stack.linear.write.parquet(f"{path}/models/linear")
    forest.save_forests(spark, stack.forests, f"{path}/models/forest")


def load_stack(spark: SparkSession, path: str) -> Stack:
    """The stored winner and meta-models, enough for ``stacked_scores``."""
    meta = spark.read.parquet(f"{path}/meta").first()
    best = spark.createDataFrame([(meta.model,)], "model string")
    linear = spark.read.parquet(f"{path}/models/linear") if meta.linear else None
    forests = forest.load_forests(spark, f"{path}/models/forest", list(meta.forests))
    none = spark.createDataFrame([], "model string")
    encoder = fold_encoder.FoldEncoder.load(spark, f"{path}/models/fold-encoder") if meta.encoder else None
    winner = best.filter("model IS NOT NULL")
    return Stack(none, none, winner, none, list(meta.features), linear, forests=forests, encoder=encoder)


def stacked_scores(matrix: DataFrame, stack: Stack, versions: list[str], folds: list[int]) -> DataFrame:
    """Final scores: the winning model of each fold on that fold's columns, averaged in the row."""
    winner = stack.best.first()
    if winner is None:
        raise ValueError("no model has a score on the test side")
    outputs = {}
    scored = matrix
    for fold in folds:
        columns = [f"{version}_fold_{fold}" for version in versions]
        target = f"_out_{fold}"
        encoded = [F.lit(value) for value in stack.encoder.values(fold)] if stack.encoder else []
        if winner.model == "en":
            fit = stack.linear.filter(F.col("fold") == fold).first()
            values = [F.col(c) for c in columns] + encoded
            outputs[target] = sum((F.lit(w) * x for w, x in zip(fit.coef, values)), F.lit(fit.intercept))
            scored = scored.withColumn(target, outputs[target])
        elif winner.model == "rf":
            values = [F.col(c) for c in columns] + encoded
            scored = scored.withColumn(target, forest.predicted_by(stack.forests[fold], values))
        else:
            scored = scored.withColumn(target, F.col(f"{winner.model}_fold_{fold}"))
    return scored.select("id", evaluation.row_mean([f"_out_{fold}" for fold in folds]).alias("score"))
