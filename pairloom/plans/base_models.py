"""Cross-validated base models, their stored versions, and fold-averaged scoring."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pairloom.functions import text
from pairloom.functions.arrays import sigmoid
from pairloom.operators.evaluation import row_mean
from pairloom.operators.pair_features import FEATURES, with_pair_features
from pairloom.session import written

TEXT_FEATURES = 64
CONSTANT = 1e-6  # deviation of a feature, next to the widest one, below which it counts as constant

LINKS: dict[str, Callable[[Column], Column]] = {"identity": lambda x: x, "sigmoid": sigmoid}


def estimator(name: str) -> Estimator:
    known = {
        "linear": lambda: LinearRegression(featuresCol="features", labelCol="score", regParam=0.001, solver="normal"),
        "gbt": lambda: GBTRegressor(featuresCol="features", labelCol="score", maxIter=20, maxDepth=4, seed=42),
        "forest": lambda: RandomForestRegressor(featuresCol="features", labelCol="score", numTrees=50, seed=42),
    }
    if name not in known:
        raise ValueError(f"unknown base model {name!r}, choose one of {sorted(known)}")
    return known[name]()


def with_features(df: DataFrame) -> DataFrame:
    """Pair features and hashed tokens of the model text as one vector; nothing to fit."""
    featured = with_pair_features(df).withColumn("tokens", text.tokens(F.col("text")))
    hashed = HashingTF(inputCol="tokens", outputCol="hashed", numFeatures=TEXT_FEATURES).transform(featured)
    assembled = VectorAssembler(inputCols=[*FEATURES, "hashed"], outputCol="features").transform(hashed)
    return assembled.drop("tokens", "hashed", *FEATURES)


def cross_validate(
    df: DataFrame, model: Estimator, folds: tuple[int, ...], version: str, link: str = "identity"
) -> tuple[DataFrame, dict[int, Transformer]]:
    """Out-of-fold predictions and one model for each fold.

    ``df`` holds id, score, fold and features. It is kept while the folds are fitted; the
    predictions are written, so that nothing stays cached afterwards.
    """
    kept = df.select("id", "score", "fold", "features").persist()
    try:
        models = {fold: model.fit(kept.filter(F.col("fold") != fold)) for fold in folds}
        held_out = [
            fitted.setPredictionCol("raw")
            .transform(kept.filter(F.col("fold") == fold))
            .select("id", "fold", "score", LINKS[link](F.col("raw")).alias("pred"))
            for fold, fitted in models.items()
        ]
        oof = reduce(DataFrame.unionByName, held_out).withColumn("version", F.lit(version))
        return written(oof, "oof"), models
    finally:
        kept.unpersist()


def certificate(df: DataFrame, oof: DataFrame, models: dict[int, Transformer], penalty: float, tolerance: float = 1e-7) -> DataFrame:
    """One row for each fold: whether its linear model is the best fit of its training rows, and how the fold was predicted.

    At the best fit the residuals add up to nothing (``unbiased``) and their covariance with every feature is what the penalty on
    its weight pulls (``stationary``). One aggregation adds both up for all folds. ``once``: each id of the fold has one
    prediction; ``own_model``: it is that of the model that did not see the fold.
    """
    scored = df.select("id", "score", "fold", "features")
    for fold, fitted in models.items():
        scored = fitted.setPredictionCol(f"p_{fold}").transform(scored)
    sums = []

    def times(gap: Column) -> Column:
        return array_to_vector(F.transform(vector_to_array("features"), lambda value: value * gap))

    for fold in models:
        seen = (F.col("fold") != fold).cast("double")
        gap = F.col(f"p_{fold}") - F.col("score")
        scored = scored.withColumns({f"s_{fold}": seen, f"g_{fold}": times(gap)})
        own = F.when(F.col("fold") != fold, gap), F.when(F.col("fold") != fold, F.col("score"))
        sums += [
            Summarizer.metrics("mean", "variance").summary(F.col("features"), F.col(f"s_{fold}")).alias(f"x_{fold}"),
            Summarizer.metrics("mean").summary(F.col(f"g_{fold}"), F.col(f"s_{fold}")).alias(f"gx_{fold}"),
            F.avg(own[0]).alias(f"r_{fold}"), F.stddev_pop(own[1]).alias(f"y_{fold}"), F.sum(seen).alias(f"n_{fold}"),
        ]
    found = scored.agg(*sums).first()
    rows = []
    for fold, fitted in models.items():
        n, spread = found[f"n_{fold}"], found[f"y_{fold}"]
        mean, variance = found[f"x_{fold}"].mean.toArray(), found[f"x_{fold}"].variance.toArray() * (n - 1) / n
        pull = found[f"gx_{fold}"].mean.toArray() - mean * found[f"r_{fold}"]
        gradient = pull + penalty / spread * variance * fitted.coefficients.toArray()
        width = np.sqrt(variance)
        scale = np.maximum(width, CONSTANT * width.max(initial=0.0)) * spread
        worst = float(np.max(np.abs(gradient) / np.maximum(scale, 1e-300), initial=0.0))
        rows.append((fold, int(n), bool(abs(found[f"r_{fold}"]) < tolerance), bool(worst < tolerance)))
    spark = df.sparkSession
    fits = spark.createDataFrame(rows, "fold int, trained bigint, unbiased boolean, stationary boolean")
    again = F.coalesce(*[F.when(F.col("fold") == fold, F.col(f"p_{fold}")) for fold in models]).alias("again")
    both = oof.select("id", "pred").join(scored.select("id", "fold", again), "id", "right")
    ids = both.groupBy("fold", "id").agg(F.count("pred").alias("times"), F.max(F.abs(F.col("pred") - F.col("again"))).alias("gap"))
    held = ids.groupBy("fold").agg(
        F.count("*").alias("predicted"), (F.min("times") + F.max("times") == 2).alias("once"),
        F.coalesce(F.max("gap") < tolerance, F.lit(False)).alias("own_model"),
    )
    return fits.join(held, "fold").select("fold", "trained", "predicted", "unbiased", "stationary", "once", "own_model")


def save_models(models: dict[int, Transformer], path: str, version: str) -> None:
    for fold, fitted in models.items():
        PipelineModel([fitted]).write().overwrite().save(f"{path}/version={version}/fold={fold}")


def load_models(path: str, version: str, folds: tuple[int, ...]) -> dict[int, Transformer]:
    return {fold: PipelineModel.load(f"{path}/version={version}/fold={fold}").stages[0] for fold in folds}


def fold_predictions(df: DataFrame, models: dict[int, Transformer], link: str = "identity") -> DataFrame:
    """One prediction column for each fold model: all of them score a row in the same scan."""
    scored = df
    for fold, fitted in models.items():
        scored = fitted.setPredictionCol(f"pred_{fold}").transform(scored)
    return scored.select("id", *[LINKS[link](F.col(f"pred_{fold}")).alias(f"pred_{fold}") for fold in models])


def fold_ensemble(df: DataFrame, models: dict[int, Transformer], link: str = "identity") -> DataFrame:
    """Mean prediction of the fold models."""
    columns = [f"pred_{fold}" for fold in models]
    return fold_predictions(df, models, link).select("id", row_mean(columns).alias("score"))


def vector_scorer(make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, batch_size: int = 1024):
    """A user's model as a column function: a vector column in, a number out, batch by batch.

    ``make_model`` runs once in each Python worker and may load a model file there.
    """
    return predict_batch_udf(
        make_model, return_type=DoubleType(), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
