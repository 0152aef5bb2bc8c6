"""Tables around an external trainer: its batches going in, its predictions and log coming out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.config import RunConfig
from pairloom.functions import arrays, metrics
from pairloom.functions.text import section_of
from pairloom.operators import distribution, evaluation, positions, training_log


def training_batches(rows: DataFrame, fold: int, config: RunConfig, inverse: bool = False) -> DataFrame:
    """Training rows of a fold in the order a trainer sees them, with their batch number.

    Frequent labels or sections tend to come first, rare ones with ``inverse``; without
    ``balance_by`` the order is a plain shuffle.
    """
    train = rows.filter(F.col("fold") != fold)
    if config.balance_by is None:
        placed = positions.shuffled_position(train, seed=config.seed)
    elif config.balance_by == "label":
        weights = distribution.label_distribution(train)
        placed = positions.weighted_position(train, weights, "score", seed=config.seed, inverse=inverse)
    else:
        sectioned = train.withColumn("section", section_of("context"))
        weights = distribution.section_distribution(train)
        placed = positions.weighted_position(
            sectioned, weights, "section", seed=config.seed, inverse=inverse
        ).drop("section")
    return placed.withColumn("batch", positions.batch_of("position", config.batch_size))


def decoded(predictions: DataFrame, config: RunConfig) -> DataFrame:
    """Model outputs as one number: a probability after a logit loss, a class after cross entropy."""
    if config.target_size == 5:
        return predictions.withColumn("pred", arrays.arg_max("output").cast("double"))
    raw = F.col("output")
    return predictions.withColumn("pred", arrays.sigmoid(raw) if config.loss in ("BCE", "BCEWithLogits") else raw)


def validation_report(predictions: DataFrame, config: RunConfig) -> DataFrame:
    """Last batch loss, mean loss and score of predictions with id, score and ``output``."""
    label = arrays.class_of_score("score") if config.target_size == 5 else F.col("score")
    labelled = decoded(predictions, config).withColumn("_label", label)
    batches = positions.with_batch(labelled, config.batch_size, seed=config.seed)
    loss = {config.loss: metrics.loss(config.loss)(F.col("_label"), F.col("output"))}
    score = labelled.agg(metrics.pearson(F.col("_label"), F.col("pred")).alias("score"))
    return evaluation.batched_loss(batches, loss).withColumn("score", score.scalar())


def best_epochs(log: DataFrame, config: RunConfig) -> DataFrame:
    """The epoch to keep for each run and fold, out of the logged validation scores."""
    return training_log.early_stopping(log, config.patience)
