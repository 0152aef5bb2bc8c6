"""Running meters and early stopping over logged training steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_meter(
    steps: DataFrame,
    group: list[str],
    step: str = "step",
    value: str = "loss",
    weight: str = "n",
    steps_per_chunk: int = 65_536,
) -> DataFrame:
    """Weighted mean up to and including each step of a group.

    ``step`` numbers are unique whole numbers. A group may be far too long for one task, so it is
    cut into chunks of step numbers: totals of earlier chunks come from a small table, only the
    steps of one chunk are accumulated together.
    """
    weighted = steps.withColumns(
        {
            "_chunk": F.floor(F.col(step) / steps_per_chunk),
            "_sum": F.col(value) * F.col(weight),
        }
    )
    chunks = weighted.groupBy(*group, "_chunk").agg(F.sum("_sum").alias("_s"), F.sum(weight).alias("_w"))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(
        *[F.col(g).alias(f"_r{g}") for g in group],
        F.col("_chunk").alias("_r_chunk"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0).cast("bigint")).alias("_w0"),
    )
    inside = Window.partitionBy(*group, "_chunk").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    local = weighted.withColumns({"_s": F.sum("_sum").over(inside), "_w": F.sum(weight).over(inside)})
    match = F.col("_chunk") == F.col("_r_chunk")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"_r{g}"))
    mean = (F.col("_s0") + F.col("_s")) / (F.col("_w0") + F.col("_w"))
    return local.join(before, match).select(*[F.col(c) for c in steps.columns], mean.alias("avg"))


def early_stopping(epochs: DataFrame, patience: int = 5) -> DataFrame:
    """Best and last epoch of each run and fold; rows are single epochs with their score.

    The first epoch always counts as better, a tie does not. Training ends at the epoch that
    makes ``patience`` epochs in a row without gain; later rows are ignored.
    """
    turn = Window.partitionBy("run", "fold").orderBy("epoch")
    upto = turn.rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.max("score").over(turn.rowsBetween(Window.unboundedPreceding, -1))
    better = (F.row_number().over(turn) == 1) | F.coalesce(F.col("score") > earlier, F.lit(False))
    judged = epochs.withColumn("_better", better)
    streaks = judged.withColumn("_streak", F.sum(F.col("_better").cast("int")).over(upto))
    since = Window.partitionBy("run", "fold", "_streak").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    missed = streaks.withColumn("_missed", F.sum((~F.col("_better")).cast("int")).over(since))
    stops = F.min(F.when(F.col("_missed") == patience, F.col("epoch"))).over(Window.partitionBy("run", "fold"))
    alive = missed.withColumn("_stop", stops).filter(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop")))
    return alive.groupBy("run", "fold").agg(
        F.max(F.when(F.col("_better"), F.col("epoch"))).alias("best_epoch"),
        F.max_by("score", F.when(F.col("_better"), F.col("epoch"))).alias("best_score"),
        F.max("epoch").alias("last_epoch"),
        F.max(F.col("_stop").isNotNull().cast("int")).alias("stopped"),
    )
