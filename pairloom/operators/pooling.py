"""Pooling of token or group vectors to one vector per group."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import small_side

MASK_FLOOR = 1e-9


def _summed(group: str, weighted: DataFrame) -> DataFrame:
    """group, _sum (an array) and _total: the weighted vectors of each group added up as vectors, in partial sums for each task.

    A missing entry counts as 0; rows without a vector are left out; vectors of different lengths are an error.
    """
    scaled = F.transform("_vector", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) * F.col("_weight"))
    rows = weighted.filter(F.col("_vector").isNotNull()).select(group, array_to_vector(scaled).alias("_scaled"), "_weight")
    sums = rows.groupBy(group).agg(Summarizer.sum(F.col("_scaled")).alias("_sum"), F.sum("_weight").alias("_total"))
    return sums.select(group, vector_to_array("_sum").alias("_sum"), "_total")


def _by_place(group: str, pooled: DataFrame, total: Column) -> DataFrame:
    cells = pooled.select(group, total.alias("_total"), F.posexplode("_sum").alias("place", "_x"))
    return cells.select(group, "place", (F.col("_x") / F.col("_total")).alias("value"))


def mean_pool(vectors: DataFrame, group: str, vector: str, mask: Column) -> DataFrame:
    """Mean of the vectors with mask 1, by vector place."""
    weighted = vectors.select(group, F.col(vector).alias("_vector"), mask.cast("double").alias("_weight"))
    return _by_place(group, _summed(group, weighted), F.greatest("_total", F.lit(MASK_FLOOR)))


def attention_pool(vectors: DataFrame, group: str, vector: str, score: Column, salts: int = 16) -> DataFrame:
    """Softmax of the scores of a group as weights of its vectors.

    Few groups: their largest scores are broadcast. Many groups: rows and largest scores meet by
    group and salt, so that one large group is spread over ``salts`` tasks. Vectors are added up in the tasks.
    """
    scored = vectors.select(group, F.col(vector).alias("_vector"), score.alias("_score"))
    tops = small_side(scored.groupBy(group).agg(F.max("_score").alias("_top")))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    salted = tops.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = scored.withColumn("_salt", salt).join(salted, [group, "_salt"])
    weighted = met.select(group, "_vector", F.exp(F.col("_score") - F.col("_top")).alias("_weight"))
    return _by_place(group, _summed(group, weighted), F.col("_total"))
