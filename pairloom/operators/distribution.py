"""Label and section shares, histogram and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.arrays import LEVELS
from pairloom.functions.hashing import hash_key
from pairloom.functions.text import section_of
from pairloom.session import small_side


def label_distribution(df: DataFrame, label: str = "score") -> DataFrame:
    """Share of each of the five levels, 0 for an absent one; one global aggregate."""
    shares = [
        F.struct(
            F.lit(level).alias(label),
            F.coalesce(F.try_divide(F.count_if(F.col(label) == level).cast("double"), F.count("*")), F.lit(0.0)).alias(
                "share"
            ),
        )
        for level in LEVELS
    ]
    return df.agg(F.array(*shares).alias("shares")).select(F.inline("shares"))


def section_distribution(df: DataFrame, context: str = "context") -> DataFrame:
    """Share of each first letter of the context code."""
    counts = small_side(df.groupBy(section_of(context).alias("section")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.select("section", (F.col("n") / total.scalar()).alias("share"))


def attach_share(df: DataFrame, distribution: DataFrame, by: str, name: str = "share") -> DataFrame:
    """Give every row the share of its label or section."""
    table = small_side(distribution.select(F.col(by).alias("_by"), F.col("share").alias(name)))
    return df.join(table, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between the extremes, the top edge belongs to the last bin."""
    numbers = df.select(F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    edges = small_side(numbers.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).filter(F.col("lo").isNotNull()))
    flat = F.when(F.col("lo") == F.col("hi"), F.lit(0.5)).otherwise(F.lit(0.0))
    wide = edges.select((F.col("lo") - flat).alias("lo"), (F.col("hi") + flat).alias("hi"))
    lo, hi = wide.select("lo").scalar(), wide.select("hi").scalar()
    place = F.least(F.width_bucket("_v", lo, hi, F.lit(bins)), F.lit(bins)).cast("int")
    counts = numbers.groupBy(place.alias("_bin")).agg(F.count("*").alias("n"))
    all_bins = wide.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return all_bins.join(counts, F.col("bin") == F.col("_bin"), "left").select(
        "bin",
        (F.col("lo") + width * (F.col("bin") - 1)).alias("lower"),
        (F.col("lo") + width * F.col("bin")).alias("upper"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def sample_rows(df: DataFrame, n: int, id_col: str = "id", seed: int = 42) -> DataFrame:
    """A repeatable sample of ``n`` rows: the smallest hash keys, kept as a top-n per task."""
    return df.orderBy(hash_key(id_col, seed), id_col).limit(n)
