"""Term dictionaries: distinct terms, resume, substitution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_terms(df: DataFrame, columns: list[str], name: str = "term") -> DataFrame:
    """Distinct non-null values of several text columns."""
    values = F.explode(F.array(*[F.col(c) for c in columns])).alias(name)
    return df.select(values).filter(F.col(name).isNotNull()).distinct()


def remaining_terms(terms: DataFrame, done: DataFrame) -> DataFrame:
    """Terms without an entry yet, so that a broken run goes on where it stopped."""
    return terms.join(done.select("term"), "term", "left_anti")


def last_entries(dictionary: DataFrame, order: str) -> DataFrame:
    """One entry for each term; the later of two entries wins."""
    return dictionary.groupBy("term").agg(F.max_by("mapped", order).alias("mapped"))


def substitute(df: DataFrame, dictionary: DataFrame, columns: list[str]) -> DataFrame:
    """Replace the values of ``columns`` by their mapping, null when there is none.

    ``dictionary`` must hold each term once. Spark picks broadcast or shuffle by its size, and
    adaptive execution splits a term that fills many rows.
    """

    def one(current: DataFrame, column: str) -> DataFrame:
        entries = dictionary.select(F.col("term").alias("_term"), F.col("mapped").alias("_mapped"))
        return (
            current.join(entries, F.col(column) == F.col("_term"), "left")
            .withColumn(column, F.col("_mapped"))
            .drop("_term", "_mapped")
        )

    return reduce(one, columns, df)


def with_translated(df: DataFrame, translated: DataFrame) -> DataFrame:
    """Original and translated rows together; columns one side lacks become null."""
    return df.unionByName(translated, allowMissingColumns=True)
