"""Enrichment and scoring of arriving pairs, with the same operators as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from pairloom.operators.enrich import enrich, with_model_text
from pairloom.session import scratch_path


def enriched_stream(pairs: DataFrame, sections: DataFrame, classes: DataFrame) -> DataFrame:
    """Stream-static left joins; the dimensions are looked up again in every micro-batch."""
    return with_model_text(enrich(pairs, sections, classes))


def score_available(
    pairs: DataFrame, sections: DataFrame, classes: DataFrame, score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Score everything that has arrived, write it to files once, and read the table."""
    spark = pairs.sparkSession
    scored = score(enriched_stream(pairs, sections, classes))
    return append_available(scored, scratch_path(spark, "scored"), scratch_path(spark, "scored-log"))


def append_available(scored: DataFrame, path: str, progress: str) -> DataFrame:
    """Append what a stream has not delivered yet to the table at ``path``, and read the table.

    ``progress`` keeps what was delivered. The table's own log names the files of finished batches, so those of a batch that
    broke off, and is done again, are not read.
    """
    query = (
        scored.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return scored.sparkSession.read.schema(scored.schema).parquet(path)
