"""Dictionary build: distinct terms, batches, a user's mapping, part files, mapped rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pairloom.operators import dictionary
from pairloom.operators.positions import with_batch
from pairloom.session import written
from pairloom.sources import schemas

BATCH_TERMS = 500
COMMITS = 16
Mapper = Callable[[pd.Series], pd.Series]


def map_terms(batches: DataFrame, mapper: Mapper) -> DataFrame:
    """Call ``mapper`` on the terms of one batch at a time; each distinct term is mapped once."""

    def mapped(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(mapped=mapper(frame["term"]))[["term", "mapped", "batch"]]

    return batches.select("term", "batch").groupBy("batch").applyInPandas(mapped, schemas.DICTIONARY_BATCH)


def stored_entries(spark: SparkSession, path: str) -> DataFrame:
    """What earlier runs have mapped and committed below ``path``, nothing if there is none yet."""
    try:
        return spark.read.schema(schemas.DICTIONARY_BATCH).parquet(f"{path}/run=*/commit=*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schemas.DICTIONARY_BATCH)


def build_dictionary(
    terms: DataFrame,
    mapper: Mapper,
    path: str,
    done: DataFrame | None = None,
    size: int = BATCH_TERMS,
    commits: int = COMMITS,
) -> DataFrame:
    """Map the terms without an entry and return the whole dictionary.

    Terms are numbered into batches of ``size``, and the batches are mapped and committed in ``commits`` parts, one after
    another. A run that breaks keeps the parts it has committed; the next one with the same ``path`` goes on with what is
    left. Numbering reads the terms twice, so the table of distinct terms is written first.
    """
    spark = terms.sparkSession
    known = stored_entries(spark, path)
    todo = dictionary.remaining_terms(terms, known)
    todo = todo if done is None else dictionary.remaining_terms(todo, done)
    numbered = written(with_batch(written(todo, "terms"), size, id_col="term"), "batches")
    last = numbered.agg(F.max("batch")).first()[0]
    run = uuid.uuid4().hex
    for part in range(0 if last is None else min(commits, last + 1)):
        chosen = numbered.filter(F.col("batch") % commits == part)
        map_terms(chosen, mapper).write.parquet(f"{path}/run={run}/commit={part}")
    fresh = stored_entries(spark, path)
    return fresh if done is None else done.unionByName(fresh, allowMissingColumns=True)


def translated_pairs(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """The pairs with both phrases replaced through a dictionary of distinct terms."""
    return dictionary.substitute(pairs, entries, ["anchor", "target"])


def translated_dimension(dimension: DataFrame, column: str, mapper: Mapper) -> DataFrame:
    """A dimension with one text column mapped, each distinct text once."""
    terms = with_batch(written(dictionary.distinct_terms(dimension, [column]), "terms"), BATCH_TERMS, id_col="term")
    entries = written(map_terms(terms, mapper).select("term", "mapped"), "entries")
    return dictionary.substitute(dimension, entries, [column])
