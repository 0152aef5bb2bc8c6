"""Scans and sinks of the job tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.sources import schemas


CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Header CSV by explicit schema. Quoted line breaks need ``multi_line``, which reads whole files."""
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=multi_line).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", line_breaks: bool = False) -> None:
    """Header CSV. A text with a line break is an error unless ``line_breaks`` says that readers use ``multi_line``."""
    if not line_breaks:
        broken = F.raise_error(F.lit("a text with a line break does not fit a CSV of one line a row"))
        texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({c: F.when(F.col(c).rlike("[\\r\\n]"), broken).otherwise(F.col(c)) for c in texts})
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def dimension_in_language(dimension: DataFrame, language: str | None = None) -> DataFrame:
    """One language of a dimension table that holds all of them, the default one without a choice."""
    chosen = F.col("lang").isNull() if language is None else F.col("lang") == language.lower()
    return dimension.filter(chosen).drop("lang")


def write_dictionary_parts(dictionary: DataFrame, path: str) -> None:
    write_csv(dictionary.select(*schemas.DICTIONARY_BATCH.fieldNames()), path)


def read_dictionary_parts(spark: SparkSession, path: str, language: str) -> DataFrame:
    """All part files of a dictionary, as ``en`` and one column named after the language."""
    parts = read_csv(spark, f"{path}/*.csv", schemas.DICTIONARY_BATCH)
    return parts.withColumnsRenamed({"term": "en", "mapped": language.lower().replace("-", "_")})


def write_versioned(df: DataFrame, path: str, keys: tuple[str, ...] = ("version",)) -> None:
    """Partitioned layout; the rebalance lets Spark split a version that holds most rows."""
    df.hint("rebalance", *keys).write.mode("errorifexists").partitionBy(*keys).parquet(path)


def read_versions(spark: SparkSession, path: str, versions: list[str]) -> DataFrame:
    """The wanted versions only: the filter prunes folders, no other file is opened."""
    return spark.read.schema(schemas.OOF).parquet(path).filter(F.col("version").isin(versions))


def write_marker(best: DataFrame, path: str) -> None:
    best.select(F.col("model").alias("best_model")).coalesce(1).write.json(path)


def read_marker(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MARKER).json(path)
