"""Context hierarchy joins, model text and the report on missing context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text

CLASS_COLUMNS = {"description": "text_grp_2", "mentioned_groups": "mentioned_groups_grp_2"}


def join_sections(pairs: DataFrame, sections: DataFrame) -> DataFrame:
    """The dimensions carry no hint: Spark broadcasts them while their files are small."""
    return pairs.withColumn("context_grp_1", text.section_of("context")).join(sections, "context_grp_1", "left")


def join_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    return pairs.join(classes.withColumnsRenamed(CLASS_COLUMNS), "context", "left")


def enrich(pairs: DataFrame, sections: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    joined = join_sections(pairs, sections)
    return joined if classes is None else join_classes(joined, classes)


def with_model_text(df: DataFrame, use_class_text: bool = True, use_mentions: bool = False) -> DataFrame:
    return df.withColumn("text", text.model_text(use_class_text, use_mentions))


def missing_rate(columns: list[str]) -> list[Column]:
    """Share of rows without a value, one aggregate for each column."""
    return [F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in columns]


def missing_codes(df: DataFrame, code: str = "context", column: str = "text_grp_2") -> DataFrame:
    return df.filter(F.col(column).isNull()).select(code).distinct()
