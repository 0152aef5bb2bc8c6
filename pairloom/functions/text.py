"""Text expressions, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators of the model text and the token and bracket patterns.
SEP = "[SEP]"
CLASS_JOINER = "; "
BRACKETED = r"[\(\[\{].*?[\)\]\}]"
TOKEN = r"\[sep\]|[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
SEP_TOKEN = "[sep]"


def section_of(code) -> Column:
    return F.substring(code, 1, 1)


def class_of(symbol) -> Column:
    return F.substring(symbol, 1, 3)


def without_brackets(text) -> Column:
    return F.regexp_replace(text, BRACKETED, "")


def clean_description(text) -> Column:
    return F.lower(without_brackets(text))


def description_for(symbol, text) -> Column:
    """Only symbols of class length carry a description."""
    symbol = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.when(F.length(symbol) <= 3, clean_description(text)).otherwise(F.lit(""))


def append_if_present(base: Column, separator: str, extra: Column) -> Column:
    return F.when(extra.isNull(), base).otherwise(F.concat(base, F.lit(separator), extra))


def model_text(use_class_text: bool = True, use_mentions: bool = False) -> Column:
    """anchor, target and context texts in one string; null if a required part is null."""
    text = F.concat(F.col("anchor"), F.lit(SEP), F.col("target"), F.lit(SEP), F.col("text_grp_1"))
    if use_class_text:
        text = append_if_present(text, CLASS_JOINER, F.col("text_grp_2"))
    if use_mentions:
        text = F.concat(text, F.lit(SEP), F.col("context"))
        text = append_if_present(text, SEP, F.col("mentioned_groups_grp_2"))
    return text


def tokens(text) -> Column:
    """Lower-case word runs, single punctuation marks and the separator; a missing text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def set_text(items) -> Column:
    """Sorted elements in one string; the empty set gives the empty string."""
    return F.array_join(F.array_sort(items), CLASS_JOINER)


def shingles(text, size: int) -> Column:
    """Distinct substrings of ``size`` characters, none for shorter texts; one pass along the text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))
