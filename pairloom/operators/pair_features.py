"""Lexical similarity of anchor and target, computed row by row inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text

FEATURES = ["token_jaccard", "trigram_jaccard", "edit_distance", "length_ratio", "has_class_text", "target_in_text"]


def _jaccard(left: str, right: str, both: str) -> Column:
    """Share of common elements; all three columns are counts of distinct elements."""
    union = F.col(left) + F.col(right) - F.col(both)
    return F.when(union > 0, F.col(both) / union).otherwise(F.lit(0.0))


def with_pair_features(df: DataFrame) -> DataFrame:
    """``df`` is enriched; missing phrases count as empty.

    Token and trigram sets are columns of their own, so that each is built once for a row.
    """
    anchor, target = F.col("_anchor"), F.col("_target")
    sets = (
        df.withColumns(
            {
                "_anchor": F.lower(F.coalesce("anchor", F.lit(""))),
                "_target": F.lower(F.coalesce("target", F.lit(""))),
            }
        )
        .withColumns(
            {
                "_words_a": F.array_distinct(text.tokens(anchor)),
                "_words_t": F.array_distinct(text.tokens(target)),
                "_grams_a": text.shingles(anchor, 3),
                "_grams_t": text.shingles(target, 3),
            }
        )
        .withColumns(
            {
                "_words_both": F.size(F.array_intersect("_words_a", "_words_t")),
                "_grams_both": F.size(F.array_intersect("_grams_a", "_grams_t")),
                **{f"{name}_n": F.size(name) for name in ("_words_a", "_words_t", "_grams_a", "_grams_t")},
            }
        )
    )
    longest = F.greatest(F.length(anchor), F.length(target))
    context = F.lower(F.concat_ws(" ", "text_grp_1", "text_grp_2"))
    features = {
        "token_jaccard": _jaccard("_words_a_n", "_words_t_n", "_words_both"),
        "trigram_jaccard": _jaccard("_grams_a_n", "_grams_t_n", "_grams_both"),
        "edit_distance": F.levenshtein(anchor, target).cast("double"),
        "length_ratio": F.when(longest > 0, F.least(F.length(anchor), F.length(target)) / longest).otherwise(
            F.lit(0.0)
        ),
        "has_class_text": F.col("text_grp_2").isNotNull().cast("double"),
        "target_in_text": F.contains(context, target).cast("double"),
    }
    return sets.select(*df.columns, *[value.alias(name) for name, value in features.items()])
