"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import context_codes, enrich
from pairloom.plans import stacking
from pairloom.queries import common as c
from pairloom.queries.scans import LINKS_SQL
from pairloom.session import written
from pairloom.sources import views

register = c.Registry()
QUERIES, SQL = register.queries, register.sql

ENTRIES_SQL = f"""entries AS (
  SELECT page_id, place, symbol, substr(symbol, 1, 3) AS context, title || ' ' || page_title AS raw,
         CASE WHEN length(symbol) <= 3
              THEN lower(regexp_replace(title || ' ' || page_title, '{c.BRACKET_SQL}', '', 'g')) ELSE '' END
           AS description
  FROM links WHERE length(symbol) > 1)"""


def entries(spark, sf_dir):
    return context_codes.class_entries(views.page_links(spark, sf_dir))


def stored_entries(spark, sf_dir):
    """Pages are parsed once for the queries that read the entries several times."""
    return written(entries(spark, sf_dir), "entries")


@register(c.with_ctes(c.PAIRS_SQL, "SELECT id, substr(context, 1, 1) AS context_grp_1 FROM pairs"))
def section_code(spark, sf_dir):
    return views.pairs(spark, sf_dir).select("id", text.section_of("context").alias("context_grp_1"))


@register(c.with_ctes(LINKS_SQL, "SELECT page_id, place, substr(symbol, 1, 3) AS context FROM links"))
def class_code(spark, sf_dir):
    links = views.page_links(spark, sf_dir)
    return links.select("page_id", "place", text.class_of("symbol").alias("context"))


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        c.CLASSES_SQL,
        """SELECT p.id, c.description AS text_grp_2, c.mentioned_groups AS mentioned_groups_grp_2
  FROM pairs p LEFT JOIN classes c ON c.context = p.context""",
    )
)
def dimension_rename(spark, sf_dir):
    joined = enrich.join_classes(views.pairs(spark, sf_dir), views.classes(spark, sf_dir))
    return joined.select("id", *enrich.CLASS_COLUMNS.values())


@register(c.with_ctes(c.PAIRS_SQL, "SELECT id, score FROM pairs"))
def output_projection(spark, sf_dir):
    return views.pairs(spark, sf_dir).select("id", "score")


@register(
    c.with_ctes(c.TEST_SQL, c.MATRIX_SQL, "SELECT id, " + ", ".join(f"{v}_fold_1" for v in c.VERSIONS) + " FROM matrix")
)
def fold_columns_by_suffix(spark, sf_dir):
    matrix = stacking.fold_matrix(c.test_long(spark, sf_dir), c.VERSIONS, c.FOLDS)
    return matrix.select("id", *stacking.columns_of_fold(matrix.columns, 1))


@register(
    c.with_ctes(*c.FOLD_CTES, "SELECT id, fold, 'base' AS version, 'em_train_set' AS dataset FROM folds WHERE fold <> 0")
)
def constant_tags(spark, sf_dir):
    tagged = c.folded(spark, sf_dir).withColumns({"version": F.lit("base"), "dataset": F.lit("em_train_set")})
    return tagged.filter(F.col("fold") != 0).select("id", "fold", "version", "dataset")


@register(c.with_ctes(*c.FOLD_CTES, "SELECT id, CAST(fold AS INTEGER) AS fold, CAST(fold AS VARCHAR) AS fold_text FROM folds"))
def fold_cast(spark, sf_dir):
    return c.folded(spark, sf_dir).select(
        "id", F.col("fold").cast("int").alias("fold"), F.col("fold").cast("string").alias("fold_text")
    )


@register(
    c.with_ctes(
        *c.FOLD_CTES,
        """SELECT CASE WHEN fold = 1 THEN 'valid' ELSE 'train' END AS part, count(*) AS n, avg(score) AS mean_score
  FROM pairs JOIN folds USING (id) GROUP BY 1""",
    )
)
def fold_split(spark, sf_dir):
    """Sizes and mean label of both sides of one fold."""
    part = F.when(F.col("fold") == 1, "valid").otherwise("train")
    return c.folded(spark, sf_dir).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


@register(c.with_ctes(*c.FOLD_CTES, "SELECT id, fold FROM folds WHERE fold IN (0, 2)"))
def fold_subset(spark, sf_dir):
    return c.folded(spark, sf_dir).filter(F.col("fold").isin(0, 2)).select("id", "fold")


@register(c.with_ctes(*c.ENRICH_CTES, "SELECT id, context FROM enriched WHERE text_grp_2 IS NULL"))
def missing_class_rows(spark, sf_dir):
    return c.enriched(spark, sf_dir).filter(F.col("text_grp_2").isNull()).select("id", "context")


@register(c.with_ctes(LINKS_SQL, "SELECT page_id, place, symbol FROM links WHERE length(symbol) <> 1"))
def symbol_length_filter(spark, sf_dir):
    links = views.page_links(spark, sf_dir)
    return links.filter(F.length("symbol") != 1).select("page_id", "place", "symbol")


@register(c.with_ctes(LINKS_SQL, ENTRIES_SQL, "SELECT page_id, place, symbol, description FROM entries"))
def description_by_symbol_length(spark, sf_dir):
    return entries(spark, sf_dir).select("page_id", "place", "symbol", "description")


@register(
    c.with_ctes(
        *c.ENRICH_CTES,
        """SELECT id, CASE WHEN text_grp_2 IS NULL THEN text_grp_1 ELSE text_grp_1 || '; ' || text_grp_2 END AS context_text
  FROM enriched""",
    )
)
def optional_append(spark, sf_dir):
    appended = text.append_if_present(F.col("text_grp_1"), text.CLASS_JOINER, F.col("text_grp_2"))
    return c.enriched(spark, sf_dir).select("id", appended.alias("context_text"))
