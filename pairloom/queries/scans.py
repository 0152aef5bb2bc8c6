"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import dictionary, evaluation
from pairloom.operators.positions import with_batch
from pairloom.plans import base_models
from pairloom.queries import common as c
from pairloom.session import scratch_path, written
from pairloom.sources import claims, schemas, tables, views

register = c.Registry()
QUERIES, SQL = register.queries, register.sql

# The upper case of ß is SS; the SQL engine keeps a single letter, so its SQL spells that out.
LINKS_SQL = """lists AS (
  SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS page_title,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS codes,
         regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS titles
  FROM pages),
links AS (
  SELECT page_id, CAST(i - 1 AS INTEGER) AS place, replace(codes[i], '/', '') AS symbol,
         titles[i] AS title, page_title
  FROM lists, unnest(range(1, least(len(codes), len(titles)) + 1)) AS u(i))"""

WORDS_SQL = f"""words AS (
  SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{c.TOKEN_SQL}')) AS term FROM documents)"""


def document_words(spark, sf_dir):
    """Distinct words, found once and stored: numbering and resuming read them again."""
    words = views.table(spark, sf_dir, "documents").select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return written(dictionary.distinct_terms(words, ["term"]), "words")


@register(c.with_ctes(c.PAIRS_SQL, "SELECT * FROM pairs"))
def fact_csv_scan(spark, sf_dir):
    path = scratch_path(spark, "pairs-csv")
    tables.write_csv(views.pairs(spark, sf_dir).select(*schemas.PAIRS_TRAIN.fieldNames()), path)
    return tables.read_csv(spark, path, schemas.PAIRS_TRAIN)


@register(c.with_ctes(c.SECTIONS_SQL, "SELECT context_grp_1, reverse(text_grp_1) AS text_grp_1 FROM sections"))
def dimension_language_scan(spark, sf_dir):
    return tables.dimension_in_language(views.sections_all_languages(spark, sf_dir), "zh-TW")


@register(
    c.with_ctes(
        WORDS_SQL,
        f"""SELECT term AS en, 'zh ' || term AS zh_tw,
  (row_number() OVER (ORDER BY {c.sql_key('term', 42)}, term) - 1) // 500 AS batch FROM words""",
    )
)
def dictionary_parts_scan(spark, sf_dir):
    path = scratch_path(spark, "dictionary")
    batches = with_batch(document_words(spark, sf_dir), 500, id_col="term")
    tables.write_dictionary_parts(batches.withColumn("mapped", F.concat(F.lit("zh "), "term")), path)
    return tables.read_dictionary_parts(spark, path, "zh-TW")


@register(c.with_ctes(*c.OOF_CTES, c.LONG_SQL, "SELECT * FROM long WHERE version IN ('alpha', 'gamma')"))
def versioned_oof_scan(spark, sf_dir):
    path = scratch_path(spark, "versions")
    tables.write_versioned(c.oof_long(spark, sf_dir), path)
    return tables.read_versions(spark, path, ["alpha", "gamma"])


@register(
    c.with_ctes(c.TEST_SQL, f"SELECT id, {c.sql_prediction(0.6, 'alpha')} AS score FROM (SELECT *, 0.5::DOUBLE AS score FROM test_pairs)")
)
def csv_table_sink(spark, sf_dir):
    path = scratch_path(spark, "submission")
    scored = views.test_pairs(spark, sf_dir).withColumn("score", F.lit(0.5))
    tables.write_csv(scored.select("id", views.prediction(0.6, "alpha").alias("score")), path)
    return tables.read_csv(spark, path, schemas.SUBMISSION)


@register(
    c.with_ctes(
        *c.OOF_CTES,
        "scores AS ("
        + " UNION ALL ".join(f"SELECT '{v}' AS model, {c.sql_pearson('score', v)} AS s FROM oof" for v in c.VERSIONS)
        + ")",
        "SELECT model AS best_model FROM scores ORDER BY s DESC, model LIMIT 1",
    )
)
def json_marker(spark, sf_dir):
    path = scratch_path(spark, "marker")
    scored = c.oof_wide(spark, sf_dir).withColumn("dataset", F.lit("em_test_set"))
    board = evaluation.score_models(scored, c.VERSIONS, by=("dataset",))
    tables.write_marker(evaluation.best_model(board), path)
    return tables.read_marker(spark, path)


@register(c.with_ctes(c.PAIRS_SQL, "SELECT 'first' AS version, count(*) AS n, true AS kept FROM pairs"))
def versioned_write_guard(spark, sf_dir):
    """The second write of a version is refused and leaves the first one as it was."""
    path = scratch_path(spark, "guarded")
    rows = views.pairs(spark, sf_dir).select("id").withColumn("version", F.lit("first"))
    claims.write_new_version(rows, path)
    replaced = claims.write_new_version(rows.withColumn("version", F.lit("second")), path)
    return (
        tables.read_table(spark, path)
        .groupBy("version")
        .agg(F.count("*").alias("n"))
        .withColumn("kept", F.lit(not replaced))
    )


@register(c.with_ctes(c.PAIRS_SQL, "SELECT id, true AS same FROM pairs"))
def model_save_load(spark, sf_dir):
    """A stored fold model predicts the same as the one in memory."""
    path = scratch_path(spark, "models")
    df = base_models.with_features(c.composed(spark, sf_dir))
    fitted = base_models.estimator("linear").fit(df)
    base_models.save_models({0: fitted}, path, "base")
    loaded = base_models.load_models(path, "base", (0,))[0]
    both = loaded.setPredictionCol("b").transform(fitted.setPredictionCol("a").transform(df))
    return both.select("id", (F.abs(F.col("a") - F.col("b")) < 1e-9).alias("same"))


@register(c.with_ctes(LINKS_SQL, "SELECT * FROM links"))
def page_link_extraction(spark, sf_dir):
    return views.page_links(spark, sf_dir).drop("raw")
