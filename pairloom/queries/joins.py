"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import arrays, text
from pairloom.operators import context_codes, dictionary, distribution, enrich, evaluation
from pairloom.queries import common as c
from pairloom.queries.projections import ENTRIES_SQL, stored_entries
from pairloom.queries.scans import LINKS_SQL, WORDS_SQL, document_words
from pairloom.sources import views

register = c.Registry()
QUERIES, SQL = register.queries, register.sql


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        c.SECTIONS_SQL,
        """SELECT p.id, p.context, s.context_grp_1, s.text_grp_1 FROM pairs p
  LEFT JOIN sections s ON s.context_grp_1 = substr(p.context, 1, 1)""",
    )
)
def section_join(spark, sf_dir):
    joined = enrich.join_sections(views.pairs(spark, sf_dir), views.sections(spark, sf_dir))
    return joined.select("id", "context", "context_grp_1", "text_grp_1")


@register(
    c.with_ctes(
        *c.ENRICH_CTES, "SELECT id, context, text_grp_1, text_grp_2, mentioned_groups_grp_2 FROM enriched"
    )
)
def class_join(spark, sf_dir):
    return c.enriched(spark, sf_dir).select("id", "context", "text_grp_1", "text_grp_2", "mentioned_groups_grp_2")


def phrase_dictionary(spark, sf_dir):
    """Entries for the phrases but one, longer phrases with a second, later entry."""
    terms = dictionary.distinct_terms(views.pairs(spark, sf_dir), ["anchor", "target"])
    known = terms.filter(F.col("term") != "machinery")
    first = known.select("term", F.concat(F.lit("old "), "term").alias("mapped"), F.lit(0).alias("seq"))
    later = known.filter(F.length("term") > 6).select(
        "term", F.concat(F.lit("new "), "term").alias("mapped"), F.lit(1).alias("seq")
    )
    return dictionary.last_entries(first.unionByName(later), "seq")


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        """terms AS (SELECT DISTINCT term FROM (SELECT anchor AS term FROM pairs UNION ALL SELECT target FROM pairs)
  WHERE term <> 'machinery')""",
        """entries AS (SELECT term, CASE WHEN length(term) > 6 THEN 'new ' || term ELSE 'old ' || term END AS mapped
  FROM terms)""",
        """SELECT p.id, a.mapped AS anchor, t.mapped AS target, p.context, p.score FROM pairs p
  LEFT JOIN entries a ON a.term = p.anchor LEFT JOIN entries t ON t.term = p.target""",
    )
)
def dictionary_substitution(spark, sf_dir):
    entries_table = phrase_dictionary(spark, sf_dir)
    replaced = dictionary.substitute(views.pairs(spark, sf_dir), entries_table, ["anchor", "target"])
    return replaced.select("id", "anchor", "target", "context", "score")


@register(c.with_ctes(c.PAIRS_SQL, "SELECT id, CAST(score * 4 AS INTEGER) AS score_map FROM pairs"))
def score_class_map(spark, sf_dir):
    return views.pairs(spark, sf_dir).select("id", arrays.class_of_score("score").alias("score_map"))


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        """shares AS (SELECT substr(context, 1, 1) AS section, count(*) / (SELECT count(*) FROM pairs) AS share
  FROM pairs GROUP BY 1)""",
        "SELECT id, section, round(share, 6) AS share FROM pairs JOIN shares ON section = substr(context, 1, 1)",
    )
)
def frequency_attach(spark, sf_dir):
    df = views.pairs(spark, sf_dir).withColumn("section", text.section_of("context"))
    shared = distribution.attach_share(df, distribution.section_distribution(df), "section")
    return shared.select("id", "section", c.r6(F.col("share"), "share"))


@register(c.with_ctes(*c.OOF_CTES, "SELECT id, alpha, beta FROM oof"))
def prediction_alignment(spark, sf_dir):
    """Two prediction tables side by side, matched by id."""
    long = c.oof_long(spark, sf_dir)
    return evaluation.pivot_predictions(
        long.filter(F.col("version").isin("alpha", "beta")), ["alpha", "beta"], ["id"], F.col("version")
    )


@register(
    c.with_ctes(
        LINKS_SQL,
        ENTRIES_SQL,
        "codes AS (SELECT DISTINCT context AS code FROM entries)",
        "texts AS (SELECT DISTINCT raw FROM entries)",
        "SELECT raw, code FROM texts JOIN codes ON contains(raw, code)",
    )
)
def mentioned_codes(spark, sf_dir):
    found = stored_entries(spark, sf_dir)
    return context_codes.mentioned_codes(found, context_codes.code_dictionary(found))


@register(
    c.with_ctes(
        LINKS_SQL,
        """SELECT page_id, CAST(i - 1 AS INTEGER) AS place, codes[i] AS code, titles[i] AS title
  FROM lists, unnest(range(1, least(len(codes), len(titles)) + 1)) AS u(i)""",
    )
)
def code_title_zip(spark, sf_dir):
    """Codes and titles are found on their own and paired by place."""
    return context_codes.listed_entries(views.table(spark, sf_dir, "pages"), (views.LINK, 1), (views.LINK, 2))


@register(
    c.with_ctes(
        WORDS_SQL,
        f"""done AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{c.TOKEN_SQL}')) AS term FROM benchmark)""",
        "SELECT term FROM words WHERE term NOT IN (SELECT term FROM done)",
    )
)
def remaining_terms(spark, sf_dir):
    done = views.table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("term"))
    return dictionary.remaining_terms(document_words(spark, sf_dir), done.distinct())
