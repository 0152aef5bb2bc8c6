"""Text, tokens and class arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import arrays, text
from pairloom.operators import context_codes, dictionary, pair_features, vocabulary
from pairloom.operators.positions import with_batch
from pairloom.plans import translation
from pairloom.queries import common as c
from pairloom.queries.aggregates import MENTIONS_SQL
from pairloom.queries.projections import ENTRIES_SQL
from pairloom.queries.scans import LINKS_SQL, WORDS_SQL, document_words
from pairloom.session import scratch_path
from pairloom.sources import views

register = c.Registry()
QUERIES, SQL = register.queries, register.sql

BATCH = 32


@register(
    c.with_ctes(
        *c.ENRICH_CTES,
        f"""SELECT id, {c.TEXT_SQL} AS text, {c.TEXT_SQL} || '[SEP]' || context
  || CASE WHEN mentioned_groups_grp_2 IS NULL THEN '' ELSE '[SEP]' || mentioned_groups_grp_2 END AS long_text
  FROM enriched""",
    )
)
def composed_text(spark, sf_dir):
    return c.enriched(spark, sf_dir).select(
        "id", text.model_text().alias("text"), text.model_text(use_mentions=True).alias("long_text")
    )


@register(f"SELECT doc_id, regexp_replace(text, '{c.BRACKET_SQL}', '', 'g') AS text FROM documents")
def bracket_removal(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", text.without_brackets("text").alias("text"))


@register(f"SELECT doc_id, lower(regexp_replace(text, '{c.BRACKET_SQL}', '', 'g')) AS text FROM documents")
def clean_description(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", text.clean_description("text").alias("text"))


@register(
    """SELECT doc_id, coalesce((SELECT string_agg(w, '; ' ORDER BY w) FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS w)), '')
  AS names FROM documents"""
)
def set_to_text(spark, sf_dir):
    """Capitalised words of each text as a sorted set."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    return views.table(spark, sf_dir, "documents").select("doc_id", text.set_text(found).alias("names"))


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        "SELECT id, "
        + ", ".join(f"CAST(score * 4 = {k} AS INTEGER) AS class_{k}" for k in range(5))
        + " FROM pairs",
    )
)
def one_hot_label(spark, sf_dir):
    hot = arrays.one_hot(arrays.class_of_score("score"))
    df = views.pairs(spark, sf_dir).select("id", hot.alias("hot"))
    return df.select("id", *[F.col("hot")[k].alias(f"class_{k}") for k in range(5)])


@register(
    c.with_ctes(
        *c.OOF_CTES,
        "rows AS (SELECT id, [" + ", ".join(c.VERSIONS) + "] AS v FROM oof)",
        "SELECT id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS label FROM rows",
    )
)
def class_argmax(spark, sf_dir):
    return c.oof_wide(spark, sf_dir).select("id", arrays.arg_max(F.array(*c.VERSIONS)).alias("label"))


@register(c.with_ctes(*c.OOF_CTES, "SELECT id, round(1 / (1 + exp(-alpha)), 6) AS pred FROM oof"))
def sigmoid_link(spark, sf_dir):
    return c.oof_wide(spark, sf_dir).select("id", c.r6(arrays.sigmoid(F.col("alpha")), "pred"))


@register(c.with_ctes(*c.ENRICH_CTES, "SELECT id, coalesce(text_grp_2, '') AS text_grp_2 FROM enriched"))
def null_to_empty(spark, sf_dir):
    return c.enriched(spark, sf_dir).select("id", F.coalesce("text_grp_2", F.lit("")).alias("text_grp_2"))


TOKENS_SQL = f"toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{c.TOKEN_SQL}') AS t FROM documents)"


@register(c.with_ctes(TOKENS_SQL, "SELECT doc_id, CAST(len(t) AS INTEGER) AS n, md5(array_to_string(t, ' ')) AS digest FROM toks"))
def token_count(spark, sf_dir):
    df = views.table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return df.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def encode_sql(key: str, source: str, max_len: str) -> tuple[str, ...]:
    """Vocabulary and ids over ``toks`` (key, t); ids as text between the two special ids."""
    return (
        f"""vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM
  (SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM toks) WHERE token <> '[sep]' GROUP BY token))""",
        f"""picked AS (SELECT {key}, i, t[i] AS token
  FROM toks, unnest(range(1, least(len(t), {max_len} - 2) + 1)) AS u(i))""",
        f"""ids AS (SELECT {key}, count(*) AS k, string_agg(CAST(CASE WHEN token = '[sep]' THEN 2 ELSE coalesce(token_id, 3) END
    AS VARCHAR), ' ' ORDER BY i) AS s FROM picked LEFT JOIN vocab USING (token) GROUP BY {key})""",
        f"""encoded AS (SELECT {key}, '1 ' || coalesce(s || ' ', '') || '2' AS ids, coalesce(k, 0) + 2 AS n
  FROM {source} LEFT JOIN ids USING ({key}))""",
    )


def _joined(name: str):
    return F.array_join(F.col(name).cast("array<string>"), " ").alias(name)


@register(
    c.with_ctes(
        TOKENS_SQL,
        *encode_sql("doc_id", "documents", "(len(t) + 2)"),
        "SELECT doc_id, ids, CAST(n AS INTEGER) AS n FROM encoded",
    )
)
def encode_tokens(spark, sf_dir):
    """Whole documents, without a length limit."""
    documents = views.table(spark, sf_dir, "documents")
    words = vocabulary.build_vocabulary(documents, "text")
    encoded = vocabulary.encode(documents, words, "doc_id", "text")
    return encoded.select("doc_id", _joined("ids"), F.size("ids").alias("n"))


BUDGET_COLUMNS = ["anchor", "target", "text_grp_1", "text_grp_2"]
PAIR_ENCODE_CTES = (
    *c.ENRICH_CTES,
    f"texts AS (SELECT id, {c.TEXT_SQL} AS text FROM enriched)",
    f"toks AS (SELECT id, regexp_extract_all(lower(text), '{c.TOKEN_SQL}') AS t FROM texts)",
    "budget AS (SELECT "
    + " + ".join(f"max(len(regexp_extract_all(lower(coalesce({col}, '')), '{c.TOKEN_SQL}')))" for col in BUDGET_COLUMNS)
    + " + 4 AS max_len FROM enriched)",
    *encode_sql("id", "texts", "(SELECT max_len FROM budget)"),
)


def encoded_pairs(spark, sf_dir):
    """Model texts as ids, at most as long as the budget of their columns allows, and the budget."""
    df = c.composed(spark, sf_dir)
    budget = vocabulary.token_budget(df, BUDGET_COLUMNS).first().max_len
    words = vocabulary.build_vocabulary(df, "text")
    return vocabulary.encode(df, words, "id", "text", budget), budget


@register(
    c.with_ctes(
        *PAIR_ENCODE_CTES,
        f"batched AS (SELECT *, (row_number() OVER (ORDER BY {c.sql_key('id', 42)}, id) - 1) // {BATCH} AS batch FROM encoded)",
        "longest AS (SELECT *, max(n) OVER (PARTITION BY batch) AS m FROM batched)",
        """SELECT id, batch, ids || repeat(' 0', m - n) AS ids,
  '1' || repeat(' 1', n - 1) || repeat(' 0', m - n) AS attention_mask FROM longest""",
    )
)
def dynamic_padding(spark, sf_dir):
    # Ids alone are numbered: numbering reads its input twice, and token ids are costly to find.
    numbered = with_batch(views.pairs(spark, sf_dir).select("id"), BATCH)
    padded = vocabulary.pad_in_batches(encoded_pairs(spark, sf_dir)[0].join(numbered, "id"))
    return padded.select("id", "batch", _joined("ids"), _joined("attention_mask"))


@register(
    c.with_ctes(
        *PAIR_ENCODE_CTES,
        """SELECT id, ids || repeat(' 0', (SELECT max_len FROM budget) - n) AS ids,
  '1' || repeat(' 1', n - 1) || repeat(' 0', (SELECT max_len FROM budget) - n) AS attention_mask FROM encoded""",
    )
)
def static_padding(spark, sf_dir):
    encoded, budget = encoded_pairs(spark, sf_dir)
    return vocabulary.pad_to(encoded, budget).select("id", _joined("ids"), _joined("attention_mask"))


def _trigrams_sql(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - 1, 1)), lambda i: substr({x}, i, 3)))"


def _jaccard_sql(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} > 0 THEN len(list_intersect({a}, {b})) / {union} ELSE 0 END"


FEATURES_SQL = f"""features AS (SELECT id,
  round({_jaccard_sql(f"regexp_extract_all(anchor, '{c.TOKEN_SQL}')", f"regexp_extract_all(target, '{c.TOKEN_SQL}')")}, 6) AS token_jaccard,
  round({_jaccard_sql(_trigrams_sql('anchor'), _trigrams_sql('target'))}, 6) AS trigram_jaccard,
  CAST(levenshtein(anchor, target) AS DOUBLE) AS edit_distance,
  round(least(length(anchor), length(target)) / greatest(length(anchor), length(target)), 6) AS length_ratio,
  CAST(text_grp_2 IS NOT NULL AS DOUBLE) AS has_class_text,
  CAST(contains(lower(concat_ws(' ', text_grp_1, text_grp_2)), target) AS DOUBLE) AS target_in_text
  FROM enriched)"""


@register(c.with_ctes(*c.ENRICH_CTES, FEATURES_SQL, "SELECT * FROM features"))
def pair_similarity(spark, sf_dir):
    featured = pair_features.with_pair_features(c.enriched(spark, sf_dir))
    return featured.select("id", *[c.r6(F.col(name), name) for name in pair_features.FEATURES])


@register(
    c.with_ctes(
        WORDS_SQL,
        f"""done AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{c.TOKEN_SQL}')) AS term FROM benchmark)""",
        "todo AS (SELECT term FROM words WHERE term NOT IN (SELECT term FROM done))",
        f"""SELECT term, 'xx ' || term AS mapped,
  (row_number() OVER (ORDER BY {c.sql_key('term', 42)}, term) - 1) // 500 AS batch FROM todo
  UNION ALL SELECT term, 'known ' || term, CAST(NULL AS BIGINT) FROM done""",
    )
)
def dictionary_build(spark, sf_dir):
    """Words without an entry are mapped in batches by a Python function and stored."""
    known = views.table(spark, sf_dir, "benchmark").select(F.explode(text.tokens(F.col("text"))).alias("term"))
    done = known.distinct().select("term", F.concat(F.lit("known "), "term").alias("mapped"))
    path = scratch_path(spark, "built")
    return translation.build_dictionary(document_words(spark, sf_dir), lambda s: "xx " + s, path, done)


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        """SELECT id, 'xx ' || anchor AS anchor, 'xx ' || target AS target, context, score FROM pairs""",
    )
)
def translated_pairs(spark, sf_dir):
    """Distinct phrases mapped once, then put into every row."""
    df = views.pairs(spark, sf_dir)
    path = scratch_path(spark, "phrases")
    terms = dictionary.distinct_terms(df, ["anchor", "target"])
    entries = translation.build_dictionary(terms, lambda s: "xx " + s, path)
    return translation.translated_pairs(df, entries.select("term", "mapped")).select(*df.columns)


@register(c.with_ctes(c.CLASSES_SQL, "SELECT context, 'xx ' || description AS description, mentioned_groups FROM classes"))
def translated_classes(spark, sf_dir):
    mapped = translation.translated_dimension(views.classes(spark, sf_dir), "description", lambda s: "xx " + s)
    return mapped.select("context", "description", "mentioned_groups")


@register(
    c.with_ctes(
        LINKS_SQL,
        ENTRIES_SQL,
        MENTIONS_SQL,
        """SELECT e.context, string_agg(e.description, '' ORDER BY e.page_id, e.place) AS description,
  coalesce(any_value(m.codes), '') AS mentioned_groups
  FROM entries e LEFT JOIN mention_text m USING (context) GROUP BY e.context""",
    )
)
def context_dictionary(spark, sf_dir):
    return context_codes.context_dictionary(views.page_links(spark, sf_dir))
