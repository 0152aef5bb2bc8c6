"""Aggregations, losses, scores and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import arrays, metrics
from pairloom.operators import context_codes, dictionary, distribution, enrich, evaluation, vocabulary
from pairloom.operators.positions import with_batch
from pairloom.operators.rank_cuts import assign_split
from pairloom.queries import common as c
from pairloom.queries.joins import phrase_dictionary
from pairloom.queries.projections import ENTRIES_SQL, entries, stored_entries
from pairloom.queries.scans import LINKS_SQL
from pairloom.sources import views

register = c.Registry()
QUERIES, SQL = register.queries, register.sql

MODELS = [*c.VERSIONS, "blend"]
BLEND_SQL = "(" + " + ".join(c.VERSIONS) + f") / {len(c.VERSIONS)}"


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        """SELECT k / 4 AS score, round(coalesce(n, 0) / (SELECT count(*) FROM pairs), 6) AS share
  FROM range(0, 5) AS r(k) LEFT JOIN (SELECT score, count(*) AS n FROM pairs GROUP BY score) AS s ON s.score = k / 4""",
    )
)
def label_distribution(spark, sf_dir):
    shares = distribution.label_distribution(views.pairs(spark, sf_dir))
    return shares.select("score", c.r6(F.col("share"), "share"))


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        """SELECT substr(context, 1, 1) AS section, round(count(*) / (SELECT count(*) FROM pairs), 6) AS share
  FROM pairs GROUP BY 1""",
    )
)
def section_distribution(spark, sf_dir):
    shares = distribution.section_distribution(views.pairs(spark, sf_dir))
    return shares.select("section", c.r6(F.col("share"), "share"))


@register(c.with_ctes(*c.FOLD_CTES, "SELECT fold, count(*) AS n FROM folds GROUP BY fold"))
def fold_counts(spark, sf_dir):
    return c.folded(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"))


@register(c.with_ctes(c.PAIRS_SQL, "SELECT count(*) AS n FROM pairs"))
def row_count(spark, sf_dir):
    return views.pairs(spark, sf_dir).agg(F.count("*").alias("n"))


@register(
    """WITH edges AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
bins AS (SELECT CAST(least(floor(10.0::DOUBLE * (o_totalprice - lo) / (hi - lo)) + 1, 10) AS INTEGER) AS bin, count(*) AS n
  FROM orders, edges GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, round(lo + (hi - lo) / 10 * (b - 1), 6) AS lower,
       round(lo + (hi - lo) / 10 * b, 6) AS upper, coalesce(n, 0) AS n
FROM range(1, 11) AS r(b) CROSS JOIN edges LEFT JOIN bins ON bin = b"""
)
def score_histogram(spark, sf_dir):
    bins = distribution.histogram(views.table(spark, sf_dir, "orders"), "o_totalprice", 10)
    return bins.select("bin", c.r6(F.col("lower"), "lower"), c.r6(F.col("upper"), "upper"), "n")


@register(
    c.with_ctes(
        LINKS_SQL,
        ENTRIES_SQL,
        "SELECT context, string_agg(description, '' ORDER BY page_id, place) AS description FROM entries GROUP BY context",
    )
)
def description_concat(spark, sf_dir):
    span = F.floor(F.col("page_id") / 4096)
    return context_codes.ordered_concat(stored_entries(spark, sf_dir), "context", "description", ["page_id", "place"], span)


MENTIONS_SQL = """mentions AS (
  SELECT DISTINCT e.context, k.code FROM entries e
  JOIN (SELECT DISTINCT context AS code FROM entries) k ON contains(e.raw, k.code)),
mention_text AS (SELECT context, string_agg(code, '; ' ORDER BY code) AS codes FROM mentions GROUP BY context)"""


@register(
    c.with_ctes(
        LINKS_SQL,
        ENTRIES_SQL,
        MENTIONS_SQL,
        """SELECT context, coalesce(codes, '') AS mentioned_groups
  FROM (SELECT DISTINCT context FROM entries) LEFT JOIN mention_text USING (context)""",
    )
)
def mention_union(spark, sf_dir):
    found = stored_entries(spark, sf_dir)
    mentions = context_codes.mentioned_codes(found, context_codes.code_dictionary(found))
    return context_codes.mention_sets(found, mentions)


@register(
    c.with_ctes(c.PAIRS_SQL, "SELECT DISTINCT term FROM (SELECT anchor AS term FROM pairs UNION ALL SELECT target FROM pairs)")
)
def distinct_phrases(spark, sf_dir):
    return dictionary.distinct_terms(views.pairs(spark, sf_dir), ["anchor", "target"])


@register(c.with_ctes(*c.OOF_CTES, "SELECT * FROM oof"))
def prediction_pivot(spark, sf_dir):
    long = c.oof_long(spark, sf_dir)
    return evaluation.pivot_predictions(long, c.VERSIONS, ["id", "fold", "score"], F.col("version"))


@register(
    c.with_ctes(
        *c.ENRICH_CTES,
        """SELECT round(avg(CASE WHEN text_grp_1 IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_text_grp_1,
  round(avg(CASE WHEN text_grp_2 IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_text_grp_2,
  round(avg(CASE WHEN mentioned_groups_grp_2 IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_mentioned_groups_grp_2
  FROM enriched""",
    )
)
def missing_rate(spark, sf_dir):
    columns = ["text_grp_1", "text_grp_2", "mentioned_groups_grp_2"]
    rates = c.enriched(spark, sf_dir).agg(*enrich.missing_rate(columns))
    return rates.select(*[c.r6(F.col(name), name) for name in rates.columns])


@register(c.with_ctes(*c.ENRICH_CTES, "SELECT DISTINCT context FROM enriched WHERE text_grp_2 IS NULL"))
def missing_codes(spark, sf_dir):
    return enrich.missing_codes(c.enriched(spark, sf_dir))


@register(
    c.with_ctes(
        *c.OOF_CTES,
        f"""SELECT CAST(fold AS VARCHAR) AS fold, round({c.sql_pearson('score', 'alpha')}, 6) AS pearson FROM oof GROUP BY fold
  UNION ALL SELECT 'all', round({c.sql_pearson('score', 'alpha')}, 6) FROM oof""",
    )
)
def pearson_by_fold(spark, sf_dir):
    """Score of each fold and of all rows; both come from one pass over the rows."""
    grouped = c.oof_wide(spark, sf_dir).rollup("fold").agg(metrics.pearson(F.col("score"), F.col("alpha")).alias("pearson"))
    return grouped.select(
        F.coalesce(F.col("fold").cast("string"), F.lit("all")).alias("fold"), c.r6(F.col("pearson"), "pearson")
    )


def board_sql(source: str, models: list[str]) -> str:
    return "board AS (" + " UNION ALL ".join(
        f"SELECT fold, dataset, '{m}' AS model, {c.sql_pearson('score', m)} AS score FROM {source} GROUP BY fold, dataset"
        for m in models
    ) + ")"


BOARD_CTES = (
    *c.OOF_CTES,
    c.split_sql("oof", "score", c.sql_key("id", 39), groups="fold", col="part"),
    f"judged AS (SELECT *, 'em_' || part || '_set' AS dataset, {BLEND_SQL} AS blend FROM parted)",
    board_sql("judged", MODELS),
)


def board(spark, sf_dir):
    """Scores of the prediction sets and their plain mean on both sides of each fold."""
    parted = assign_split(c.stored_oof(spark, sf_dir), "score", 0.2, 39, groups=("fold",), name="part")
    judged = parted.withColumns(
        {
            "dataset": F.concat(F.lit("em_"), "part", F.lit("_set")),
            "blend": evaluation.row_mean(c.VERSIONS),
        }
    )
    return evaluation.score_models(judged, MODELS, by=("fold", "dataset"))


@register(c.with_ctes(*BOARD_CTES, "SELECT fold, dataset, model, round(score, 6) AS score FROM board"))
def model_leaderboard(spark, sf_dir):
    return board(spark, sf_dir).select("fold", "dataset", "model", c.r6(F.col("score"), "score"))


MEAN_SQL = "means AS (SELECT model, dataset, avg(score) AS score FROM board GROUP BY model, dataset)"


@register(c.with_ctes(*BOARD_CTES, MEAN_SQL, "SELECT model, dataset, round(score, 6) AS score FROM means"))
def mean_leaderboard(spark, sf_dir):
    means = evaluation.mean_leaderboard(board(spark, sf_dir))
    return means.select("model", "dataset", c.r6(F.col("score"), "score"))


@register(
    c.with_ctes(
        *BOARD_CTES, MEAN_SQL, "SELECT model, dataset, round(score, 6) AS score FROM means WHERE dataset = 'em_test_set'"
    )
)
def test_set_leaderboard(spark, sf_dir):
    means = evaluation.mean_leaderboard(board(spark, sf_dir))
    return means.filter(F.col("dataset") == "em_test_set").select("model", "dataset", c.r6(F.col("score"), "score"))


BEST_SQL = "best AS (SELECT * FROM means WHERE dataset = 'em_test_set' ORDER BY score DESC, model LIMIT 1)"


@register(c.with_ctes(*BOARD_CTES, MEAN_SQL, BEST_SQL, "SELECT model, dataset, round(score, 6) AS score FROM best"))
def best_model(spark, sf_dir):
    best = evaluation.best_model(evaluation.mean_leaderboard(board(spark, sf_dir)))
    return best.select("model", "dataset", c.r6(F.col("score"), "score"))


@register(
    c.with_ctes(
        c.TEST_SQL,
        c.MATRIX_SQL,
        "SELECT id, round((" + " + ".join(f"alpha_fold_{k}" for k in c.FOLDS) + ") / 4, 9) AS score FROM matrix",
    )
)
def fold_mean_prediction(spark, sf_dir):
    """Mean over folds of predictions that arrive in long form."""
    long = c.test_long(spark, sf_dir).filter(F.col("version") == "alpha")
    return long.groupBy("id").agg(F.round(F.avg("pred"), 9).alias("score"))


@register(
    c.with_ctes(
        *c.ENRICH_CTES,
        "counts AS (SELECT "
        + ", ".join(
            f"CAST(max(len(regexp_extract_all(lower(coalesce({col}, '')), '{c.TOKEN_SQL}'))) AS INTEGER) AS {col}"
            for col in ("anchor", "target", "text_grp_1", "text_grp_2")
        )
        + " FROM enriched)",
        "SELECT *, anchor + target + text_grp_1 + text_grp_2 + 4 AS max_len FROM counts",
    )
)
def max_length_budget(spark, sf_dir):
    return vocabulary.token_budget(c.enriched(spark, sf_dir), ["anchor", "target", "text_grp_1", "text_grp_2"])


def _per_fold(spark, sf_dir, value, y=None, p=None):
    y = F.col("score") if y is None else y
    p = F.col("alpha") if p is None else p
    return c.oof_wide(spark, sf_dir).groupBy("fold").agg(c.r6(value(y, p), "loss"))


def _loss_sql(expr: str) -> str:
    return c.with_ctes(*c.OOF_CTES, f"SELECT fold, round({expr}, 6) AS loss FROM oof GROUP BY fold")


CLIPPED = "least(greatest(alpha, 0.0), 1.0)"


def _log_sql(q: str) -> str:
    return f"CASE WHEN {q} <= 0 THEN -100.0 ELSE greatest(ln({q}), -100.0) END"


@register(_loss_sql("avg((alpha - score) * (alpha - score))"))
def mse_loss(spark, sf_dir):
    return _per_fold(spark, sf_dir, metrics.loss("MSE"))


@register(_loss_sql(f"-avg(score * {_log_sql(CLIPPED)} + (1 - score) * {_log_sql(f'(1 - {CLIPPED})')})"))
def bce_loss(spark, sf_dir):
    return _per_fold(spark, sf_dir, metrics.loss("BCE"), p=F.least(F.greatest("alpha", F.lit(0.0)), F.lit(1.0)))


@register(_loss_sql("avg(greatest(alpha, 0.0) - alpha * score + ln(1 + exp(-abs(alpha))))"))
def bce_with_logits_loss(spark, sf_dir):
    return _per_fold(spark, sf_dir, metrics.loss("BCEWithLogits"))


@register(
    c.with_ctes(
        *c.OOF_CTES,
        """logits AS (SELECT fold, CAST(score * 4 AS INTEGER) AS label,
  list_transform([0, 1, 2, 3, 4], lambda k: -(4 * (alpha - k / 4)) * (4 * (alpha - k / 4))) AS z FROM oof)""",
        """SELECT fold, round(-avg(z[label + 1] - list_max(z)
    - ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))), 6) AS loss FROM logits GROUP BY fold""",
    )
)
def cross_entropy_loss(spark, sf_dir):
    gap = [4 * (F.col("alpha") - F.lit(level)) for level in arrays.LEVELS]
    logits = F.array(*[-g * g for g in gap])
    return _per_fold(spark, sf_dir, metrics.loss("CE"), arrays.class_of_score("score"), logits)


CCC_SQL = "(var_samp(alpha) + var_samp(score) + (avg(alpha) - avg(score)) * (avg(alpha) - avg(score)) + 1e-6)"


@register(_loss_sql("1 - covar_samp(score, alpha) / (stddev_samp(score) * stddev_samp(alpha))"))
def pcc_loss(spark, sf_dir):
    return _per_fold(spark, sf_dir, metrics.loss("PCC"))


@register(_loss_sql(f"1 - 2 * covar_samp(score, alpha) / {CCC_SQL}"))
def ccc_loss(spark, sf_dir):
    return _per_fold(spark, sf_dir, metrics.loss("CCC1"))


@register(_loss_sql(f"-2 * covar_samp(score, alpha) * (count(*) - 1) / {CCC_SQL}"))
def ccc_sum_loss(spark, sf_dir):
    return _per_fold(spark, sf_dir, metrics.loss("CCC2"))


@register(
    c.with_ctes(
        *c.OOF_CTES,
        f"batched AS (SELECT *, (row_number() OVER (ORDER BY {c.sql_key('id', 42)}, id) - 1) // 32 AS batch FROM oof)",
        """losses AS (SELECT batch, count(*) AS n, avg((alpha - score) * (alpha - score)) AS mse,
  1 - covar_samp(score, alpha) / (stddev_samp(score) * stddev_samp(alpha)) AS pcc FROM batched GROUP BY batch)""",
        """SELECT 'MSE' AS loss, round(arg_max(mse, batch), 6) AS last_loss, round(sum(mse * n) / sum(n), 6) AS avg_loss FROM losses
  UNION ALL SELECT 'PCC', round(arg_max(pcc, batch), 6), round(sum(pcc * n) / sum(n), 6) FROM losses""",
    )
)
def batched_loss(spark, sf_dir):
    batches = with_batch(c.oof_wide(spark, sf_dir).select("id", "score", "alpha"), 32)
    losses = {name: metrics.loss(name)(F.col("score"), F.col("alpha")) for name in ("MSE", "PCC")}
    rows = evaluation.batched_loss(batches, losses)
    return rows.select("loss", c.r6(F.col("last_loss"), "last_loss"), c.r6(F.col("avg_loss"), "avg_loss"))


@register(
    c.with_ctes(
        *c.OOF_CTES,
        f"""SELECT fold, round(-avg(abs(alpha - score)), 6) AS neg_mean_absolute_error,
  round(-avg((alpha - score) * (alpha - score)), 6) AS neg_mean_squared_error,
  round(1 - sum((alpha - score) * (alpha - score)) / (var_pop(score) * count(*)), 6) AS r2,
  round({c.sql_pearson('score', 'alpha')}, 6) AS corr_scorer FROM oof GROUP BY fold""",
    )
)
def regression_scorers(spark, sf_dir):
    scores = [c.r6(score(F.col("score"), F.col("alpha")), name) for name, score in metrics.SCORERS.items()]
    return c.oof_wide(spark, sf_dir).groupBy("fold").agg(*scores)


# ---- set operations -------------------------------------------------------


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        """entries AS (SELECT DISTINCT term, CASE WHEN length(term) > 6 THEN 'new ' || term ELSE 'old ' || term END AS mapped
  FROM (SELECT anchor AS term FROM pairs UNION ALL SELECT target FROM pairs) WHERE term <> 'machinery')""",
        """SELECT id, anchor, target, context, score, CAST(NULL AS VARCHAR) AS lang FROM pairs
  UNION ALL SELECT p.id, a.mapped, t.mapped, p.context, p.score, 'zh-tw' FROM pairs p
  LEFT JOIN entries a ON a.term = p.anchor LEFT JOIN entries t ON t.term = p.target""",
    )
)
def union_translated(spark, sf_dir):
    """Original rows lack the language column and get null there."""
    df = views.pairs(spark, sf_dir)
    translated = dictionary.substitute(df, phrase_dictionary(spark, sf_dir), ["anchor", "target"])
    return dictionary.with_translated(df, translated.withColumn("lang", F.lit("zh-tw")))


@register(c.with_ctes(*c.OOF_CTES, "SELECT id, fold, score, alpha AS pred FROM oof"))
def union_folds(spark, sf_dir):
    """All folds stay one table, so their union is a scan of it."""
    wide = c.oof_wide(spark, sf_dir).filter(F.col("fold").isin(c.FOLDS))
    return wide.select("id", "fold", "score", F.col("alpha").alias("pred"))


@register(c.with_ctes(*c.OOF_CTES, c.LONG_SQL, "SELECT version, count(*) AS n, round(avg(pred), 6) AS mean_pred FROM long GROUP BY version"))
def union_versions(spark, sf_dir):
    return c.oof_long(spark, sf_dir).groupBy("version").agg(F.count("*").alias("n"), c.r6(F.avg("pred"), "mean_pred"))


@register(
    c.with_ctes(*BOARD_CTES, "SELECT dataset, count(*) AS n, round(min(score), 6) AS low, round(max(score), 6) AS high FROM board GROUP BY dataset")
)
def union_perf(spark, sf_dir):
    """Both sides and all folds are one table from the start."""
    return board(spark, sf_dir).groupBy("dataset").agg(
        F.count("*").alias("n"), c.r6(F.min("score"), "low"), c.r6(F.max("score"), "high")
    )


@register(c.with_ctes(LINKS_SQL, ENTRIES_SQL, "SELECT DISTINCT context FROM entries"))
def code_dictionary(spark, sf_dir):
    return context_codes.code_dictionary(entries(spark, sf_dir))
