"""Folds, splits, positions, running values, sorts and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.text import section_of
from pairloom.operators import distribution, positions, training_log
from pairloom.operators.rank_cuts import assign_folds, assign_repeated_split, assign_split
from pairloom.queries import common as c
from pairloom.queries.scans import WORDS_SQL, document_words
from pairloom.sources import views

register = c.Registry()
QUERIES, SQL = register.queries, register.sql


@register(c.with_ctes(*c.FOLD_CTES, "SELECT id, fold FROM folds"))
def stratified_kfold(spark, sf_dir):
    return c.folded(spark, sf_dir).select("id", "fold")


@register(
    c.with_ctes(c.PAIRS_SQL, c.split_sql("pairs", "score", c.sql_key("id", 39)), "SELECT id, side FROM parted")
)
def stratified_split(spark, sf_dir):
    return assign_split(views.pairs(spark, sf_dir), "score", 0.2, 39).select("id", "side")


REPEATED_SQL = "repeated AS (SELECT pairs.*, CAST(k AS INTEGER) AS split FROM pairs, range(0, 5) AS r(k))"
SPLIT_KEY = "md5(id || ':39:' || CAST(split AS VARCHAR))"


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        REPEATED_SQL,
        c.split_sql("repeated", "score", SPLIT_KEY, groups="split"),
        "SELECT id, split, side FROM parted",
    )
)
def repeated_stratified_split(spark, sf_dir):
    return assign_repeated_split(views.pairs(spark, sf_dir), "score").select("id", "split", "side")


@register(
    c.with_ctes(c.PAIRS_SQL, c.folds_sql("pairs", "context", 4, 42), "SELECT id, fold FROM folds")
)
def group_stratified_kfold(spark, sf_dir):
    return assign_folds(views.pairs(spark, sf_dir), "context").select("id", "fold")


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        REPEATED_SQL,
        c.split_sql("repeated", "context", SPLIT_KEY, groups="split"),
        "SELECT id, split, side FROM parted",
    )
)
def group_stratified_split(spark, sf_dir):
    return assign_repeated_split(views.pairs(spark, sf_dir), "context").select("id", "split", "side")


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        "shares AS (SELECT substr(context, 1, 1) AS s, count(*) / (SELECT count(*) FROM pairs) AS w FROM pairs GROUP BY 1)",
        f"keyed AS (SELECT id, -ln({c.sql_unit(c.sql_key('id', 42))}) / w AS k FROM pairs JOIN shares ON s = substr(context, 1, 1))",
        "SELECT id, row_number() OVER (ORDER BY k, id) - 1 AS position FROM keyed",
    )
)
def weighted_order(spark, sf_dir):
    df = views.pairs(spark, sf_dir).withColumn("section", section_of("context"))
    weights = distribution.section_distribution(df)
    return positions.weighted_position(df, weights, "section").select("id", "position")


@register(
    c.with_ctes(
        c.PAIRS_SQL, f"SELECT id, (row_number() OVER (ORDER BY {c.sql_key('id', 42)}, id) - 1) // 32 AS batch FROM pairs"
    )
)
def batch_numbers(spark, sf_dir):
    return positions.with_batch(views.pairs(spark, sf_dir), 32).select("id", "batch")


@register(
    c.with_ctes(
        WORDS_SQL,
        f"SELECT term, (row_number() OVER (ORDER BY {c.sql_key('term', 42)}, term) - 1) // 500 AS batch FROM words",
    )
)
def term_batches(spark, sf_dir):
    return positions.with_batch(document_words(spark, sf_dir), 500, id_col="term")


STEPS_SQL = """steps AS (SELECT event_type AS run, CAST(user_id % 4 AS INTEGER) AS fold,
  CAST(day(ts) AS INTEGER) AS epoch, event_id AS step, 1 + event_id % 32 AS n, round(value * 100) AS loss FROM events)"""
EPOCHS_SQL = "epochs AS (SELECT run, fold, epoch, avg(loss) AS score FROM steps GROUP BY run, fold, epoch)"


@register(
    c.with_ctes(
        STEPS_SQL,
        EPOCHS_SQL,
        """judged AS (SELECT *, row_number() OVER w = 1 OR coalesce(score > max(score) OVER
    (PARTITION BY run, fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS better
  FROM epochs WINDOW w AS (PARTITION BY run, fold ORDER BY epoch))""",
        """streaks AS (SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY run, fold ORDER BY epoch) AS streak
  FROM judged)""",
        """missed AS (SELECT *, sum(CASE WHEN better THEN 0 ELSE 1 END) OVER (PARTITION BY run, fold, streak ORDER BY epoch) AS m
  FROM streaks)""",
        "stops AS (SELECT run, fold, min(CASE WHEN m = 5 THEN epoch END) AS stop FROM missed GROUP BY run, fold)",
        """SELECT run, fold, max(CASE WHEN better THEN epoch END) AS best_epoch,
  arg_max(score, CASE WHEN better THEN epoch END) AS best_score, max(epoch) AS last_epoch,
  CAST(max(CASE WHEN stop IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS stopped
  FROM missed JOIN stops USING (run, fold) WHERE stop IS NULL OR epoch <= stop GROUP BY run, fold""",
    )
)
def early_stopping(spark, sf_dir):
    steps = views.steps(spark, sf_dir)
    epochs = steps.groupBy("run", "fold", "epoch").agg(F.avg("loss").alias("score"))
    return training_log.early_stopping(epochs, patience=5)


@register(
    c.with_ctes(
        STEPS_SQL,
        """SELECT run, fold, epoch, step, sum(loss * n) OVER w / sum(n) OVER w AS avg FROM steps
  WINDOW w AS (PARTITION BY run, fold, epoch ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    )
)
def running_meter(spark, sf_dir):
    metered = training_log.running_meter(views.steps(spark, sf_dir), ["run", "fold", "epoch"])
    return metered.select("run", "fold", "epoch", "step", "avg")


@register(c.with_ctes(c.PAIRS_SQL, f"SELECT * FROM pairs ORDER BY {c.sql_key('id', 42)}, id LIMIT 200"))
def sample_rows(spark, sf_dir):
    return distribution.sample_rows(views.pairs(spark, sf_dir), 200)


@register(
    c.with_ctes(
        c.PAIRS_SQL,
        "SELECT context, count(*) AS n, round(avg(score), 6) AS mean_score FROM pairs GROUP BY context ORDER BY context",
    )
)
def sorted_class_report(spark, sf_dir):
    """Grouped output in key order; the sort comes after the aggregation."""
    grouped = views.pairs(spark, sf_dir).groupBy("context")
    return grouped.agg(F.count("*").alias("n"), c.r6(F.avg("score"), "mean_score")).orderBy("context")


@register(c.with_ctes(c.PAIRS_SQL, "SELECT * FROM pairs ORDER BY id LIMIT 5"))
def head_rows(spark, sf_dir):
    return views.pairs(spark, sf_dir).orderBy("id").limit(5)
