"""Streaming scoring and meters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions.arrays import sigmoid
from pairloom.operators.pair_features import with_pair_features
from pairloom.queries import common as c
from pairloom.queries.ordering import STEPS_SQL
from pairloom.queries.texts import FEATURES_SQL
from pairloom.sources import views
from pairloom.streaming import meter, scoring

register = c.Registry()
QUERIES, SQL = register.queries, register.sql


def arriving(spark, sf_dir, name):
    schema = views.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@register(
    c.with_ctes(
        *c.ENRICH_CTES,
        FEATURES_SQL,
        f"""SELECT e.id, {c.TEXT_SQL} AS text,
  round(1 / (1 + exp(-(1.5 * token_jaccard + trigram_jaccard - 0.1 * edit_distance))), 6) AS pred
  FROM enriched e JOIN features f ON f.id = e.id""",
    )
)
def stream_scoring(spark, sf_dir):
    """Arriving orders are enriched and scored; the static tables are joined in each batch."""
    pairs = views.pairs(spark, sf_dir, orders=arriving(spark, sf_dir, "orders"))

    def score(df):
        rounded = with_pair_features(df)
        margin = (
            1.5 * F.round("token_jaccard", 6) + F.round("trigram_jaccard", 6) - 0.1 * F.col("edit_distance")
        )
        return rounded.select("id", "text", c.r6(sigmoid(margin), "pred"))

    return scoring.score_available(pairs, views.sections(spark, sf_dir), views.classes(spark, sf_dir), score)


@register(
    c.with_ctes(
        STEPS_SQL,
        "SELECT run, fold, count(*) AS steps, sum(loss * n) / sum(n) AS avg FROM steps GROUP BY run, fold",
    )
)
def stream_meter(spark, sf_dir):
    steps = views.steps(spark, sf_dir, events=arriving(spark, sf_dir, "events"))
    result = meter.run_complete(meter.meter_by_key(steps, ["run", "fold"]))
    return result.select("run", "fold", "steps", "avg")


@register(
    """SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS run,
  count(*) AS steps, sum(round(value * 100) * (1 + event_id % 32)) / sum(1 + event_id % 32) AS avg
FROM events GROUP BY 1, 2"""
)
def stream_window_meter(spark, sf_dir):
    """Hourly windows, those that the watermark has not closed yet among them."""
    steps = views.steps(spark, sf_dir, events=arriving(spark, sf_dir, "events"), keep_time=True)
    result = meter.run_update(meter.meter_by_window(steps, ["run"], "ts", "1 hour", "10 minutes"), ["window", "run"])
    start = F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return result.select(start, "run", "steps", "avg")
