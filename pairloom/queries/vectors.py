"""Vector pooling, normalisation and batch scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pairloom.functions import arrays
from pairloom.operators import pooling
from pairloom.plans import base_models
from pairloom.queries import common as c
from pairloom.sources import views

register = c.Registry()
QUERIES, SQL = register.queries, register.sql

WIDTH = 64
# Weights of the linear test model.
WEIGHTS = [((i % 7) - 3) / 10 for i in range(WIDTH)]
WEIGHTS_SQL = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"
CELLS_SQL = "unnest(range(1, 65)) AS u(i)"


def _place():
    return F.col("place").cast("int").alias("place")


def r6z(column, name: str):
    return F.when(F.abs(column) < 0.0000005, F.lit(0.0)).otherwise(F.round(column, 6)).alias(name)


@register(
    c.with_ctes(
        f"""cells AS (SELECT label, CAST(i - 1 AS INTEGER) AS place,
  sum(CAST(embedding[i] AS DOUBLE) * (vec_id % 5 <> 0)::INTEGER) / greatest(sum((vec_id % 5 <> 0)::INTEGER), 1e-9) AS v
  FROM embeddings, {CELLS_SQL} GROUP BY ALL)""",
        f"SELECT label, place, {c.sql_r6('v')} AS value FROM cells",
    )
)
def mean_pooling(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    pooled = pooling.mean_pool(vectors, "label", "embedding", F.col("vec_id") % 5 != 0)
    return pooled.select("label", _place(), r6z(F.col("value"), "value"))


@register(
    c.with_ctes(
        f"scored AS (SELECT *, list_dot_product(embedding::DOUBLE[], {WEIGHTS_SQL}) AS s FROM embeddings)",
        "weighted AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label)) AS w FROM scored)",
        f"""cells AS (SELECT label, CAST(i - 1 AS INTEGER) AS place, sum(CAST(embedding[i] AS DOUBLE) * w) / sum(w) AS v
  FROM weighted, {CELLS_SQL} GROUP BY ALL)""",
        f"SELECT label, place, {c.sql_r6('v')} AS value FROM cells",
    )
)
def attention_pooling(spark, sf_dir):
    vectors = views.table(spark, sf_dir, "embeddings")
    score = arrays.dot(F.col("embedding"), F.array(*[F.lit(w) for w in WEIGHTS]))
    pooled = pooling.attention_pool(vectors, "label", "embedding", score)
    return pooled.select("label", _place(), r6z(F.col("value"), "value"))


@register(
    c.with_ctes(
        "doubles AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)",
        "stats AS (SELECT vec_id, e, list_avg(e) AS m, sqrt(list_var_pop(e) + 1e-5) AS sd FROM doubles)",
        f"cells AS (SELECT vec_id, CAST(i - 1 AS INTEGER) AS place, (e[i] - m) / sd AS v FROM stats, {CELLS_SQL})",
        f"SELECT vec_id, place, {c.sql_r6('v')} AS value FROM cells",
    )
)
def layer_norm(spark, sf_dir):
    normed = views.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(arrays.layer_norm(F.col("embedding"))).alias("place", "v")
    )
    return normed.select("vec_id", _place(), r6z(F.col("v"), "value"))


def _linear_model():
    weights = np.array(WEIGHTS)

    def predict(inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(inputs.astype(np.float64) @ weights)))

    return predict


@register(
    f"""SELECT vec_id, round(1 / (1 + exp(-list_dot_product(embedding::DOUBLE[], {WEIGHTS_SQL}))), 6) AS pred
  FROM embeddings"""
)
def batch_scorer(spark, sf_dir):
    """A NumPy model called on Arrow batches."""
    score = base_models.vector_scorer(_linear_model, WIDTH)
    return views.table(spark, sf_dir, "embeddings").select("vec_id", c.r6(score("embedding"), "pred"))


@register(c.with_ctes(*c.OOF_CTES, "SELECT id, alpha AS pred FROM oof"))
def flatten_batches(spark, sf_dir):
    """Outputs that come as one-element vectors in batches, back to one number a row.

    The id travels beside its value; the batch is a slice of the id order, so it stays short.
    """
    from pairloom.operators.positions import with_batch

    batches = (
        with_batch(c.oof_wide(spark, sf_dir).select("id", "alpha"), 32)
        .groupBy("batch")
        .agg(F.collect_list(F.struct("id", F.array("alpha").alias("output"))).alias("rows"))
    )
    return batches.select(F.inline("rows")).select("id", F.element_at("output", 1).alias("pred"))
