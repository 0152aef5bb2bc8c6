"""Prediction matrix, grid summaries, curves and the gate."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from pairloom.operators import evaluation, fold_encoder
from pairloom.operators.rank_cuts import with_test_splits
from pairloom.plans import moments, stacking
from pairloom.queries import common as c
from pairloom.queries.aggregates import BEST_SQL, BOARD_CTES, MEAN_SQL, board
from pairloom.session import scratch_path, small_side

register = c.Registry()
QUERIES, SQL = register.queries, register.sql

BLENDED = ["alpha", "beta"]
WEIGHTS, SHRINKS, INTERCEPTS = (0.0, 0.25, 0.5, 0.75, 1.0), (0.8, 1.0), (True, False)
PARAMS = ["weight", "shrink", "fit_intercept"]
VALUES = ["neg_mean_squared_error", "r2", "corr_scorer"]


@register(c.with_ctes(c.TEST_SQL, c.MATRIX_SQL, "SELECT * FROM matrix"))
def version_fold_matrix(spark, sf_dir):
    return stacking.fold_matrix(c.test_long(spark, sf_dir), c.VERSIONS, c.FOLDS)


@register(
    c.with_ctes(
        c.TEST_SQL,
        c.MATRIX_SQL,
        " UNION ALL ".join(
            f"SELECT '{v}_fold_{k}' AS name, round(avg({v}_fold_{k}), 6) AS mean_pred FROM matrix"
            for v in c.VERSIONS
            for k in c.FOLDS
        ),
    )
)
def fold_column_names(spark, sf_dir):
    named = c.test_long(spark, sf_dir).withColumn("name", stacking.fold_column("version", "fold"))
    return named.groupBy("name").agg(c.r6(F.avg("pred"), "mean_pred"))


@register(
    c.with_ctes(
        *c.FOLD_CTES,
        """SELECT id, fold, CAST((fold + 1) // 4 % 2 AS INTEGER) AS fold_digit_0,
  CAST((fold + 1) // 2 % 2 AS INTEGER) AS fold_digit_1, CAST((fold + 1) % 2 AS INTEGER) AS fold_digit_2 FROM folds""",
    )
)
def fold_digits(spark, sf_dir):
    digits, names = stacking.with_fold_digits(c.folded(spark, sf_dir), c.FOLDS)
    return digits.select("id", "fold", *[F.col(name).cast("int").alias(name) for name in names])


@register(
    c.with_ctes(
        *c.FOLD_CTES,
        f"SELECT id, fold, {', '.join(f'CAST(fold = {k} AS DOUBLE) AS fold_is_{k}' for k in c.FOLDS)} FROM folds",
    )
)
def fold_one_hot(spark, sf_dir):
    """A stored encoder, loaded again, gives every row the columns of its fold."""
    path = scratch_path(spark, "encoder")
    fold_encoder.fit_encoder("onehot", c.FOLDS).save(spark, path)
    encoder = fold_encoder.FoldEncoder.load(spark, path)
    return encoder.encoded(c.folded(spark, sf_dir)).select("id", "fold", *encoder.names)


SPLIT_CTES = (
    *c.OOF_CTES,
    "repeated AS (SELECT oof.*, CAST(k AS INTEGER) AS split FROM oof, range(0, 5) AS r(k))",
    c.split_sql("repeated", "score", "md5(id || ':39:' || CAST(split AS VARCHAR))", groups="(fold, split)"),
)


def moment_sql(features: list[str]) -> dict[str, str]:
    names = {"n": "CAST(count(*) AS DOUBLE)", "y": "avg(score)", "yy": "var_pop(score)"}
    names |= {f"x_{f}": f"avg({f})" for f in features}
    names |= {f"xy_{f}": f"covar_pop({f}, score)" for f in features}
    names |= {f"xx_{f}_{g}": f"covar_pop({f}, {g})" for f, g in combinations_with_replacement(features, 2)}
    return names


DIGITS = 8
N_SPLITS = 5
NUDGE = 1e-12  # means of few decimals can lie halfway between two roundings


def sides(spark, sf_dir, features):
    marked = with_test_splits(c.stored_oof(spark, sf_dir), "score", N_SPLITS, groups=("fold",))
    return moments.by_side(moments.split_moments(marked, features, "score", N_SPLITS), features, "score")


@register(
    c.with_ctes(
        *SPLIT_CTES,
        "SELECT fold, split, side, "
        + ", ".join(f"round({expr} + {NUDGE}, {DIGITS}) AS {name}" for name, expr in moment_sql(c.VERSIONS).items())
        + " FROM parted GROUP BY fold, split, side",
    )
)
def grid_moments(spark, sf_dir):
    """The moments that all linear fits of the grid are made from."""
    sums = sides(spark, sf_dir, c.VERSIONS)
    names = moment_sql(c.VERSIONS)
    return sums.select("fold", "split", "side", *[F.round(F.col(n) + NUDGE, DIGITS).alias(n) for n in names])


# The grid below blends two prediction sets with fixed weights. Its scores follow from the sums
# alone, so every step from scores to curves can be checked in SQL.

BLEND_CTES = (
    *SPLIT_CTES,
    f"""sums AS (SELECT fold, split, side, {", ".join(f"{e} AS {n}" for n, e in moment_sql(BLENDED).items())}
  FROM parted GROUP BY fold, split, side)""",
    """stats AS (SELECT fold, split, side, y AS my, x_alpha AS m1, x_beta AS m2, yy AS vy, xy_alpha AS c1, xy_beta AS c2,
  xx_alpha_alpha AS v11, xx_alpha_beta AS v12, xx_beta_beta AS v22 FROM sums)""",
    f"""settings AS (SELECT weight, shrink, fit_intercept, shrink * weight AS a1, shrink * (1 - weight) AS a2
  FROM (SELECT unnest({list(WEIGHTS)}::DOUBLE[]) AS weight), (SELECT unnest({list(SHRINKS)}::DOUBLE[]) AS shrink),
  (SELECT unnest([true, false]) AS fit_intercept))""",
    """blends AS (SELECT s.fold, s.split, s.side AS sample, weight, shrink, fit_intercept,
  CASE WHEN fit_intercept THEN t.my - a1 * t.m1 - a2 * t.m2 ELSE 0 END AS b,
  a1 * s.c1 + a2 * s.c2 AS cov, a1 * a1 * s.v11 + 2 * a1 * a2 * s.v12 + a2 * a2 * s.v22 AS vp,
  s.vy, s.my - a1 * s.m1 - a2 * s.m2 AS gap
  FROM stats s JOIN stats t ON t.fold = s.fold AND t.split = s.split AND t.side = 'train' CROSS JOIN settings)""",
    """scores AS (SELECT fold, split, sample, weight, shrink, fit_intercept,
  -(vy - 2 * cov + vp + (gap - b) * (gap - b)) AS neg_mean_squared_error,
  1 - (vy - 2 * cov + vp + (gap - b) * (gap - b)) / vy AS r2, cov / sqrt(vy * vp) AS corr_scorer FROM blends)""",
    "summary AS (SELECT weight, shrink, fit_intercept, sample, "
    + ", ".join(f"avg({v}) AS mean_{v}, stddev_pop({v}) AS std_{v}" for v in VALUES)
    + " FROM scores GROUP BY ALL)",
    """best AS (SELECT weight, shrink, fit_intercept, mean_neg_mean_squared_error AS best_score FROM summary
  WHERE sample = 'test' ORDER BY mean_neg_mean_squared_error DESC, weight, shrink, fit_intercept LIMIT 1)""",
)


def blend_scores(spark, sf_dir):
    """Scores of all blend settings for each fold, split and side, from the sums."""
    names = {
        "my": "y", "m1": "x_alpha", "m2": "x_beta", "vy": "yy", "c1": "xy_alpha", "c2": "xy_beta",
        "v11": "xx_alpha_alpha", "v12": "xx_alpha_beta", "v22": "xx_beta_beta",
    }
    stats = small_side(sides(spark, sf_dir, BLENDED)).select(
        "fold", "split", "side", F.struct(*[F.col(old).alias(new) for new, old in names.items()]).alias("m")
    )
    both = stats.groupBy("fold", "split").agg(
        F.first(F.when(F.col("side") == "train", F.col("m")), ignorenulls=True).alias("t"),
        F.collect_list(F.struct(F.col("side").alias("sample"), "m")).alias("sides"),
    )
    grid = F.array(
        *[
            F.struct(F.lit(w).alias("weight"), F.lit(s).alias("shrink"), F.lit(i).alias("fit_intercept"))
            for w in WEIGHTS
            for s in SHRINKS
            for i in INTERCEPTS
        ]
    )
    rows = both.select("fold", "split", "t", F.explode("sides").alias("side")).select(
        "fold", "split", "t", "side.sample", "side.m", F.inline(grid)
    )
    a1, a2 = F.col("shrink") * F.col("weight"), F.col("shrink") * (1 - F.col("weight"))
    intercept = F.when(
        F.col("fit_intercept"), F.col("t.my") - a1 * F.col("t.m1") - a2 * F.col("t.m2")
    ).otherwise(F.lit(0.0))
    cov = a1 * F.col("m.c1") + a2 * F.col("m.c2")
    var = a1 * a1 * F.col("m.v11") + 2 * a1 * a2 * F.col("m.v12") + a2 * a2 * F.col("m.v22")
    gap = F.col("m.my") - a1 * F.col("m.m1") - a2 * F.col("m.m2") - intercept
    error = F.col("m.vy") - 2 * cov + var + gap * gap
    return rows.select(
        "fold",
        "split",
        "sample",
        *PARAMS,
        (-error).alias("neg_mean_squared_error"),
        (1 - error / F.col("m.vy")).alias("r2"),
        (cov / F.sqrt(F.col("m.vy") * var)).alias("corr_scorer"),
    )


def blend_summary(spark, sf_dir):
    return evaluation.split_summary(blend_scores(spark, sf_dir), PARAMS, VALUES)


def blend_best(summary):
    return evaluation.best_setting(summary, PARAMS, "mean_neg_mean_squared_error")


SUMMARY_COLUMNS = [f"{kind}_{value}" for value in VALUES for kind in ("mean", "std")]
ROUNDED_SQL = ", ".join(f"round({name}, 6) AS {name}" for name in SUMMARY_COLUMNS)


def _rounded(df):
    return df.select(*PARAMS, "sample", *[c.r6(F.col(name), name) for name in SUMMARY_COLUMNS])


@register(c.with_ctes(*BLEND_CTES, f"SELECT weight, shrink, fit_intercept, sample, {ROUNDED_SQL} FROM summary"))
def cv_score_summary(spark, sf_dir):
    return _rounded(blend_summary(spark, sf_dir))


@register(
    c.with_ctes(
        *BLEND_CTES,
        f"""SELECT s.weight, s.shrink, s.fit_intercept, s.sample, {", ".join(f"round(s.{n}, 6) AS {n}" for n in SUMMARY_COLUMNS)}
  FROM summary s JOIN best b ON s.shrink = b.shrink""",
    )
)
def best_setting_slice(spark, sf_dir):
    """All weights and both intercept choices at the best shrinkage."""
    summary = blend_summary(spark, sf_dir)
    return _rounded(evaluation.setting_slice(summary, blend_best(summary), ["shrink"]))


CURVE_CTES = (
    "sliced AS (SELECT s.* FROM summary s JOIN best b ON s.shrink = b.shrink)",
    """placed AS (SELECT fit_intercept, sample, weight AS x, mean_corr_scorer AS m, std_corr_scorer AS sd,
  row_number() OVER (PARTITION BY fit_intercept, sample ORDER BY weight) AS up,
  count(*) OVER (PARTITION BY fit_intercept, sample) AS k FROM sliced)""",
    """curve AS (SELECT fit_intercept, sample, 'line' AS part, up AS ord, x, m AS y FROM placed
  UNION ALL SELECT fit_intercept, sample, 'band', up, x, m + sd FROM placed WHERE sample = 'test'
  UNION ALL SELECT fit_intercept, sample, 'band', 2 * k + 1 - up, x, m - sd FROM placed WHERE sample = 'test')""",
)


def _curve(spark, sf_dir):
    summary = blend_summary(spark, sf_dir)
    best = blend_best(summary)
    sliced = evaluation.setting_slice(summary, best, ["shrink"])
    return evaluation.curve_rows(sliced, "weight", ["fit_intercept"], "corr_scorer"), best


@register(
    c.with_ctes(
        *BLEND_CTES,
        *CURVE_CTES,
        """SELECT fit_intercept, sample, part, ord, x, round(y, 6) AS y FROM curve
  UNION ALL SELECT fit_intercept, 'test', 'best', 1, weight, round(best_score, 6) FROM best""",
    )
)
def grid_curves(spark, sf_dir):
    """Line and band of one parameter, and the chosen setting as one more point."""
    curve, best = _curve(spark, sf_dir)
    point = best.select(
        "fit_intercept",
        F.lit("test").alias("sample"),
        F.lit("best").alias("part"),
        F.lit(1).alias("ord"),
        F.col("weight").alias("x"),
        F.col("best_score").alias("y"),
    )
    rows = curve.unionByName(point)
    return rows.select("fit_intercept", "sample", "part", F.col("ord").cast("bigint").alias("ord"), "x", c.r6(F.col("y"), "y"))


@register(
    c.with_ctes(
        *BLEND_CTES,
        *CURVE_CTES,
        "SELECT fit_intercept, ord, x, round(y, 6) AS y FROM curve WHERE part = 'band' ORDER BY fit_intercept, ord",
    )
)
def score_band(spark, sf_dir):
    """Upper edge forwards, lower edge backwards."""
    curve, _ = _curve(spark, sf_dir)
    band = curve.filter(F.col("part") == "band").orderBy("fit_intercept", "ord")
    return band.select("fit_intercept", F.col("ord").cast("bigint").alias("ord"), "x", c.r6(F.col("y"), "y"))


@register(
    c.with_ctes(
        *BOARD_CTES,
        MEAN_SQL,
        BEST_SQL,
        "SELECT model, CASE WHEN model = 'blend' THEN 'meta' ELSE 'single' END AS kind, round(score, 6) AS score FROM best",
    )
)
def best_model_gate(spark, sf_dir):
    best = evaluation.best_model(evaluation.mean_leaderboard(board(spark, sf_dir)))
    return stacking.gate(best, ("blend",)).select("model", "kind", c.r6(F.col("score"), "score"))
