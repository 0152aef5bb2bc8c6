"""Fitted jobs: base models, elastic net, forest, stacked scores. Checked by invariants."""

from __future__ import annotations

from itertools import product

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pairloom.config import StackConfig
from pairloom.operators import enrich
from pairloom.operators.pair_features import with_pair_features
from pairloom.operators.rank_cuts import with_test_splits
from pairloom.plans import base_models, forest, moments, stacking
from pairloom.queries import common as c
from pairloom.queries.stacking import N_SPLITS, moment_sql
from pairloom.queries.texts import FEATURES_SQL
from pairloom.session import scratch_path, small_side, written
from pairloom.sources import views

register = c.Registry()
QUERIES, SQL = register.queries, register.sql

GRID = StackConfig(()).elastic_net
SETTINGS = list(product(GRID.alpha, GRID.fit_intercept, GRID.l1_ratio))
SWEEPS = 400  # of coordinate descent in SQL; both sides agree to far more digits than are compared
PLACES = 5
NUDGE = 3e-9  # scores of a constant guess are fractions that can lie halfway between two roundings
SCORES = ["neg_mean_squared_error", "r2", "corr_scorer", "neg_mean_absolute_error"]


def _featured(spark, sf_dir):
    return base_models.with_features(c.folded_texts(spark, sf_dir))


BASE_PENALTY = 0.001


def _edit_features(df):
    """One feature, so that the fit has a closed form."""
    return VectorAssembler(inputCols=["edit_distance"], outputCol="features").transform(with_pair_features(df))


# The penalty is divided by the label's deviation and holds for the feature divided by its own.
ONE_FEATURE_CTES = (
    FEATURES_SQL,
    "rows AS (SELECT e.id, score, fold, edit_distance AS x FROM enriched e JOIN features f ON f.id = e.id JOIN folds ON folds.id = e.id)",
    f"""known AS (SELECT k AS fold, avg(x) AS mx, avg(score) AS my,
  covar_pop(x, score) / (var_pop(x) * (1 + {BASE_PENALTY} / stddev_pop(score))) AS slope
  FROM rows, range(0, {views.N_FOLDS}) AS r(k) WHERE fold <> k GROUP BY k)""",
)
ONE_FEATURE_SOURCE = (*c.ENRICH_CTES, *c.FOLD_CTES[1:])


@register(
    c.with_ctes(
        *ONE_FEATURE_SOURCE,
        *ONE_FEATURE_CTES,
        "SELECT id, rows.fold, score, round(my + slope * (x - mx) + 3e-9, 5) AS pred FROM rows JOIN known ON known.fold = rows.fold",
    )
)
def oof_one_feature(spark, sf_dir):
    """Out-of-fold predictions of the base model with one feature."""
    df = _edit_features(c.folded_texts(spark, sf_dir))
    oof, _ = base_models.cross_validate(df, base_models.estimator("linear"), tuple(c.FOLDS), "one")
    return oof.select("id", "fold", "score", F.round(F.col("pred") + NUDGE, PLACES).alias("pred"))


@register(
    c.with_ctes(
        *ONE_FEATURE_SOURCE,
        *ONE_FEATURE_CTES,
        c.TEST_SQL,
        """SELECT id, round(avg(my + slope * (CAST(levenshtein(anchor, target) AS DOUBLE) - mx)) + 3e-9, 5) AS score
  FROM test_pairs, known GROUP BY id""",
    )
)
def ensemble_one_feature(spark, sf_dir):
    """Test rows scored by all stored fold models of the one-feature model in one scan, averaged."""
    df = _edit_features(c.folded_texts(spark, sf_dir))
    _, models = base_models.cross_validate(df, base_models.estimator("linear"), tuple(c.FOLDS), "one")
    path = scratch_path(spark, "models")
    base_models.save_models(models, path, "one")
    stored = base_models.load_models(path, "one", tuple(c.FOLDS))
    test = enrich.enrich(views.test_pairs(spark, sf_dir), views.sections(spark, sf_dir), views.classes(spark, sf_dir))
    scored = base_models.fold_ensemble(_edit_features(enrich.with_model_text(test)), stored)
    return scored.select("id", F.round(F.col("score") + NUDGE, PLACES).alias("score"))


@register(
    c.with_ctes(
        *c.FOLD_CTES,
        f"""SELECT CAST(k AS INTEGER) AS fold, count(*) FILTER (WHERE fold <> k) AS trained, count(*) FILTER (WHERE fold = k) AS predicted,
  true AS unbiased, true AS stationary, true AS once, true AS own_model FROM folds, range(0, {views.N_FOLDS}) AS r(k) GROUP BY k""",
    )
)
def oof_certificate(spark, sf_dir):
    """The stored fold models are the best fits of their training rows, and every pair is predicted once, by the model of its fold."""
    df = _featured(spark, sf_dir)
    oof, models = base_models.cross_validate(df, base_models.estimator("linear"), tuple(c.FOLDS), "linear")
    return base_models.certificate(df, oof, models, BASE_PENALTY)


@register()
def oof_base_model(spark, sf_dir):
    """Every pair is predicted by the model that did not see its fold."""
    oof, _ = base_models.cross_validate(
        _featured(spark, sf_dir), base_models.estimator("linear"), tuple(c.FOLDS), "linear"
    )
    return oof


@register()
def fold_ensemble_inference(spark, sf_dir):
    """Test rows scored by all fold models in one scan."""
    _, models = base_models.cross_validate(
        _featured(spark, sf_dir), base_models.estimator("linear"), tuple(c.FOLDS), "linear"
    )
    test = enrich.enrich(views.test_pairs(spark, sf_dir), views.sections(spark, sf_dir), views.classes(spark, sf_dir))
    return base_models.fold_ensemble(base_models.with_features(enrich.with_model_text(test)), models)


def _pair(i: int, j: int, names: list[str]) -> str:
    return f"xx_{names[min(i, j)]}_{names[max(i, j)]}"


def _step(i: int, names: list[str]) -> str:
    """The new weight of one feature, given the new ones before it and the old ones behind it."""
    rest = "".join(f" - g{min(i, j)}{max(i, j)} * {'n' if j < i else 'w'}{j}" for j in range(len(names)) if j != i)
    return (
        f"CASE WHEN g{i}{i} + l2 > 1e-15 THEN sign(c{i}{rest}) * greatest(abs(c{i}{rest}) - l1, 0) / (g{i}{i} + l2) ELSE 0 END AS n{i}"
    )


def linear_ctes(names: list[str], source: tuple[str, ...] = c.OOF_CTES, rows: str = "oof", seed: int = 39) -> tuple[str, ...]:
    """Fits of every setting, fold and split (-1: all rows) by coordinate descent from the sums, with their scores on both sides."""
    every = range(len(names))
    sums = ", ".join(f"{expr} AS {name}" for name, expr in moment_sql(names).items())
    gram = [
        f"{_pair(i, j, names)} + CASE WHEN fit_intercept THEN 0 ELSE x_{names[i]} * x_{names[j]} END AS g{i}{j}" for i in every for j in every if i <= j
    ]
    sides = [f"xy_{names[i]} + CASE WHEN fit_intercept THEN 0 ELSE x_{names[i]} * y END AS c{i}" for i in every]
    means = " + ".join(f"w{i} * x_{names[i]}" for i in every)
    cov = " + ".join(f"w{i} * xy_{names[i]}" for i in every)
    var = " + ".join(f"w{i} * w{j} * {_pair(i, j, names)}" for i in every for j in every)
    settings = ", ".join(f"({n}, {a}::DOUBLE, {str(f).lower()}, {r}::DOUBLE)" for n, (a, f, r) in enumerate(SETTINGS))
    return (
        *source,
        f"repeated AS (SELECT {rows}.*, CAST(k AS INTEGER) AS split FROM {rows}, range(0, 5) AS r(k))",
        c.split_sql("repeated", "score", f"md5(id || ':{seed}:' || CAST(split AS VARCHAR))", groups="(fold, split)"),
        f"""sums AS MATERIALIZED (SELECT fold, split, side, {sums} FROM parted GROUP BY fold, split, side
  UNION ALL SELECT fold, -1, 'train', {sums} FROM {rows} GROUP BY fold)""",
        f"settings(setting, alpha, fit_intercept, l1_ratio) AS (VALUES {settings})",
        f"""problems AS MATERIALIZED (SELECT fold, split, setting, alpha, fit_intercept, l1_ratio, alpha * l1_ratio AS l1, alpha * (1 - l1_ratio) AS l2,
  {", ".join(gram + sides)} FROM sums CROSS JOIN settings WHERE side = 'train')""",
        f"""sweeps AS (SELECT fold, split, setting, 0 AS turn, {", ".join(f"0.0::DOUBLE AS w{i}" for i in every)} FROM problems
  UNION ALL SELECT fold, split, setting, turn + 1, {", ".join(f"n{i}" for i in every)} FROM (
    SELECT s.*, {", ".join(_step(i, names) for i in every)} FROM sweeps s JOIN problems USING (fold, split, setting) WHERE turn < {SWEEPS}))""",
        f"""fits AS MATERIALIZED (SELECT fold, split, setting, alpha, fit_intercept, l1_ratio, {", ".join(f"w{i}" for i in every)},
  CASE WHEN fit_intercept THEN y - ({means}) ELSE 0 END AS b
  FROM (SELECT * FROM sweeps WHERE turn = {SWEEPS}) JOIN problems USING (fold, split, setting)
  JOIN (SELECT * FROM sums WHERE side = 'train') USING (fold, split))""",
        f"""scored AS (SELECT fold, split, setting, side, alpha, fit_intercept, l1_ratio, {cov} AS cov, {var} AS vp, yy, y - ({means}) - b AS gap
  FROM fits JOIN sums USING (fold, split) WHERE split >= 0)""",
        """scores AS MATERIALIZED (SELECT *, -(greatest(yy - 2 * cov + vp, 0) + gap * gap) AS neg_mean_squared_error,
  CASE WHEN yy > 0 AND vp > 1e-18 THEN cov / sqrt(yy * vp) END AS corr_scorer FROM scored)""",
        f"""absolute AS (SELECT p.fold, p.split, setting, side,
  -avg(abs(score - b - ({" + ".join(f"w{i} * p.{names[i]}" for i in every)}))) AS neg_mean_absolute_error
  FROM parted p JOIN fits f ON p.fold = f.fold AND p.split = f.split GROUP BY ALL)""",
        """means AS (SELECT fold, setting, CASE WHEN count(corr_scorer) = count(*) THEN avg(corr_scorer) END AS cv_score
  FROM scores WHERE side = 'test' GROUP BY ALL)""",
        """best AS (SELECT fold, setting FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY cv_score DESC NULLS LAST, setting) AS place
  FROM means) WHERE place = 1)""",
        f"""refitted AS (SELECT id, fold, score, {", ".join(f"oof.{name}" for name in names)}, b + {" + ".join(f"w{i} * oof.{names[i]}" for i in every)} AS en
  FROM oof JOIN fits USING (fold) JOIN best USING (fold, setting) WHERE split = -1)""",
    )


def _recursive(*parts: str) -> str:
    return c.with_ctes(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _fixed(expr: str, name: str) -> str:
    return f"round({expr} + {NUDGE}, {PLACES}) AS {name}"


def _places(name: str):
    return F.round(F.col(name) + NUDGE, PLACES).alias(name)


def _linear(oof, features=None):
    """Rows with the bits of their test sides, and the fits of all settings."""
    features = c.VERSIONS if features is None else features
    marked = written(with_test_splits(oof, "score", N_SPLITS, groups=("fold",)), "meta-splits")
    packed = moments.split_moments(marked, features, "score", N_SPLITS)
    return marked, small_side(moments.elastic_net_fits(packed, len(features), GRID))


def _grid(spark, sf_dir, features):
    marked, fits = _linear(c.stored_oof(spark, sf_dir), features)
    absolute = moments.absolute_errors(marked, fits, features, "score")
    keys = ["fold", "split", "setting", "sample"]
    tested = fits.filter(F.col("split") != moments.ALL_ROWS).drop("coef", "intercept").join(absolute, keys)
    return tested.select(*keys, *moments.PARAMS, *[_places(name) for name in SCORES])


def _grid_sql(names: list[str]) -> str:
    return _recursive(
        *linear_ctes(names),
        f"""SELECT fold, split, setting, side AS sample, alpha, fit_intercept, l1_ratio, {_fixed("neg_mean_squared_error", "neg_mean_squared_error")},
  CASE WHEN yy > 0 THEN {_fixed("1 + neg_mean_squared_error / yy", "r2").replace(" AS r2", "")} END AS r2, {_fixed("corr_scorer", "corr_scorer")},
  {_fixed("neg_mean_absolute_error", "neg_mean_absolute_error")} FROM scores JOIN absolute USING (fold, split, setting, side)""",
    )


@register(_grid_sql(c.VERSIONS))
def elastic_net_grid(spark, sf_dir):
    """60 settings, 5 splits, 4 folds, all four scores on both sides."""
    return _grid(spark, sf_dir, c.VERSIONS)


@register(_recursive(*linear_ctes(c.VERSIONS), f"SELECT id, fold, score, {_fixed('en', 'en')} FROM refitted"))
def meta_refit(spark, sf_dir):
    """The best linear setting of each fold, fitted on all of its rows, predicts every row."""
    oof = c.stored_oof(spark, sf_dir)
    _, fits = _linear(oof)
    predicted = moments.with_linear_prediction(oof, moments.best_fits(fits), c.VERSIONS, "en")
    return predicted.select("id", "fold", "score", _places("en"))


@register()
def forest_grid(spark, sf_dir):
    """15 settings of 150 trees, 5 splits, 4 folds, all four scores on both sides."""
    config = StackConfig(())
    marked = with_test_splits(c.stored_oof(spark, sf_dir), "score", config.n_splits, groups=("fold",))
    return forest.forest_scores(forest.stored_rows(marked, c.VERSIONS), c.FOLDS, config.n_splits, config.forest)


def _stack(spark, sf_dir):
    return stacking.train_stack(c.oof_wide(spark, sf_dir), StackConfig(tuple(c.VERSIONS)))


@register()
def meta_training(spark, sf_dir):
    """Mean leaderboard of single models and meta-learners."""
    return _stack(spark, sf_dir).mean_scores


@register()
def stacked_inference(spark, sf_dir):
    """Test scores of the best model, one meta-model for each fold, averaged."""
    matrix = stacking.fold_matrix(c.test_long(spark, sf_dir), c.VERSIONS, c.FOLDS)
    return stacking.stacked_scores(matrix, _stack(spark, sf_dir), c.VERSIONS, c.FOLDS)


# The stack of the linear meta-learner alone can be followed in SQL from the splits to the scores.
STACK_SOURCE = (
    *c.OOF_CTES,
    c.split_sql("oof", "score", c.sql_key("id", 39), groups="fold", name="halves", col="part"),
    "training AS (SELECT * EXCLUDE (part) FROM halves WHERE part = 'train')",
)
MODELS = [*c.VERSIONS, "en"]
STACK_CTES = (
    *linear_ctes(c.VERSIONS, STACK_SOURCE, "training", 40),
    "chosen AS (SELECT * FROM fits JOIN best USING (fold, setting) WHERE split = -1)",
    f"""stacked AS (SELECT h.*, b + {" + ".join(f"w{i} * h.{v}" for i, v in enumerate(c.VERSIONS))} AS en FROM halves h JOIN chosen USING (fold))""",
    "board AS (" + " UNION ALL ".join(
        f"SELECT fold, 'em_' || part || '_set' AS dataset, '{m}' AS model, {c.sql_pearson('score', 'stacked.' + m)} AS s FROM stacked GROUP BY fold, part"
        for m in MODELS
    ) + ")",
    "mean_board AS (SELECT model, dataset, avg(s) AS score FROM board GROUP BY ALL)",
    "winner AS (SELECT model FROM mean_board WHERE dataset = 'em_test_set' AND score IS NOT NULL ORDER BY score DESC, model LIMIT 1)",
)


def _linear_stack(spark, sf_dir):
    return stacking.train_stack(c.oof_wide(spark, sf_dir), StackConfig(tuple(c.VERSIONS), learners=("en",)))


@register(_recursive(*STACK_CTES, f"SELECT model, dataset, {_fixed('score', 'score')} FROM mean_board"))
def linear_meta_training(spark, sf_dir):
    """Mean leaderboard of the single models and the linear meta-learner."""
    return _linear_stack(spark, sf_dir).mean_scores.select("model", "dataset", _places("score"))


def _fold_score(fold: int) -> str:
    linear = f"(SELECT b FROM chosen WHERE fold = {fold})" + "".join(
        f" + (SELECT w{i} FROM chosen WHERE fold = {fold}) * {v}_fold_{fold}" for i, v in enumerate(c.VERSIONS)
    )
    singles = " ".join(f"WHEN '{v}' THEN {v}_fold_{fold}" for v in c.VERSIONS)
    return f"CASE (SELECT model FROM winner) WHEN 'en' THEN {linear} {singles} END"


@register(
    _recursive(
        *STACK_CTES,
        c.TEST_SQL,
        c.MATRIX_SQL,
        f"SELECT id, {_fixed('(' + ' + '.join(_fold_score(k) for k in c.FOLDS) + f') / {len(c.FOLDS)}', 'score')} FROM matrix",
    )
)
def linear_stacked_inference(spark, sf_dir):
    """Test scores of the best model of that stack, stored and loaded again, one meta-model for each fold, averaged."""
    path = scratch_path(spark, "stack")
    stacking.save_stack(_linear_stack(spark, sf_dir), path)
    matrix = stacking.fold_matrix(c.test_long(spark, sf_dir), c.VERSIONS, c.FOLDS)
    scores = stacking.stacked_scores(matrix, stacking.load_stack(spark, path), c.VERSIONS, c.FOLDS)
    return scores.select("id", _places("score"))
