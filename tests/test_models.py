import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from pairloom.config import ForestGrid, RunConfig, StackConfig
from pairloom.operators.rank_cuts import in_test, with_test_splits
from pairloom.plans import base_models, forest, stacking
from pairloom.queries import common as c
from pairloom.session import scratch_path
from pairloom.sources import views

QUERIES = spark_entry.queries()


def test_out_of_fold_predictions_cover_every_pair_once(spark, sf_dir):
    oof = QUERIES["oof_base_model"](spark, sf_dir)
    pairs = views.pairs(spark, sf_dir)
    assert oof.count() == pairs.count() == oof.select("id").distinct().count()
    folds = c.folded(spark, sf_dir).select("id", F.col("fold").alias("own"))
    assert oof.join(folds, "id").filter("fold <> own").count() == 0
    assert oof.agg(F.corr("score", "pred")).first()[0] > 0.9


def test_fold_ensemble_is_the_mean_of_its_models(spark, sf_dir):
    df = base_models.with_features(c.folded_texts(spark, sf_dir))
    _, models = base_models.cross_validate(df, base_models.estimator("linear"), (0, 1), "v")
    both = df.select("id", "features")
    for fold, model in models.items():
        both = model.setPredictionCol(f"p{fold}").transform(both)
    expected = both.select("id", ((F.col("p0") + F.col("p1")) / 2).alias("mean"))
    got = base_models.fold_ensemble(df, models).join(expected, "id")
    assert got.filter(F.abs(F.col("score") - F.col("mean")) > 1e-9).count() == 0
    linked = base_models.fold_ensemble(df, models, "sigmoid")
    assert linked.filter("score <= 0 OR score >= 1").count() == 0


def test_elastic_net_grid_is_complete(spark, sf_dir):
    rows = QUERIES["elastic_net_grid"](spark, sf_dir)
    assert rows.count() == 4 * 5 * 60 * 2
    assert rows.filter("neg_mean_absolute_error IS NULL OR neg_mean_absolute_error > 0").count() == 0
    assert rows.filter("isnan(corr_scorer)").count() == 0


def test_meta_refit_beats_the_best_single_set(spark, sf_dir):
    rows = QUERIES["meta_refit"](spark, sf_dir)
    single = c.oof_wide(spark, sf_dir).agg(F.corr("score", "alpha")).first()[0]
    assert rows.agg(F.corr("score", "en")).first()[0] > single


@pytest.fixture(scope="module")
def stack(spark, sf_dir):
    config = StackConfig(tuple(c.VERSIONS), n_splits=2, forest=ForestGrid.debug(), encode_fold=True)
    return stacking.train_stack(c.stored_oof(spark, sf_dir), config)


def test_stack(spark, sf_dir, stack):
    board = stack.leaderboard.collect()
    assert len(board) == 4 * 2 * 7 and all(row.score is not None for row in board)
    assert stack.best.first().model == "en"
    assert set(stack.forests) == {0, 1, 2, 3}
    assert stack.predictions.count() == 1500


@pytest.mark.parametrize("winner", ["en", "rf", "beta"])
def test_stacked_scores(spark, sf_dir, stack, winner):
    from dataclasses import replace

    chosen = replace(stack, best=spark.createDataFrame([(winner,)], "model string"))
    matrix = stacking.fold_matrix(c.test_long(spark, sf_dir), c.VERSIONS, c.FOLDS)
    rows = stacking.stacked_scores(matrix, chosen, c.VERSIONS, c.FOLDS)
    assert rows.count() == 150
    if winner == "beta":
        mean = matrix.selectExpr("id", "(beta_fold_0 + beta_fold_1 + beta_fold_2 + beta_fold_3) / 4 AS m")
        assert rows.join(mean, "id").filter("abs(score - m) > 1e-9").count() == 0
    else:
        assert rows.agg(F.stddev("score")).first()[0] > 0.01


def test_forest_scores(spark, sf_dir):
    """Depths cut from one fit score like fits of their own."""
    rows = forest.stored_rows(with_test_splits(c.stored_oof(spark, sf_dir), "score", 1, groups=("fold",)), c.VERSIONS)
    grid = ForestGrid(n_estimators=(10,), max_depth=(2, 4), min_samples_split=(2,))
    found = forest.forest_scores(rows, [0], 1, grid).toPandas().set_index(["max_depth", "sample"])
    assert len(found) == 4
    for depth in (2, 4):
        mine = rows.filter("fold = 0")
        model = forest.forest(10, depth).fit(mine.filter(~in_test(0)))
        exact = model.transform(mine.filter(in_test(0))).agg(F.corr("score", "rf")).first()[0]
        assert found.loc[(depth, "test"), "corr_scorer"] == pytest.approx(exact, abs=1e-9)


def grown(x, y, depth, least):
    """A regression tree by definition: the best split of every node with enough rows, at midpoints between neighbouring values."""
    if depth == 0 or len(y) < least or np.ptp(y) == 0:
        return float(y.mean())
    best = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, feature] <= cut
            loss = y[left].var() * left.sum() + y[~left].var() * (~left).sum()
            if best is None or loss < best[0] - 1e-12:
                best = (loss, feature, cut, left)
    if best is None:
        return float(y.mean())
    _, feature, cut, left = best
    return feature, cut, grown(x[left], y[left], depth - 1, least), grown(x[~left], y[~left], depth - 1, least)


def walked(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_least_rows_of_a_split(spark):
    """Cutting the whole tree at small nodes is growing it with that bound, which no bound on children gives."""
    chance = np.random.default_rng(4)
    x = chance.integers(0, 6, (60, 2)).astype(float)
    y = chance.normal(size=60) + x[:, 0]
    data = spark.createDataFrame([(*map(float, row), float(v)) for row, v in zip(x, y)], "a double, b double, score double")
    model = forest.forest(1, 8).setBootstrap(False).fit(forest.assembled(data, ["a", "b"]))
    trees = forest.Trees(forest.node_table(model, spark))
    settings = [(depth, least) for depth in (2, 5, 8) for least in (2, 4, 6, 17)]
    found = trees.predictions(x, settings)
    for place, (depth, least) in enumerate(settings):
        exact = [walked(grown(x, y, depth, least), row) for row in x]
        assert found[:, place] == pytest.approx(exact, abs=1e-9), (depth, least)
        small = trees.cut_at(depth, least)
        assert len(small.nodes) <= len(trees.nodes)
        assert small.predictions(x, [(30, 0)])[:, 0] == pytest.approx(exact, abs=1e-9)
    assert np.abs(found[:, settings.index((8, 2))] - found[:, settings.index((8, 6))]).max() > 0.01


def test_another_layout_is_an_error(spark, monkeypatch):
    data = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0)], "a double, score double")
    model = forest.forest(2, 2).fit(forest.assembled(data, ["a"]))
    assert len(forest.node_table(model, spark)) >= 2

    class Renamed:
        getNumTrees = 2

        def write(self):
            return self

        def save(self, path):
            spark.createDataFrame([(0, 1)], "tree int, node int").write.parquet(f"{path}/data")

    with pytest.raises(RuntimeError, match="layout"):
        forest.node_table(Renamed(), spark)


@pytest.mark.parametrize("choice", ["onehot", {0: [1.5], 1: [0.0], 2: [-1.0], 3: [9.0]}])
def test_stored_stack_scores_with_its_encoder(spark, sf_dir, choice):
    config = StackConfig(tuple(c.VERSIONS), learners=("en",), n_splits=2, encode_fold=choice)
    made = stacking.train_stack(c.stored_oof(spark, sf_dir), config)
    path = scratch_path(spark, "stack")
    stacking.save_stack(made, path)
    again = stacking.load_stack(spark, path)
    assert again.encoder == made.encoder and len(again.features) == len(c.VERSIONS) + len(made.encoder.names)
    matrix = stacking.fold_matrix(c.test_long(spark, sf_dir), c.VERSIONS, c.FOLDS)
    one, two = (
        sorted(stacking.stacked_scores(matrix, stack, c.VERSIONS, c.FOLDS).collect()) for stack in (made, again)
    )
    assert one == two and len(one) == 150
    with pytest.raises(ValueError, match="fold 9"):
        stacking.stacked_scores(matrix, again, c.VERSIONS, [9])


def test_wrong_models_have_no_certificate(spark, sf_dir):
    df = base_models.with_features(c.folded_texts(spark, sf_dir))
    oof, models = base_models.cross_validate(df, base_models.estimator("linear"), (0, 1), "v")
    part = df.filter("fold < 2")
    good = {r.fold: r for r in base_models.certificate(df, oof, models, 0.001).collect()}
    assert all(r.unbiased and r.stationary and r.once and r.own_model for r in good.values()) and len(good) == 2
    swapped = {0: models[1], 1: models[0]}
    bad = base_models.certificate(df, oof, swapped, 0.001).collect()
    assert not any(r.unbiased or r.stationary or r.own_model for r in bad)
    twice = base_models.certificate(part, oof.unionByName(oof.filter("fold = 1")), models, 0.001).collect()
    assert {r.fold: r.once for r in twice} == {0: True, 1: False}
    weaker = base_models.certificate(df, oof, models, 0.01).collect()
    assert all(r.unbiased and not r.stationary for r in weaker)


def test_forests_are_stored(spark, tmp_path, stack):
    forest.save_forests(spark, stack.forests, f"{tmp_path}/forest")
    again = forest.load_forests(spark, f"{tmp_path}/forest", list(stack.forests))
    width = len(stack.features)
    rows = np.random.default_rng(0).random((50, width))
    for fold, trees in stack.forests.items():
        assert again[fold].predictions(rows, [(9, 0)]) == pytest.approx(trees.predictions(rows, [(9, 0)]))


def test_unknown_names_are_errors(spark, sf_dir):
    with pytest.raises(ValueError):
        base_models.estimator("svm")
    with pytest.raises(ValueError):
        stacking.train_stack(None, StackConfig(("a",), learners=("svm",)))


def test_settings_are_checked():
    for wrong in (
        {"target_size": 3},
        {"target_size": 5, "loss": "MSE"},
        {"target_size": 1, "loss": "CE"},
        {"balance_by": "anchor"},
        {"folds": (4,)},
    ):
        with pytest.raises(ValueError):
            RunConfig(**wrong)
    assert RunConfig.debug().run_folds == (0, 1)
    assert RunConfig(target_size=5, loss="CE").run_folds == (0, 1, 2, 3)


NODE_COLUMNS = ["tree", "node", "value", "rows", "left", "right", "feature", "cut"]


def test_forest_predicts_rows_of_its_fold_only(spark):
    """Each row is sent down the forest of its own fold, not down all of them."""

    class Own(forest.Trees):
        def __init__(self, fold):
            super().__init__(pd.DataFrame([(0, 0, fold + 0.5, 4, -1, -1, 0, 0.0)], columns=NODE_COLUMNS))
            self.fold = fold

        def predictions(self, rows, settings):
            if (rows[:, 0] != self.fold).any():
                raise ValueError("a row of another fold")
            return super().predictions(rows, settings)

    df = spark.range(30).select((F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 3).cast("double").alias("x"))
    got = forest.with_forest_prediction(df, {0: Own(0), 1: Own(1)}, ["x"]).collect()
    assert {(row.fold, row.rf) for row in got} == {(0, 0.5), (1, 1.5), (2, None)} and len(got) == 30


def test_rows_go_down_once_for_all_settings():
    """One path of a row gives what the definition gives for every depth and least number of rows."""
    nodes = [
        (0, 0, 0.5, 9, 1, 4, 0, 0.5), (0, 1, 0.2, 5, 2, 3, 1, 0.5), (0, 2, 0.1, 2, -1, -1, 0, 0.0), (0, 3, 0.3, 3, -1, -1, 0, 0.0),
        (0, 4, 0.9, 4, 5, 6, 1, 0.2), (0, 5, 0.8, 1, -1, -1, 0, 0.0), (0, 6, 1.0, 3, -1, -1, 0, 0.0), (1, 0, 0.4, 9, -1, -1, 0, 0.0),
    ]
    trees = forest.Trees(pd.DataFrame(nodes, columns=NODE_COLUMNS))
    by_node = {node[:2]: node for node in nodes}

    def walk(row, tree, depth, least):
        at, level = by_node[tree, 0], 0
        while at[4] >= 0 and at[3] >= least and level < depth:
            at, level = by_node[tree, at[4] if row[at[6]] <= at[7] else at[5]], level + 1
        return at[2]

    rows = np.array([[x, y] for x in (0.0, 0.5, 0.6) for y in (0.1, 0.2, 0.4, 0.9)])
    settings = [(depth, least) for depth in range(4) for least in (0, 2, 5, 6, 10)]
    want = [[(walk(row, 0, *s) + walk(row, 1, *s)) / 2 for s in settings] for row in rows]
    assert trees.predictions(rows, settings) == pytest.approx(np.array(want), abs=1e-15)
    assert len(trees.levels) == 2  # steps of a path, whatever the depths asked for
    assert forest.forest(5, 3).getCacheNodeIds()


def test_refits_run_at_the_same_time(spark, monkeypatch):
    """The fits of all folds are under way before the first one ends; each fold gets its own forest."""
    from threading import Barrier

    together, fitted = Barrier(2, timeout=60), forest.node_table

    def node_table(model, session):
        together.wait()
        return fitted(model, session)

    monkeypatch.setattr(forest, "node_table", node_table)
    rows = spark.range(40).select((F.col("id") % 2).cast("int").alias("fold"), F.lit(0).alias("test_splits"),
        (F.col("id") % 2 * 10 + F.col("id") % 5).cast("double").alias("score"), (F.col("id") % 5).cast("double").alias("x"))
    found = forest.refitted(forest.stored_rows(rows, ["x"]), {0: (5, 2, 2), 1: (5, 3, 4)})
    assert list(found) == [0, 1]
    assert found[0].value[0, 0] < 5 < 10 <= found[1].value[0, 0] and len(found[0].levels) <= 2
