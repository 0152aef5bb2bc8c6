import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.config import ForestGrid
from pairloom.operators.rank_cuts import in_test
from pairloom.plans import forest, forest_levels
from pairloom.queries import common as c
from pairloom.sources import views

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame():
    """Features of 30, 6 and 12 values, a label of many values."""
    chance = np.random.default_rng(7)
    n = 1600
    made = pd.DataFrame({"a": chance.integers(0, 30, n) / 7, "b": chance.integers(0, 6, n) * 1.0, "c": chance.integers(0, 12, n) - 5.0})
    made["score"] = 10 + np.sin(made["a"] * 2) + made["b"] * made["c"] / 9 + chance.normal(size=n) / 2
    made["test_splits"] = (chance.integers(0, 5, n) == 0) + 2 * (chance.integers(0, 5, n) == 0)
    return made.assign(fold=np.arange(n) % 2).astype({"fold": "int32", "test_splits": "int32"})


@pytest.fixture
def rows(spark, frame):
    return forest.stored_rows(spark.createDataFrame(frame), FEATURES)


@pytest.fixture
def all_once(monkeypatch):
    monkeypatch.setattr(forest_levels, "draws", lambda seed, block, tree, n: np.ones(n, np.uint8))


@pytest.fixture
def many(monkeypatch):
    """Few rows count as many, in small blocks and parts and groups of two trees; Spark ML fits nothing."""

    def no_fit(*args):
        raise AssertionError("a fit of its own")

    monkeypatch.setattr(forest, "FEW_ROWS", 100)
    monkeypatch.setattr(forest, "forest", no_fit)
    monkeypatch.setattr(forest_levels, "BLOCK_ROWS", 100)
    monkeypatch.setattr(forest_levels, "PART_ROWS", 300)
    monkeypatch.setattr(forest_levels, "TREES_TOGETHER", 2)


@pytest.mark.parametrize("block", [1 << 16, 90])
def test_trees_are_those_of_spark_ml(spark, frame, rows, all_once, monkeypatch, block):
    """Without chance a tree of each fold and split has the nodes that Spark ML finds, however the rows are dealt out."""
    monkeypatch.setattr(forest_levels, "BLOCK_ROWS", block)
    monkeypatch.setattr(forest_levels, "PART_ROWS", 4 * block)
    blocks = forest_levels.stored_blocks(rows, {0: 800, 1: 800}, [0, 1])
    heaps = forest_levels.grown(blocks, 3, 6, 39)
    assert set(heaps) == {(0, 0), (0, 1), (1, 0), (1, 1)}
    for fold, split in [(0, 1), (1, 0)]:
        model = forest.forest(1, 6).setBootstrap(False).fit(rows.filter((F.col("fold") == fold) & ~in_test(split)))
        exact = forest.Trees(forest.node_table(model, spark))
        nodes = heaps[fold, split].nodes(blocks.cuts[fold, split], blocks.means[fold], 3)
        x = frame[frame["fold"] == fold][FEATURES].to_numpy()
        settings = [(depth, least) for depth in (0, 1, 3, 6) for least in (2, 9, 40)]
        assert forest.Trees(nodes).predictions(x, settings) == pytest.approx(exact.predictions(x, settings), abs=1e-9)
        for tree in range(3):
            own = nodes[nodes["tree"] == tree]
            assert sorted(own["rows"]) == sorted(exact.nodes["rows"])


def test_draws_follow_the_law_and_repeat():
    found = np.concatenate([forest_levels.draws(39, block, tree, 65_537) for block in range(4) for tree in range(4)])
    n = len(found)
    for times in range(8):
        share = math.exp(-1) / math.factorial(times)
        assert abs((found == times).mean() - share) < 5 * math.sqrt(share / n)
    assert (forest_levels.draws(39, 2, 3, 500) == forest_levels.draws(39, 2, 3, 500)).all()
    others = [forest_levels.draws(*key, 5000).astype(float) for key in [(39, 2, 3), (39, 3, 3), (39, 2, 4), (40, 2, 3)]]
    assert np.abs(np.corrcoef(others) - np.eye(4)).max() < 0.08


def test_grid_of_many_rows(frame, rows, many):
    """Each setting scores as its forest does on the rows of each side, as numpy counts it; a smaller forest is the first trees."""
    grid = ForestGrid(n_estimators=(3, 5), max_depth=(2, 5), min_samples_split=(2, 30))
    found = forest.forest_scores(rows, [0, 1], 2, grid).toPandas()
    assert len(found) == 2 * 2 * 2 * 4 * 2 and not found.duplicated(["fold", "split", *forest.PARAMS, "sample"]).any()
    blocks = forest_levels.stored_blocks(rows, {0: 800, 1: 800}, [0, 1])
    heaps = forest_levels.grown(blocks, 5, 5, forest.SEED)
    for row in found.itertuples():
        key = (row.fold, row.split)
        trees = forest.Trees(heaps[key].nodes(blocks.cuts[key], blocks.means[row.fold], row.n_estimators))
        own = frame[(frame["fold"] == row.fold) & ((frame["test_splits"] & (1 << row.split) != 0) == (row.sample == "test"))]
        y, p = own["score"].to_numpy(), trees.predictions(own[FEATURES].to_numpy(), [(row.max_depth, row.min_samples_split)])[:, 0]
        assert row.neg_mean_absolute_error == pytest.approx(-np.abs(y - p).mean(), abs=1e-9)
        assert row.neg_mean_squared_error == pytest.approx(-((y - p) ** 2).mean(), abs=1e-9)
        assert row.r2 == pytest.approx(1 - ((y - p) ** 2).mean() / y.var(), abs=1e-9)
        assert row.corr_scorer == pytest.approx(np.corrcoef(y, p)[0, 1], abs=1e-9)
    tested = found[(found["sample"] == "test") & (found["max_depth"] == 5)]
    assert tested["corr_scorer"].min() > 0.75 and tested["corr_scorer"].nunique() > 4


def test_refit_of_many_rows(frame, rows, many):
    """Rows of a node are those drawn for its tree, and the forest is that of its fold, cut by its setting."""
    found = forest.refitted(rows, {0: (4, 3, 30), 1: (2, 5, 2)})
    assert [(len(trees.value), len(trees.levels)) for trees in found.values()] == [(4, 3), (2, 5)]
    for fold, trees in found.items():
        own = frame[frame["fold"] == fold]
        drawn = trees.rows[:, 0]
        assert len(set(drawn)) > 1 and np.abs(drawn - len(own)).max() < 5 * math.sqrt(len(own))
        p = trees.predictions(own[FEATURES].to_numpy(), [(9, 0)])[:, 0]
        assert np.corrcoef(p, own["score"])[0, 1] > 0.6
    assert (found[0].rows[~found[0].leaf] >= 30).all() and found[1].rows[~found[1].leaf].min() < 30


def test_quantiles_of_the_trained_rows(spark):
    """31 cuts that halve nothing: each bin has its share of the rows the split trains on, whatever the test rows hold."""
    x = np.concatenate([np.random.default_rng(1).permutation(3200) / 7.0, np.full(800, 9e9)])
    made = pd.DataFrame({"x": x, "score": x, "fold": np.int32(0), "test_splits": (np.arange(4000) >= 3200).astype("int32")})
    blocks = forest_levels.stored_blocks(forest.stored_rows(spark.createDataFrame(made), ["x"]), {0: 4000}, [0])
    cuts = blocks.cuts[0, 0][0]
    assert len(cuts) == 31
    assert np.diff(np.searchsorted(np.sort(x[:3200]), cuts, side="right"), prepend=0, append=3200).tolist() == [100] * 32


def test_a_missing_label_is_an_error(spark, frame):
    broken = frame.assign(score=frame["score"].where(frame.index != 5))
    rows = forest.stored_rows(spark.createDataFrame(broken).withColumn("score", F.nanvl("score", F.lit(None).cast("double"))), FEATURES)
    with pytest.raises(Exception, match="a label is missing"):
        forest_levels.stored_blocks(rows, {0: 800, 1: 800}, [0])


def test_constant_labels_have_no_cut(spark, frame, many):
    rows = forest.stored_rows(spark.createDataFrame(frame.assign(score=0.1)), FEATURES)
    found = forest.forest_scores(rows, [0, 1], 1, ForestGrid(n_estimators=(3,), max_depth=(3,), min_samples_split=(2,))).collect()
    assert len(found) == 4
    for row in found:
        assert row.corr_scorer is None and row.neg_mean_squared_error == pytest.approx(0, abs=1e-20)


def test_deep_trees_predict_as_their_nodes_say():
    """Trees with more levels or other cuts than words of bits are made for go down by their nodes."""
    chance = np.random.default_rng(3)
    nodes = []

    def grow(tree, depth, node):
        if depth == 13 or chance.random() < 0.1:
            nodes.append((tree, node, chance.random(), 1, -1, -1, 0, 0.0))
            return node + 1
        place = len(nodes)
        nodes.append(None)
        right = grow(tree, depth + 1, node + 1)
        after = grow(tree, depth + 1, right)
        nodes[place] = (tree, node, chance.random(), 2, node + 1, right, int(chance.integers(2)), cut())
        return after

    for cut in (lambda: chance.integers(9) / 10, chance.random):
        nodes.clear()
        for tree in range(3):
            grow(tree, 0, 0)
        trees = forest.Trees(pd.DataFrame(nodes, columns=["tree", "node", "value", "rows", "left", "right", "feature", "cut"]))
        by_node = {node[:2]: node for node in nodes}
        x = chance.random((70, 2))
        x[3, 0] = np.nan
        want = []
        for row in x:
            values = []
            for tree in range(3):
                at = by_node[tree, 0]
                while at[4] >= 0:
                    at = by_node[tree, at[4] if row[at[6]] <= at[7] else at[5]]
                values.append(at[2])
            want.append(np.mean(values))
        assert trees.predictions(x, [(99, 0)])[:, 0] == pytest.approx(np.array(want), abs=1e-12)


def test_unlabelled_pairs_are_spread_before_they_are_scored(spark, sf_dir):
    """The predictions of each pair, twenty hashes, are made by several tasks, though one task reads the file."""
    long = c.test_long(spark, sf_dir)
    tasks = long.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == 8 and max(row["count"] for row in tasks) < 2 * min(row["count"] for row in tasks)
    pairs = views.test_pairs(spark, sf_dir)
    assert long.count() == pairs.count() * len(c.VERSIONS) * len(c.FOLDS)
    assert long.select("id").distinct().count() == pairs.count()


def test_a_tree_without_rows_guesses_the_mean(spark, frame, many):
    """A fold of one row beside a large one: a tree that does not draw it has the mean label as its value."""
    both = pd.concat([frame[frame["fold"] == 0], frame[frame["fold"] == 1].head(1)])
    rows = forest.stored_rows(spark.createDataFrame(both), FEATURES)
    found = forest.refitted(rows, {0: (9, 2, 2), 1: (9, 2, 2)})
    assert 0 in found[1].rows[:, 0] and found[1].value[:, 0] == pytest.approx([both["score"].iloc[-1]] * 9)
    assert len(found[0].levels) == 2
