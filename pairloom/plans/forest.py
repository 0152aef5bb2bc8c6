"""Random-forest meta-learner: grid search over the repeated splits of each fold.

A forest is fitted without any bound on its nodes but the greatest depth and one row a child. All features are tried at every node,
and what a node is split by does not depend on the bounds, so a forest with a smaller depth or a least number of rows for a split is the
same forest cut where a bound first holds. One fit for each fold, split and number of trees serves the whole grid.

Spark ML fits folds of few rows. Beyond ``FEW_ROWS`` the forests of all folds and splits are grown together (``forest_levels``).
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.config import ForestGrid
from pairloom.functions import metrics
from pairloom.operators.rank_cuts import in_test
from pairloom.plans import forest_levels
from pairloom.session import scratch_path

ROWS_TOGETHER = 1 << 14
PAIRS_A_TREE = 64
FEW_ROWS = 10_000  # of a fold; Spark ML takes the cuts of more rows from a sample of so many
SEED = 39
PARAMS = ["n_estimators", "max_depth", "min_samples_split"]
NODES = "tree int, node int, value double, rows bigint, left int, right int, feature int, cut double"


def forest(n_estimators: int, max_depth: int, seed: int = SEED) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol="features",
        labelCol="score",
        predictionCol="rf",
        numTrees=n_estimators,
        maxDepth=max_depth,
        minInstancesPerNode=1,
        featureSubsetStrategy="all",
        cacheNodeIds=True,  # a row goes on from its nodes, not from the roots at every level
        seed=seed,
    )


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def stored_rows(rows: DataFrame, features: list[str]) -> DataFrame:
    """fold, test_splits, score and features, written by fold so that a fit opens the rows of its own fold only."""
    ready = assembled(rows, features).select("fold", "test_splits", "score", "features")
    path = scratch_path(rows.sparkSession, "forest-rows")
    ready.write.partitionBy("fold").parquet(path)
    return rows.sparkSession.read.schema(ready.schema).parquet(path)


def node_table(model: RandomForestRegressionModel, spark: SparkSession) -> pd.DataFrame:
    """The nodes of a fitted forest, read from what it saves: at most trees x 2^(depth + 1) rows.

    The layout is that of the library's stored models. One that lacks a field, or whose trees do not hang together, is an error.
    """
    path = scratch_path(spark, "forest")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    wanted = {
        "tree": "treeID", "node": "nodeData.id", "value": "nodeData.prediction", "rows": "nodeData.rawCount", "left": "nodeData.leftChild",
        "right": "nodeData.rightChild", "feature": "nodeData.split.featureIndex", "cut": "nodeData.split.leftCategoriesOrThreshold",
    }
    fields = {f"nodeData.{f.name}" for f in data.schema["nodeData"].dataType.fields} if "nodeData" in data.columns else set()
    if "nodeData.split" in fields:
        fields |= {f"nodeData.split.{f.name}" for f in data.schema["nodeData"].dataType["split"].dataType.fields}
    missing = sorted(set(wanted.values()) - fields - set(data.columns))
    if missing:
        raise RuntimeError(f"stored forests of this library version have another layout: no {', '.join(missing)}")
    columns = {name: F.col(path) for name, path in wanted.items()}
    columns["cut"] = F.get(columns["cut"], F.lit(0))
    nodes = data.select(*[column.alias(name) for name, column in columns.items()]).toPandas()
    inner = nodes[nodes["left"] >= 0]
    both = inner.merge(nodes, left_on=["tree", "left"], right_on=["tree", "node"], suffixes=("", "_l")).merge(
        nodes, left_on=["tree", "right"], right_on=["tree", "node"], suffixes=("", "_r")
    )
    if len(both) != len(inner) or (both["rows"] != both["rows_l"] + both["rows_r"]).any() or nodes["tree"].nunique() != model.getNumTrees:
        raise RuntimeError("stored forests of this library version have another layout: children do not add up to their node")
    return nodes.fillna({"feature": 0, "cut": 0.0}).astype({"tree": "int32", "node": "int32", "feature": "int32", "left": "int32", "right": "int32"})


class Trees:
    """A fitted forest, for predictions of the forest cut at any depth and least number of rows.

    A node's rows are those drawn for its tree, a row drawn twice counts twice.
    """

    def __init__(self, nodes: pd.DataFrame):
        self.nodes = nodes
        shape = (int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1)
        at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())

        def table(column: str, dtype) -> np.ndarray:
            out = np.zeros(shape, dtype)
            out[at] = nodes[column].to_numpy()
            return out

        self.value, self.cut = table("value", float), table("cut", float)
        self.left, self.right, self.feature, self.rows = (table(c, int) for c in ("left", "right", "feature", "rows"))
        self.leaf = self.left < 0
        # Nodes as places in the flat tables, a leaf is its own child.
        first = np.arange(shape[0])[:, None] * shape[1]
        here = first + np.arange(shape[1])
        self.below = np.stack([np.where(self.leaf, here, first + side) for side in (self.left, self.right)], axis=2).reshape(-1, 2)
        self.levels = [first[:, 0]]  # inner nodes of each level above their children
        while len(inner := self.levels[-1][~self.leaf.ravel()[self.levels[-1]]]):
            self.levels[-1] = inner
            self.levels.append(self.below[inner].ravel())
        self.levels.pop()
        self.known: dict = {}
        # Each pair of a feature and a cut once, and for each tree the way down for bits of rows.
        inner = np.flatnonzero(~self.leaf.ravel())
        pairs, number = np.unique(np.stack([self.feature.ravel()[inner], self.cut.ravel()[inner]]), axis=1, return_inverse=True)
        self.pairs = pairs[0].astype(int), pairs[1]
        self.top = forest_levels.MOST_DEPTH if len(self.pairs[0]) <= PAIRS_A_TREE * shape[0] else 0  # levels gone down by bits
        pair_of = np.zeros(self.leaf.size, int)
        pair_of[inner] = number.ravel()
        self.ways = [self.way(root, pair_of) for root in first[:, 0]]

    def way(self, root: int, pair_of: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """What ``forest_levels.turns`` asks for, down to as many levels as it takes, and the node at the end of each path."""
        leaf, way, ends = self.leaf.ravel(), [], np.array([root])
        children = ends
        while len(way) < self.top and not leaf[children].all():
            places = np.flatnonzero(~leaf[children])
            way.append((places, pair_of[children[places]]))
            children = self.below[children[places]].ravel()
            ends = self.below[ends].ravel()
        return way, ends

    def ends(self, settings: list[tuple[int, int]]) -> np.ndarray:
        """(settings, nodes): the value of the node where a path to each node ends, cut by the setting."""
        if (key := tuple(settings)) not in self.known:
            value, rows = self.value.ravel(), self.rows.ravel()
            out = np.tile(value, (len(settings), 1))
            for place, (depth, least) in enumerate(settings):
                stopped = np.zeros(len(value), bool)
                for level, nodes in enumerate(self.levels):
                    stop = stopped[nodes] | (rows[nodes] < least) | (level >= depth)
                    held = nodes[stop]
                    for side in (0, 1):
                        below = self.below[held, side]
                        out[place, below] = out[place, held]
                        stopped[below] = True
            self.known[key] = out
        return self.known[key]

    def predictions(self, rows: np.ndarray, settings: list[tuple[int, int]]) -> np.ndarray:
        """(rows, settings): mean over the trees, each cut at the depth and where a node has fewer rows than the bound.

        A row goes down once, as a bit among the rows of a node; what each setting gives for the leaf it comes to is known beforehand.
        """
        n, columns = len(rows), np.ascontiguousarray(rows.T)
        every = forest_levels.packed_bits(np.ones(n, bool))
        right = np.empty((len(self.pairs[0]) if self.top else 0, len(every)), np.uint64)
        for place in range(len(right)):
            right[place] = forest_levels.packed_bits(~(columns[self.pairs[0][place]] <= self.pairs[1][place]))
        below, ends = self.below.ravel(), self.ends(settings)
        out = np.zeros((len(settings), n))
        for way, reached in self.ways:
            path = np.zeros(n, forest_levels.path_type(len(way)))
            for bits, _ in forest_levels.turns(every, way, right):
                path = (path << 1) | forest_levels.unpacked_bits(bits, n)
            node = reached.take(path)
            for _ in self.levels[self.top :]:
                to_right = ~(columns[self.feature.ravel()[node], np.arange(n)] <= self.cut.ravel()[node])
                node = below[2 * node + to_right]
            for place, values in enumerate(ends):
                out[place] += values.take(node)
        return out.T / len(self.ways)

    def cut_at(self, depth: int, least: int) -> "Trees":
        """The forest of one setting, with no nodes below those cut."""
        nodes = self.nodes
        kept, level = nodes[nodes["node"] == 0], 0
        parts = []
        while len(kept):
            stop = (kept["left"] < 0) | (kept["rows"] < least) | (level >= depth)
            parts.append(kept.assign(left=kept["left"].where(~stop, -1), right=kept["right"].where(~stop, -1)))
            inner = kept[~stop]
            below = pd.concat([inner[["tree", side]].rename(columns={side: "node"}) for side in ("left", "right")])
            kept, level = nodes.merge(below, on=["tree", "node"]), level + 1
        return Trees(pd.concat(parts, ignore_index=True))


def predicted_by(trees: Trees, features: list[Column]) -> Column:
    """The mean prediction of all trees, as a column of batches."""
    return guess_by(trees)(F.array(*features))


def guess_by(trees: Trees):
    """The same of an array of features; null for a null array."""
    whole = [(len(trees.levels), 0)]

    @F.pandas_udf("double")
    def guess(rows: pd.Series) -> pd.Series:
        given = np.flatnonzero(rows.notna())
        out = np.full(len(rows), np.nan)
        for first in range(0, len(given), ROWS_TOGETHER):
            part = given[first : first + ROWS_TOGETHER]
            out[part] = trees.predictions(np.stack(rows.iloc[part]), whole)[:, 0]
        return pd.Series(out)

    return guess


def with_forest_prediction(df: DataFrame, forests: dict[int, Trees], features: list[str], name: str = "rf") -> DataFrame:
    """Predict each row by the forest of its fold, all folds in one scan; null for a fold without one."""
    columns = F.array(*[F.col(f).cast("double") for f in features])  # null for the forests of other folds, as a function of batches sees all rows
    found = df.withColumns({f"_{name}_{fold}": guess_by(trees)(F.when(F.col("fold") == fold, columns)) for fold, trees in forests.items()})
    own = [f"_{name}_{fold}" for fold in forests]
    return found.withColumn(name, F.coalesce(*own, F.lit(None).cast("double"))).drop(*own)


def many_rows(rows: DataFrame, folds: list[int], depth: int) -> dict[int, int] | None:
    """Rows of each fold if the forests are to be grown together, else none."""
    counts = {row["fold"]: row["count"] for row in rows.filter(F.col("fold").isin(list(folds))).groupBy("fold").count().collect()}
    together = len(counts) == len(set(folds)) and max(counts.values(), default=0) > FEW_ROWS and depth <= forest_levels.MOST_DEPTH
    return counts if together else None


def forest_scores(rows: DataFrame, folds: list[int], n_splits: int, grid: ForestGrid, parallelism: int = 8) -> DataFrame:
    """Scores of every setting, fold and split on both sides.

    ``rows`` comes from ``stored_rows``. One fit to the greatest depth gives the scores of all depths and bounds. The fits of few rows are
    independent Spark jobs; a few run at a time so that short ones overlap.
    """
    settings = list(product(sorted(grid.max_depth), grid.min_samples_split))
    names = [f"p{place}" for place in range(len(settings))]
    counts = many_rows(rows, folds, max(grid.max_depth))

    def grown_together() -> list[tuple]:
        blocks = forest_levels.stored_blocks(rows, counts, list(range(n_splits)))
        heaps = forest_levels.grown(blocks, max(grid.n_estimators), max(grid.max_depth), SEED)
        found = []
        for trees in grid.n_estimators:
            for row in forest_levels.side_sums(blocks, heaps, trees, settings).collect():
                scores = forest_levels.scores_of(row)
                found.append((row.fold, row.split, trees, *settings[row.setting], row.side, *[scores[s] for s in metrics.SCORERS]))
        return found

    def fit_one(task):
        fold, split, trees = task
        own = rows.filter(F.col("fold") == fold).withColumn("side", F.when(in_test(split), "test").otherwise("train"))
        model = forest(trees, max(grid.max_depth)).fit(own.filter(F.col("side") == "train"))
        whole = Trees(node_table(model, rows.sparkSession))

        def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for first in range(0, len(frame), ROWS_TOGETHER):
                    part = frame.iloc[first : first + ROWS_TOGETHER]
                    found = whole.predictions(np.stack(part["features"]), settings)
                    yield pd.concat([part[["side", "score"]].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

        schema = "side string, score double, " + ", ".join(f"{name} double" for name in names)
        predicted = own.select("side", "score", vector_to_array("features").alias("features")).mapInPandas(predict, schema)
        scores = predicted.groupBy("side").agg(
            *[score(F.col("score"), F.col(name)).alias(f"{name}:{s}") for name in names for s, score in metrics.SCORERS.items()]
        )
        return [
            (fold, split, trees, *setting, row["side"], *[row[f"{name}:{s}"] for s in metrics.SCORERS])
            for row in scores.collect()
            for setting, name in zip(settings, names)
        ]

    if counts:
        results = [grown_together()]
    else:
        tasks = list(product(folds, range(n_splits), grid.n_estimators))
        with ThreadPoolExecutor(parallelism) as pool:
            results = list(pool.map(inheritable_thread_target(rows.sparkSession)(fit_one), tasks))
    scorers = ", ".join(f"{name} double" for name in metrics.SCORERS)
    schema = f"fold int, split int, n_estimators int, max_depth int, min_samples_split int, sample string, {scorers}"
    return rows.sparkSession.createDataFrame([row for found in results for row in found], schema)


def best_settings(scores: DataFrame) -> dict[int, tuple[int, int, int]]:
    """Best setting of each fold by mean test correlation."""
    tested = scores.filter(F.col("sample") == "test").groupBy("fold", *PARAMS).agg(F.avg("corr_scorer").alias("cv"))
    order = F.struct("cv", *[-F.col(p) for p in PARAMS])
    best = tested.groupBy("fold").agg(F.max_by(F.struct(*PARAMS), order).alias("best"))
    return {row.fold: tuple(row.best) for row in best.collect()}


def refitted(rows: DataFrame, best: dict[int, tuple[int, int, int]], parallelism: int = 8) -> dict[int, Trees]:
    """The best forest of each fold, fitted on all of its rows and cut by its setting; a few fits run at a time."""
    depth = max(depth for _, depth, _ in best.values())
    if counts := many_rows(rows, list(best), depth):
        blocks = forest_levels.stored_blocks(rows, counts, [forest_levels.ALL_ROWS])
        heaps = forest_levels.grown(blocks, max(trees for trees, _, _ in best.values()), depth, SEED)
        return {
            fold: Trees(heaps[fold, forest_levels.ALL_ROWS].nodes(blocks.cuts[fold, forest_levels.ALL_ROWS], blocks.means[fold], trees)).cut_at(depth, least)
            for fold, (trees, depth, least) in best.items()
        }

    def fit_one(task):
        fold, (trees, depth, least) = task
        model = forest(trees, depth).fit(rows.filter(F.col("fold") == fold))
        return fold, Trees(node_table(model, rows.sparkSession)).cut_at(depth, least)

    with ThreadPoolExecutor(parallelism) as pool:
        return dict(pool.map(inheritable_thread_target(rows.sparkSession)(fit_one), best.items()))


def save_forests(spark: SparkSession, forests: dict[int, Trees], path: str) -> None:
    """One table of nodes, by fold."""
    for fold, trees in forests.items():
        spark.createDataFrame(trees.nodes[[part.split()[0] for part in NODES.split(", ")]], NODES).write.parquet(f"{path}/fold={fold}")


def load_forests(spark: SparkSession, path: str, folds: list[int]) -> dict[int, Trees]:
    return {fold: Trees(spark.read.schema(NODES).parquet(f"{path}/fold={fold}").toPandas()) for fold in folds}
