"""Forests of many rows, grown level by level for all folds and splits at once.

The trees are those of Spark ML's forests: rows drawn by a Poisson law of mean one, at most 32 bins of a feature, the cut of the greatest
drop in variance over all features, no bound but the depth and one row a child. What differs is the way:

- Rows are stored once, in blocks of one fold: label, bits of the test sides, and for each split the bin of each feature.
- The rows of a node are bits of a block. A level of a tree is a few operations on such words, so a row needs no memory between levels;
  its draws are repeated from the numbers of its block and tree, and are the same for all splits.
- A task adds up rows and labels by node, feature and bin for a part of the rows and some trees, and hands on one sum for each split.
  Of two children only the smaller one is added up, the other is its parent less that.
- The sums of a few trees are merged in one group, which chooses the cuts; the driver holds the nodes only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import metrics
from pairloom.session import written

ALL_ROWS = -1
BINS = 32  # as Spark ML's maxBins
ACCURACY = 10_000  # of the quantiles
BLOCK_ROWS = 1 << 16
PART_ROWS = 1 << 20  # rows of a task
TREES_TOGETHER = 32
MOST_MERGED = 1024  # sums of a tree that meet in one group
TASKS_A_CORE = 3
MOST_DEPTH = 10  # a path is a number of so many bits, a level has so many sets of rows
LEAST_GAIN = 1e-12  # of the sum of squares of a node: what is below comes from rounding
SUMS = ["n", "y", "yy", "p", "pp", "yp", "error", "squares"]


# ---- Bits of rows ---------------------------------------------------------


def packed_bits(flags: np.ndarray) -> np.ndarray:
    """Flags (..., rows) as words (..., rows / 64), the last one filled up with zeros."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    if short:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], short), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def unpacked_bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), count=n, bitorder="little")


def turns(rows: np.ndarray, way: list[tuple[np.ndarray, np.ndarray]], right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level of a tree the bits of the rows that turn right, and the bits of all children of its inner nodes in turn.

    ``way`` holds for each level the places of its inner nodes among the children of the level above, and their cuts as places in ``right``.
    """
    children = rows[None]
    for places, cuts in way:
        held = children if len(places) == len(children) else children[places]
        to_right = held & right[cuts]
        children = np.empty((len(held), 2, len(rows)), np.uint64)
        np.bitwise_xor(held, to_right, out=children[:, 0])
        children[:, 1] = to_right
        children = children.reshape(-1, len(rows))
        yield np.bitwise_or.reduce(to_right, axis=0), children


def path_type(depth: int) -> type:
    return np.uint8 if depth <= 8 else np.uint16


# ---- Draws ----------------------------------------------------------------

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(25)])
_ENDS = np.searchsorted(_POISSON, np.arange(1 << 16) / (1 << 16), side="right")
_UNDECIDED = 255
_DRAWN = np.where(_ENDS == np.searchsorted(_POISSON, np.arange(1, (1 << 16) + 1) / (1 << 16), side="left"), _ENDS, _UNDECIDED).astype(np.uint8)


def draws(seed: int, block: int, tree: int, n: int) -> np.ndarray:
    """How often each row of a block is drawn for a tree; the same whenever it is asked for."""
    source = np.random.SFC64([seed, block, tree])
    short = source.random_raw(-(-n // 4)).view(np.uint16)[:n]
    found = _DRAWN.take(short)
    open_ = np.flatnonzero(found == _UNDECIDED)  # 16 bits don't tell on which side of a bound of the law
    if len(open_):
        exact = (short[open_] + np.random.Generator(source).random(len(open_))) / (1 << 16)
        found[open_] = np.searchsorted(_POISSON, exact, side="right")
    return found


# ---- Rows as blocks -------------------------------------------------------


@dataclass
class Blocks:
    """The stored rows of some folds: blocks with bins by split, the values of the cuts, and the mean label of each fold."""

    table: DataFrame
    splits: list[int]
    cuts: dict[tuple[int, int], list[np.ndarray]]
    means: dict[int, float]
    width: int


def cut_values(rows: DataFrame, splits: list[int], width: int) -> dict[tuple[int, int], list[np.ndarray]]:
    """(fold, split): ascending cuts of each feature, a row with at most that value goes left.

    Cuts lie between all neighbours of a feature with at most 32 values in its fold, else at 31 quantiles of the rows that the split trains on.
    """

    def trained(split, column):
        return column if split == ALL_ROWS else F.when(F.col("test_splits").bitwiseAND(F.lit(1 << split)) == 0, column)

    shares = [k / BINS for k in range(1, BINS)]
    found = rows.groupBy("fold").agg(
        *[F.percentile_approx(trained(s, F.col(f"x{f}")), shares, ACCURACY).alias(f"q{s}_{f}") for s in splits for f in range(width)],
        *[F.approx_count_distinct(f"x{f}").alias(f"few{f}") for f in range(width)],
    )
    found = {row.fold: row for row in found.collect()}
    few = [(fold, f) for fold, row in found.items() for f in range(width) if row[f"few{f}"] <= 2 * BINS]
    values: dict[tuple[int, int], list[float]] = {}
    if few:
        cell = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"x{f}").alias("x")) for f in sorted({f for _, f in few})]))
        cells = rows.select("fold", cell.alias("cell")).select("fold", "cell.f", "cell.x")
        wanted = reduce(lambda a, b: a | b, [(F.col("fold") == fold) & (F.col("f") == f) for fold, f in few])
        for row in cells.filter(wanted).distinct().collect():
            values.setdefault((row.fold, row.f), []).append(row.x)
    cuts = {}
    for fold, row in found.items():
        for split in splits:
            cuts[fold, split] = []
            for f in range(width):
                known = np.unique(values.get((fold, f), []))
                quantiles = np.unique(np.asarray(row[f"q{split}_{f}"] or [], float))
                cuts[fold, split].append((known[:-1] + known[1:]) / 2 if 0 < len(known) <= BINS else quantiles)
    return cuts


def stored_blocks(rows: DataFrame, counts: dict[int, int], splits: list[int]) -> Blocks:
    """``rows`` (fold, test_splits, score, features) of the folds in ``counts`` as blocks, written once; a label that is missing is an error."""
    width = len(rows.first()["features"])
    x = vector_to_array("features")
    rows = rows.filter(F.col("fold").isin(list(counts))).select("fold", "test_splits", F.col("score").cast("double"), *[x[f].alias(f"x{f}") for f in range(width)])
    cuts = cut_values(rows, splits, width)
    means = {row.fold: row.mean or 0.0 for row in rows.groupBy("fold").agg(F.avg("score").alias("mean")).collect()}
    columns, first, parts = [f"x{f}" for f in range(width)], {}, {}
    for fold in sorted(counts):
        first[fold], parts[fold] = sum(parts.values()), -(-counts[fold] // PART_ROWS)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 24

        def block(fold: int, held: list[np.ndarray], tests: list[np.ndarray]) -> pd.DataFrame:
            nonlocal number
            values, number = np.concatenate(held), number + 1
            if np.isnan(values[:, -1]).any():
                raise ValueError("a label is missing")
            bins = np.stack([[np.searchsorted(cuts[fold, s][f], values[:, f]) for f in range(width)] for s in splits]).astype(np.uint8)
            part = first[fold] + (number + (number >> 24)) % parts[fold]
            row = (fold, part, number, len(values), (values[:, -1] - means[fold]).tobytes(), np.concatenate(tests).astype("<i4").tobytes(), bins.tobytes())
            return pd.DataFrame([row], columns=["fold", "part", "block", "n", "score", "tests", "bins"])

        waiting: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            values, tests = batch[[*columns, "score"]].to_numpy(float), batch["test_splits"].to_numpy()
            for fold, places in batch.groupby("fold").indices.items():
                held, marks, n = waiting.setdefault(int(fold), ([], [], []))
                held.append(values[places])
                marks.append(tests[places])
                n.append(len(places))
                if sum(n) >= BLOCK_ROWS:
                    yield block(int(fold), held, marks)
                    del waiting[int(fold)]
        for fold, (held, marks, _) in waiting.items():
            yield block(fold, held, marks)

    schema = "fold int, part int, block bigint, n int, score binary, tests binary, bins binary"
    packed = rows.mapInPandas(pack, schema).repartitionById(sum(parts.values()), F.col("part"))
    return Blocks(written(packed.drop("part"), "forest-blocks"), splits, cuts, means, width)


class _Block:
    """A block in a task."""

    def __init__(self, row, width: int):
        self.fold, self.number, self.n = int(row.fold), int(row.block), int(row.n)
        self.y = np.frombuffer(row.score, float)
        self.tests = np.frombuffer(row.tests, "<i4")
        self.bins = np.frombuffer(row.bins, np.uint8).reshape(-1, width, self.n)

    def trained(self, split: int) -> np.ndarray:
        return np.ones(self.n, bool) if split == ALL_ROWS else (self.tests >> split) & 1 == 0

    def right_of_cuts(self, place: int) -> np.ndarray:
        """(features x cuts, words): the rows right of each cut, for the split at that place."""
        cuts = np.arange(BINS - 1, dtype=np.uint8)[:, None]
        return np.concatenate([packed_bits(own > cuts) for own in self.bins[place]])


# ---- Trees as places of a heap --------------------------------------------


class Heap:
    """The trees of one fold and split: node 0 is the root, the children of i are 2i + 1 and 2i + 2."""

    def __init__(self, n_trees: int, depth: int):
        inner, every = (1 << depth) - 1, (2 << depth) - 1
        self.depth = depth
        self.feature = np.full((n_trees, inner), -1, np.int16)  # of inner nodes
        self.cut = np.zeros((n_trees, inner), np.uint8)
        self.value, self.rows = np.zeros((n_trees, every)), np.zeros((n_trees, every))
        self.known = np.zeros((n_trees, every), bool)
        self.known[:, 0] = True

    @staticmethod
    def level(table: np.ndarray, level: int) -> np.ndarray:
        return table[:, (1 << level) - 1 : (2 << level) - 1]

    def way(self, tree: int, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """What ``turns`` asks for, down to the level."""
        found, above = [], np.zeros(1, int)  # numbers of the children of the level above
        for level in range(levels):
            feature = self.level(self.feature, level)[tree]
            inner = np.flatnonzero(feature >= 0)
            if not len(inner):
                break
            found.append((np.searchsorted(above, inner), feature[inner].astype(int) * (BINS - 1) + self.level(self.cut, level)[tree, inner]))
            above = np.stack([2 * inner, 2 * inner + 1], axis=1).ravel()
        return found

    def parents(self, tree: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the nodes with children on that level, and whether the right child is the smaller one."""
        inner = np.flatnonzero(self.level(self.feature, level - 1)[tree] >= 0)
        rows = self.level(self.rows, level)[tree]
        return inner, rows[2 * inner + 1] < rows[2 * inner]

    def split(self, tree: int, level: int, numbers: np.ndarray, chosen: np.ndarray) -> None:
        """Enter the nodes of a level: feature (or -1), cut, and rows and labels of the node and of its left child."""
        feature, cut, n, y, n_left, y_left = chosen
        inner = feature >= 0
        self.level(self.feature, level)[tree, numbers] = feature
        self.level(self.cut, level)[tree, numbers] = cut
        for table, whole, left in ((self.rows, n, n_left), (self.value, y / np.maximum(n, 1), y_left / np.where(inner, n_left, 1))):
            self.level(table, level)[tree, numbers] = whole
            self.level(table, level + 1)[tree, 2 * numbers[inner]] = left[inner]
        right = 2 * numbers[inner] + 1
        self.level(self.rows, level + 1)[tree, right] = (n - n_left)[inner]
        self.level(self.value, level + 1)[tree, right] = ((y - y_left) / np.where(inner, n - n_left, 1))[inner]
        for side in (0, 1):
            self.level(self.known, level + 1)[tree, 2 * numbers[inner] + side] = True

    def ends(self, depth: int, least: int) -> np.ndarray:
        """(trees, paths): the value where each path ends, cut at the depth and where a node has fewer rows."""
        value, stop = self.value[:, :1], np.zeros((len(self.value), 1), bool)
        for level in range(self.depth):
            stop = stop | (level >= depth) | (self.level(self.feature, level) < 0) | (self.level(self.rows, level) < least)
            stop, value = np.repeat(stop, 2, axis=1), np.repeat(value, 2, axis=1)
            value = np.where(stop, value, self.level(self.value, level + 1))
        return value

    def nodes(self, cuts: list[np.ndarray], mean: float, n_trees: int) -> pd.DataFrame:
        """The table of nodes that ``forest.Trees`` takes; labels get the mean of their fold back."""
        tree, node = np.nonzero(self.known[:n_trees])
        inside = np.minimum(node, self.feature.shape[1] - 1)
        feature = np.where(node < self.feature.shape[1], self.feature[tree, inside], -1)
        inner = feature >= 0
        cut = [float(cuts[f][c]) if f >= 0 else 0.0 for f, c in zip(feature, self.cut[tree, inside])]
        return pd.DataFrame(
            {
                "tree": tree.astype("int32"), "node": node.astype("int32"), "value": self.value[tree, node] + mean,
                "rows": self.rows[tree, node].astype("int64"), "left": np.where(inner, 2 * node + 1, -1).astype("int32"),
                "right": np.where(inner, 2 * node + 2, -1).astype("int32"), "feature": np.where(inner, feature, 0).astype("int32"), "cut": cut,
            }
        )


# ---- Growing --------------------------------------------------------------


def best_cuts(sums: np.ndarray) -> np.ndarray:
    """(feature or -1, cut, rows, labels, rows left, labels left) of each node, from its sums (nodes, features, bins, rows and labels).

    The first cut of the greatest gain that leaves rows on both sides.
    """
    left = np.cumsum(sums, axis=2)
    n, y = left[:, 0, -1, 0], left[:, 0, -1, 1]
    n_left, y_left = left[:, :, :-1, 0], left[:, :, :-1, 1]
    n_right, y_right = n[:, None, None] - n_left, y[:, None, None] - y_left
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = y_left**2 / n_left + y_right**2 / n_right - (y**2 / n)[:, None, None]
    gain = np.where((n_left >= 1) & (n_right >= 1), gain, -np.inf).reshape(len(sums), -1)
    best = gain.argmax(axis=1)
    at = np.arange(len(sums))
    feature, cut = np.divmod(best, sums.shape[2] - 1)
    inner = gain[at, best] > LEAST_GAIN * y**2 / np.maximum(n, 1)
    return np.stack([np.where(inner, feature, -1), cut, n, y, n_left.reshape(len(sums), -1)[at, best], y_left.reshape(len(sums), -1)[at, best]])


def _added(block: _Block, place: int, split: int, trees: list, weights: np.ndarray, drawn: np.ndarray, total: np.ndarray, depth: int) -> None:
    """Add the rows of a block to the sums of its smaller nodes, for the trees of a group in one split."""
    n, width = block.n, block.bins.shape[1]
    trained = packed_bits(block.trained(split))
    right = block.right_of_cuts(place) if any(way for way, *_ in trees) else None
    bins = block.bins[place].astype(np.intp)
    for (way, smaller, ranks, offset), weight, own in zip(trees, weights, drawn):
        if not len(smaller):
            continue
        rows = own & trained
        path = np.zeros(n, path_type(depth))
        picked = rows
        for bits, children in turns(rows, way, right):
            path = (path << 1) | unpacked_bits(bits, n)
            picked = children
        if way:
            picked = np.bitwise_or.reduce(picked[smaller], axis=0)
        at = np.flatnonzero(unpacked_bits(picked, n).view(bool))
        node = ranks.take(path.take(at) >> 1) * BINS
        w = weight.take(at).astype(float)
        wy = w * block.y.take(at)
        size = len(smaller) * BINS
        for f in range(width):
            key = node + bins[f].take(at)
            sums = total[offset : offset + len(smaller), f]
            sums[..., 0] += np.bincount(key, w, size).reshape(-1, BINS)
            sums[..., 1] += np.bincount(key, wy, size).reshape(-1, BINS)


def _ways(heap: Heap, first: int, last: int, level: int) -> tuple[list, int]:
    """For each tree of a group the way to the level, its smaller children among all, their ranks by the number of the parent, and their offset."""
    found, offset = [], 0
    for tree in range(first, min(last, len(heap.value))):
        if level:
            inner, to_right = heap.parents(tree, level)
            ranks = np.zeros(1 << level, np.intp)
            ranks[inner] = np.arange(len(inner))
            smaller = 2 * np.arange(len(inner)) + to_right
        else:
            smaller, ranks = np.zeros(1, int), np.zeros(1, np.intp)
        found.append((heap.way(tree, level), smaller, ranks, offset))
        offset += len(smaller)
    return found, offset


def grown(blocks: Blocks, n_trees: int, depth: int, seed: int) -> dict[tuple[int, int], Heap]:
    """The forests of all folds and splits, one job a level."""
    if depth > MOST_DEPTH:
        raise ValueError(f"trees of more than {MOST_DEPTH} levels are not grown this way")
    heaps = {key: Heap(n_trees, depth) for key in blocks.cuts}
    table, splits, width = blocks.table, blocks.splits, blocks.width
    cores, parts = table.sparkSession.sparkContext.defaultParallelism, max(table.rdd.getNumPartitions(), 1)
    together = max(1, min(TREES_TOGETHER, MOST_MERGED // parts, n_trees * parts // (TASKS_A_CORE * cores)))
    groups = range(-(-n_trees // together))
    spread = reduce(DataFrame.unionAll, [table.withColumn("grp", F.lit(g)) for g in groups])
    before = None
    for level in range(depth):
        sums = spread.mapInPandas(_gather(heaps, splits, width, together, level, depth, seed), "fold int, split int, grp int, whole boolean, sums binary")
        if before is not None:
            sums = sums.unionAll(before)
        chosen = sums.groupBy("fold", "split", "grp").applyInPandas(
            _choose(heaps, width, together, level), "fold int, split int, grp int, chosen binary, sums binary"
        )
        chosen = written(chosen, "forest-level")
        before = chosen.select("fold", "split", "grp", F.lit(True).alias("whole"), "sums")
        for row in chosen.select("fold", "split", "grp", "chosen").collect():
            heap, start = heaps[row.fold, row.split], 0
            found = np.frombuffer(row.chosen, float).reshape(6, -1)
            for tree in range(row.grp * together, min((row.grp + 1) * together, n_trees)):
                numbers = np.flatnonzero(heap.level(heap.known, level)[tree])
                heap.split(tree, level, numbers, found[:, start : start + len(numbers)])
                start += len(numbers)
        if not any((heap.level(heap.feature, level) >= 0).any() for heap in heaps.values()):
            break
    return heaps


def _gather(heaps: dict, splits: list[int], width: int, together: int, level: int, depth: int, seed: int):
    """Sums of the smaller nodes of a level, for each fold and split in the rows of a task and the trees of its group."""
    shapes = {key: (heap.feature, heap.cut, heap.level(heap.rows, level), len(heap.value)) for key, heap in heaps.items()}

    def plan(key: tuple[int, int], group: int) -> tuple[list, int]:
        feature, cut, rows, n_trees = shapes[key]
        heap = Heap.__new__(Heap)
        heap.feature, heap.cut, heap.value, heap.depth = feature, cut, np.empty((n_trees, 0)), depth
        heap.rows = np.zeros((n_trees, (2 << level) - 1))
        heap.level(heap.rows, level)[:] = rows
        return _ways(heap, group * together, (group + 1) * together, level)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int, int], tuple[list, np.ndarray]] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                block, group = _Block(row, width), int(row.grp)
                n_trees = len(shapes[block.fold, splits[0]][0])
                trees = range(group * together, min((group + 1) * together, n_trees))
                weights = np.stack([draws(seed, block.number, tree, block.n) for tree in trees])
                drawn = packed_bits(weights > 0)
                for place, split in enumerate(splits):
                    key = (block.fold, split, group)
                    if key not in held:
                        ways, size = plan(key[:2], group)
                        held[key] = ways, np.zeros((size, width, BINS, 2))
                    if len(held[key][1]):
                        _added(block, place, split, held[key][0], weights, drawn, held[key][1], depth)
        for key, (_, total) in held.items():
            if len(total):
                yield pd.DataFrame([(*key, False, total.tobytes())], columns=["fold", "split", "grp", "whole", "sums"])

    return gather


def _choose(heaps: dict, width: int, together: int, level: int):
    """The cuts of a group's nodes on a level, and the sums of those that have children."""
    sides = {}
    if level:
        for key, heap in heaps.items():
            sides[key] = [heap.parents(tree, level)[1] for tree in range(len(heap.value))]

    def choose(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        fold, split, group = (int(k) for k in key)
        arrays = {True: None, False: None}
        for whole, data in zip(parts["whole"], parts["sums"]):
            one = np.frombuffer(data, float).reshape(-1, width, BINS, 2)
            arrays[bool(whole)] = one if arrays[bool(whole)] is None else arrays[bool(whole)] + one
        sums, parents = arrays[False], arrays[True]
        if parents is not None:
            if not len(parents):
                return pd.DataFrame(columns=["fold", "split", "grp", "chosen", "sums"])
            to_right = np.concatenate(sides[fold, split][group * together : (group + 1) * together]).astype(int)
            both = np.empty((len(parents), 2, width, BINS, 2))
            at = np.arange(len(parents))
            both[at, to_right] = sums
            both[at, 1 - to_right] = parents - sums
            sums = both.reshape(-1, width, BINS, 2)
        chosen = best_cuts(sums)
        kept = sums[chosen[0] >= 0]
        return pd.DataFrame([(fold, split, group, chosen.tobytes(), kept.tobytes())], columns=["fold", "split", "grp", "chosen", "sums"])

    return choose


# ---- Scores ---------------------------------------------------------------


def side_sums(blocks: Blocks, heaps: dict[tuple[int, int], Heap], n_trees: int, settings: list[tuple[int, int]]) -> DataFrame:
    """(fold, split, side, setting) with sums over rows of labels, predictions and their differences.

    A row goes down each tree once. Settings that cut a tree in the same way share its values. Labels and predictions are those less the
    mean label of the fold.
    """
    width, splits = blocks.width, blocks.splits

    def plan(heap: Heap) -> list:
        ends, trees = np.stack([heap.ends(*setting) for setting in settings]), []
        for tree in range(n_trees):
            tables: dict[bytes, list[int]] = {}
            for place in range(len(settings)):
                tables.setdefault(ends[place, tree].tobytes(), []).append(place)
            trees.append((heap.way(tree, heap.depth), [(tuple(places), np.frombuffer(data, float)) for data, places in tables.items()]))
        return trees

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans: dict[tuple[int, int], list] = {}  # of the folds in a task
        for batch in batches:
            for row in batch.itertuples(index=False):
                block, place = _Block(row, width), int(row.place)
                key = (block.fold, splits[place])
                if key not in plans:
                    plans[key] = plan(heaps[key])
                found = _predicted(block, place, plans[key], heaps[key].depth, len(settings)) / n_trees
                trained, made = block.trained(splits[place]), []
                for side, mask in (("test", ~trained), ("train", trained)):
                    if mask.any():
                        made += _summed(block.y[mask], found[:, mask], (*key, side))
                yield pd.DataFrame(made, columns=["fold", "split", "side", "setting", *SUMS, "y_min", "y_max", "p_min", "p_max"])

    numbers = ", ".join(f"{name} double" for name in [*SUMS, "y_min", "y_max", "p_min", "p_max"])
    spread = reduce(DataFrame.unionAll, [blocks.table.withColumn("place", F.lit(place)) for place in range(len(splits))])
    partial = spread.mapInPandas(score, f"fold int, split int, side string, setting int, {numbers}")
    return partial.groupBy("fold", "split", "side", "setting").agg(
        *[F.sum(name).alias(name) for name in SUMS],
        *[F.min(f"{v}_min").alias(f"{v}_min") for v in "yp"],
        *[F.max(f"{v}_max").alias(f"{v}_max") for v in "yp"],
    )


def _predicted(block: _Block, place: int, trees: list, depth: int, n_settings: int) -> np.ndarray:
    """(settings, rows): sums over the trees."""
    right, every = block.right_of_cuts(place), packed_bits(np.ones(block.n, bool))
    added: dict[tuple[int, ...], np.ndarray] = {}
    for way, tables in trees:
        path = np.zeros(block.n, path_type(depth))
        for bits, _ in turns(every, way, right):
            path = (path << 1) | unpacked_bits(bits, block.n)
        path = (path << (depth - len(way))).astype(np.intp)
        for places, values in tables:
            if places in added:
                added[places] += values.take(path)
            else:
                added[places] = values.take(path)
    out = np.zeros((n_settings, block.n))
    for places, total in added.items():
        for setting in places:
            out[setting] += total
    return out


def _summed(y: np.ndarray, predicted: np.ndarray, key: tuple) -> list[tuple]:
    gaps = predicted - y
    columns = [
        np.full(len(predicted), float(len(y))), np.full(len(predicted), y.sum()), np.full(len(predicted), y @ y), predicted.sum(axis=1),
        (predicted**2).sum(axis=1), predicted @ y, np.abs(gaps).sum(axis=1), (gaps**2).sum(axis=1),
        np.full(len(predicted), y.min()), np.full(len(predicted), y.max()), predicted.min(axis=1), predicted.max(axis=1),
    ]
    return [(*key, setting, *values) for setting, values in enumerate(zip(*columns))]


def scores_of(row) -> dict[str, float | None]:
    """The scores of ``metrics.SCORERS`` from the sums of a side."""
    y, p = row.y / row.n, row.p / row.n
    var_y = 0.0 if row.y_min == row.y_max else max(row.yy / row.n - y * y, 0.0)
    var_p = 0.0 if row.p_min == row.p_max else max(row.pp / row.n - p * p, 0.0)
    spread = math.sqrt(var_y) * math.sqrt(var_p)
    return {
        "neg_mean_absolute_error": -row.error / row.n,
        "neg_mean_squared_error": -row.squares / row.n,
        "r2": 1 - row.squares / (var_y * row.n) if var_y > 0 else float(row.squares == 0),
        "corr_scorer": (row.yp / row.n - y * p) / spread if spread > 0 else None,
    }


assert set(metrics.SCORERS) == {"neg_mean_absolute_error", "neg_mean_squared_error", "r2", "corr_scorer"}
