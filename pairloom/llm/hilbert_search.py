"""Approximate nearest neighbours by shifted Hilbert curves.

Largest inner product becomes least distance by one more component, which lifts every vector to the greatest norm
(queries get 0 there). Each curve projects the lifted vectors to a few random directions, shifts them, and orders them
along a Hilbert curve. Spark range-partitions the order; places in it are cut into tiles of ``TILE`` rows.
A query visits the tiles around its own place, ``reach`` of the table to either side. Neighbouring tiles form about
``RANGES`` ranges a curve (more where one would hold over ``RANGE_ROWS`` rows). A task holds the queries that meet a range,
at most about ``ASKS`` of them (more are dealt into groups), takes its vectors tile by tile, and keeps one running list of
the best for each query, so a range hands on one list a query, however many tiles it has. The lists of all ranges
and curves are merged.

Equal vectors are placed and asked for once. Of equal vectors only the ``k`` + 1 smallest ids can be returned (one may be
the query's own), so these stand for the group. A tile gives the ``k`` + 1 best ids of a query: rounded products only
rule out what lies below the last of them by more than any rounding, and what is left is ranked by the product summed
in the order of the components, the one that is returned. Nothing that could be among the best of the visited tiles is
left out, ties included.

``reach`` is a share of the table. How much recall it buys depends on the vectors: where they have no structure
(independent directions in 64 dimensions) neighbours in space are hardly nearer on any curve, and only wide windows
find them; clustered vectors do with far less.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do rows without an id; a repeated id counts once, by the best of its vectors; ties go to the smaller id; fewer candidates than ``k`` give them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from pairloom.llm.common import numbered
from pairloom.session import written

CURVES = 4
DIRECTIONS = 10
BITS = 6
TILE = 2048
REACH = 0.2
RANGES = 8  # of a curve; a query meets those that its window touches
RANGE_ROWS = 1 << 20
ASKS = 1 << 15  # queries whose best ids a task keeps at a time
SEED = 3


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (``bits`` bits for each of the columns)."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    n = len(x)
    # From axes to the transposed index: undo the excess work of each level, then Gray code.
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | (((x[i] ^ flip) >> np.uint64(level)) & np.uint64(1))
    return key.astype(np.int64)


class Curve:
    """Random directions and a shift; keys of lifted vectors."""

    def __init__(self, number: int, size: int, seed: int = SEED):
        chance = np.random.default_rng([seed, number])
        count = min(DIRECTIONS, size)
        self.axes = np.linalg.qr(chance.standard_normal((size, count)))[0]
        self.shift = chance.uniform(-0.5, 0.5, count)

    def keys(self, lifted: np.ndarray, mean: np.ndarray, spread: float) -> np.ndarray:
        """Cells are of even size between three spreads on either side of the mean."""
        flat = (lifted - mean) @ self.axes / spread + self.shift
        cells = np.clip((flat + 3.5) / 7.0 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return hilbert_keys(cells, BITS)


def usable(vector: Column, size: int) -> Column:
    number = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(vector) == size) & finite & F.exists(number, lambda x: x != 0)


class Tile:
    """Ids and vectors of a tile, by id; the best ids of any queries."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, code = np.unique(ids, return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.code, self.points = code[order], points[order]
        self.starts = np.searchsorted(self.code, np.arange(len(self.ids)))
        self.longest = np.sqrt((points * points).sum(1).max())

    def best(self, asks: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of ``asks``, id and score of the ``most`` best ids of each row, ties to the smaller id."""
        count, size = asks.shape
        scores = asks @ self.points.T
        by_id = scores if len(self.ids) == len(self.code) else np.maximum.reduceat(scores, self.starts, axis=1)
        most = min(most, len(self.ids))
        level = np.partition(by_id, len(self.ids) - most, axis=1)[:, len(self.ids) - most]
        lengths = np.sqrt((asks * asks).sum(1))
        limits = np.finfo(np.float64)
        margin = 4 * (size + 2) * (limits.eps * lengths * self.longest + limits.tiny)
        row, at = np.nonzero(scores >= (level - margin)[:, None])
        score = np.zeros(len(row))
        for i in range(size):  # the order of sums that the ranking uses
            score += asks[row, i] * self.points[at, i]
        code = self.code[at]
        order = np.lexsort((code, -score, row))
        row, code, score = row[order], code[order], score[order]
        if by_id is not scores:  # an id counts by its best vector
            first = np.sort(np.unique(row * len(self.ids) + code, return_index=True)[1])
            row, code, score = row[first], code[first], score[first]
        kept = np.arange(len(row)) - np.searchsorted(row, np.arange(count))[row] < most
        return row[kept], self.ids[code[kept]], score[kept]


def best_of(row: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best ids of each row, an id by its best score, ties to the smaller id."""
    _, code = np.unique(near, return_inverse=True)
    order = np.lexsort((-score, code, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (row[order][1:] != row[order][:-1]) | (code[order][1:] != code[order][:-1])
    order = order[fresh]
    order = order[np.lexsort((code[order], -score[order], row[order]))]
    place = row[order]
    order = order[np.arange(len(order)) - np.searchsorted(place, place) < most]
    return row[order], near[order], score[order]


class Asks:
    """Queries of a range with the tiles they visit, and the best ids found for each so far."""

    def __init__(self, parts: list[pa.RecordBatch], size: int, most: int):
        self.parts, self.most = parts, most
        self.first, self.last = (
            np.concatenate([part.column(c).to_numpy() for part in parts]) for c in ("tile", "last")
        )
        self.vectors = np.concatenate([_matrix(part.column("v"), size) for part in parts])
        self.best = None

    def meet(self, number: int, tile: Tile) -> None:
        there = np.flatnonzero((self.first <= number) & (number <= self.last))
        found = [] if self.best is None else [self.best]
        for at in range(0, len(there), 512):
            some = there[at : at + 512]
            row, near, score = tile.best(self.vectors[some], self.most)
            found.append((some[row], near, score))
        if found:
            self.best = best_of(*[np.concatenate(columns) for columns in zip(*found)], self.most)

    def lists(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if self.best is None:
            return
        row, near, score = self.best
        start = 0
        for part in self.parts:
            bounds = np.searchsorted(row, np.arange(start, start + part.num_rows + 1))
            inside, start = slice(bounds[0], bounds[-1]), start + part.num_rows
            offsets = pa.array(bounds - bounds[0], pa.int32())
            ids = pa.ListArray.from_arrays(offsets, pa.array(near[inside], id_type))
            scores = pa.ListArray.from_arrays(offsets, pa.array(score[inside]))
            yield pa.RecordBatch.from_arrays([part.column("h1"), part.column("h2"), ids, scores], names=["h1", "h2", "ids", "scores"])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    curves: int = CURVES,
    reach: float = REACH,
    tile: int = TILE,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest found of every row that ``is_query`` takes."""
    rows = vectors.select(F.col(id_col).alias("id"), is_query.alias("query"), F.col(vector).alias("v")).filter("id IS NOT NULL")
    sizes = rows.filter("size(v) > 0").groupBy(F.size("v").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    size = most.size if most else 1
    numbers = F.transform("v", lambda x: x.cast("double"))
    rows = rows.filter(usable(F.col("v"), size)).withColumn("v", numbers)
    same = [F.xxhash64("v", F.lit(1)).alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2")]  # 128 bits that stand for a vector
    owned = rows.select("id", F.coalesce("query", F.lit(False)).alias("query"), *same, "v").groupBy("id", "h1", "h2")
    owned = written(owned.agg(F.max("query").alias("query"), F.first("v").alias("v")), "vectors")
    line = Window.partitionBy("h1", "h2").orderBy("id")
    rows = owned.withColumn("_at", F.row_number().over(line)).filter(F.col("_at") <= k + 1)
    rows = rows.select(F.lit(0).alias("kind"), "h1", "h2", "id", "v")
    asked = owned.filter("query").dropDuplicates(["h1", "h2"])
    asked = asked.select(F.lit(1).alias("kind"), "h1", "h2", F.lit(None).cast(owned.schema["id"].dataType).alias("id"), "v")
    points = written(rows.unionByName(asked), "points")
    rows = points.filter("kind = 0")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    whole = rows.agg(F.count("*").alias("n"), F.max(square).alias("most"), F.avg(square).alias("mean")).first()
    places = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean")).collect()
    mean = np.zeros(size + 1)
    for row in places:  # one row for each component
        mean[row.i] = row.mean
    top = whole.most or 0.0
    mean[size] = np.sqrt(max(top - (whole.mean or 0.0), 0.0))
    spread = float(np.sqrt(max(top - float(mean @ mean), 1e-12) / (size + 1))) if whole.n else 1.0

    def keyed(batches):
        lines = [Curve(c, size + 1) for c in range(curves)]
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = batch.column("kind").to_numpy()
            for kind in (0, 1):
                part = batch.filter(pa.array(kinds == kind))
                own = _matrix(part.column("v"), size)
                norms = (own * own).sum(1)
                if kind:
                    lifted = np.column_stack([own * np.sqrt(top / norms)[:, None], np.zeros(len(own))])
                else:
                    lifted = np.column_stack([own, np.sqrt(np.maximum(top - norms, 0.0))])
                for number, line in enumerate(lines):
                    keys = pa.array(line.keys(lifted, mean, spread), pa.int64())
                    curve = pa.array(np.full(len(keys), number, np.int32))
                    yield pa.RecordBatch.from_arrays([curve, keys, *part.columns], names=["curve", "key", *part.schema.names])

    id_type = points.schema["id"].dataType.simpleString()
    line = points.mapInArrow(keyed, f"curve int, key long, kind int, h1 long, h2 long, id {id_type}, v array<double>")
    order = [F.col(c) for c in ("curve", "key", "kind", "h1", "h2", "id")]
    placed = numbered(line, order, "curve-places", "place")
    queries = points.filter("kind = 1").count()
    length = whole.n + queries  # rows of each curve
    placed = placed.withColumn("place", F.col("place") - F.col("curve") * F.lit(length))
    window = F.lit(max(int(2 * reach * length), 2 * k))
    start = F.greatest(F.lit(0), F.least(F.col("place") - F.floor(window / 2), F.lit(length) - window))
    stop = F.least(start + window, F.lit(length - 1))
    home = F.col("place") - F.col("place") % tile
    tiles = max(1, -(-length // tile))
    wide = max(1, min(-(-tiles // RANGES), RANGE_ROWS // tile))  # tiles of a range
    groups = max(1, math.ceil(queries * min(1.0, 2 * reach + 2 * wide / tiles) / ASKS))
    first, last = (F.floor(end / tile).cast("long") for end in (start, stop))
    met = F.sequence(F.floor(first / wide).cast("long"), F.floor(last / wide).cast("long"))
    group = F.pmod(F.col("h1"), F.lit(groups)).cast("int")
    rest = ["h1", "h2", "id", "v"]
    asked = placed.filter("kind = 1").select(
        "curve", F.explode(met).alias("range"), group.alias("group"), F.lit(0).alias("step"), first.alias("tile"), last.alias("last"), *rest
    )
    own = (home / tile).cast("long")
    held = placed.filter("kind = 0").select(
        "curve", F.floor(own / wide).cast("long").alias("range"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"),
        F.lit(1).alias("step"), own.alias("tile"), own.alias("last"), *rest,
    )
    together = held.unionByName(asked).repartition("curve", "range", "group")
    together = together.sortWithinPartitions("curve", "range", "group", "step", "tile")

    def look(batches):
        key, number, asks = None, None, None
        waiting, ids, points = [], [], []

        def end_tile():
            if ids and asks is not None:
                asks.meet(number, Tile(np.concatenate(ids), np.concatenate(points)))
            ids.clear(), points.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("curve", "range", "group", "step", "tile")], 1)
            marks[marks[:, 3] == 0, 4] = -1  # queries stay together, whichever tile they begin with
            edges = np.flatnonzero((np.diff(marks, axis=0) != 0).any(1)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                *place, step, here = marks[a]
                part = batch.slice(int(a), int(b - a))
                if place != key:
                    end_tile()
                    if asks is not None:
                        yield from asks.lists(id_arrow)
                    key, number, asks = place, None, None
                    waiting.clear()
                if step == 0:
                    waiting.append(part)
                    continue
                if waiting:
                    asks = Asks(waiting[:], size, k + 1)
                    waiting.clear()
                if here != number:
                    end_tile()
                    number = here
                if asks is not None:
                    ids.append(part.column("id").to_numpy(zero_copy_only=False))
                    points.append(_matrix(part.column("v"), size))
        end_tile()
        if asks is not None:
            yield from asks.lists(id_arrow)

    id_arrow = to_arrow_type(points.schema["id"].dataType)

    found = together.mapInArrow(look, f"h1 long, h2 long, ids array<{id_type}>, scores array<double>")
    pairs = found.select("h1", "h2", F.explode(F.arrays_zip("ids", "scores")).alias("f"))
    pairs = pairs.select("h1", "h2", F.col("f.ids").alias("id"), F.col("f.scores").alias("near"))
    pairs = pairs.groupBy("h1", "h2", "id").agg(F.max("near").alias("near"))
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("near"), "id")
    pairs = pairs.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= k + 1)
    asks = owned.filter("query").select(F.col("id").alias("query_id"), "h1", "h2", F.col("v").alias("q"))
    pairs = pairs.join(asks.drop("q"), ["h1", "h2"]).filter("id != query_id")
    pairs = pairs.groupBy("query_id", "id").agg(F.max("near").alias("near"))
    order = Window.partitionBy("query_id")
    pairs = pairs.withColumn("_at", F.row_number().over(order.orderBy(F.desc("near"), "id"))).filter(F.col("_at") <= k)
    # Scores by the best of all vectors of the two ids, visited or not.
    ends = owned.select("id", "v")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    exact = pairs.select("query_id", "id").join(ends, "id").join(asks.select("query_id", "q"), "query_id")
    exact = exact.groupBy("query_id", "id").agg(F.max(product).alias("score"))
    rank = F.row_number().over(order.orderBy(F.desc("score"), "id")).alias("rank")
    return exact.select("query_id", rank, F.col("id").alias("vec_id"), "score")
