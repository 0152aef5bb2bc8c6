"""Whiten vectors along the principal components of their covariance.

1. *Sums.* One pass takes the count and the exact sum of every dimension, a second the covariance of the vectors around that mean:
   each task adds up one small matrix of its rows, a group-by adds the tasks' matrices entry by entry.
2. *Components.* Spectral divide and conquer. The polar factor of the covariance less a shift, by QDWH (dynamically weighted
   Halley steps on a QR factorisation), is the matrix sign, so half of it plus the identity projects on the subspace of
   the larger eigenvalues. Bases of that subspace and of the rest split the matrix in two, and each part is split again until it has
   one dimension or all its eigenvalues are equal to working precision. Parts below the wanted components are left whole.
   This is work on one matrix of dimension x dimension (at most ``MOST_DIMENSIONS``), whatever the number of vectors.
3. *Whitening.* Mean, components and eigenvalues, of the same bounded size, go with the tasks, which project their rows.

Entries are whole numbers, floor(scale * c) + offset, so that sums and deviations are exact.

Defined results: vectors that are null, empty, or hold null or non-finite entries are left out, and so are those whose length is
not the most frequent one (the greatest of several) and those with an entry whose whole number is not below 2^53. Repeated rows and null
ids count as rows. An empty table gives an empty one. A component without variance (eigenvalue not above 1e-13 of the trace) has
whitened 0.0 and stays out of ``identity_error``. ``deviation`` is null where no long holds it. Extra columns are left out unless named
in ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, OFFSET = 1024, 100_000
MOST_DIMENSIONS = 4096  # the covariance of so many takes 128 MB
NO_VARIANCE = 1e-13  # share of the trace
EPS = np.finfo(float).eps


# ---- QDWH ---------------------------------------------------------------------


def polar(a: np.ndarray, floor: float = EPS / 4) -> np.ndarray:
    """Orthogonal factor of the polar decomposition of a symmetric matrix: its sign.

    ``floor`` bounds the least singular value, relative to the greatest, from below; the weights follow from it.
    """
    size = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.zeros_like(a)
    x, low = a / norm, floor
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + d)
        alpha = root + np.sqrt(8 - 4 * d + 8 * (2 - low * low) / (low * low * root)) / 2
        beta = (alpha - 1) ** 2 / 4
        gamma = alpha + beta - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(gamma) * x, np.eye(size)]))
        step = (beta / gamma) * x + (alpha - beta / gamma) / np.sqrt(gamma) * (q[:size] @ q[size:].T)
        step = (step + step.T) / 2
        moved = np.linalg.norm(step - x)
        x = step
        low = min(1.0, low * (alpha + beta * low * low) / (1 + gamma * low * low))
        if abs(1 - low) < 4 * EPS and moved < EPS ** (1 / 3):
            break
    return x


def projector(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Spectral projector on the eigenvalues above a shift and its rank; None if all are equal to working precision."""
    size = len(a)
    middle = np.trace(a) / size  # between the least and the greatest eigenvalue
    spread = np.linalg.norm(a - middle * np.eye(size))
    if spread <= 8 * size * EPS * max(np.linalg.norm(a), abs(middle)):
        return None
    for part in (0.0, 0.0113, -0.0137, 0.0419, -0.0531, 0.0971, -0.1153):  # a shift that meets an eigenvalue is moved
        sign = polar(a - (middle + part * spread / np.sqrt(size)) * np.eye(size))
        found = (sign + np.eye(size)) / 2
        rank = int(round(np.trace(found)))
        if 0 < rank < size and np.linalg.norm(found @ found - found) < 1e-8 * np.sqrt(size):
            return found, rank
    return None


def halves(a: np.ndarray, found: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the projector's range and of its complement, by subspace iteration from its heaviest columns."""
    start = np.random.default_rng(rank).standard_normal((len(a), rank))
    best, gap = None, np.inf
    for _ in range(4):
        start, _ = np.linalg.qr(found @ start)
        whole, _ = np.linalg.qr(start, mode="complete")
        above, below = whole[:, :rank], whole[:, rank:]
        left = np.linalg.norm(above.T @ a @ below)
        if left < gap:
            best, gap = (above, below), left
        if gap <= 4 * EPS * np.linalg.norm(a):
            break
    return best


def spectral_components(a: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` greatest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    size = len(a)
    wanted = size if wanted is None else min(wanted, size)
    parts, done = [(np.eye(size), (a + a.T) / 2)], []
    while parts and len(done) < wanted:
        basis, block = parts.pop()  # the part with the greatest eigenvalues left
        split = projector(block) if len(block) > 1 else None
        if split is None:
            done += [(block[i, i], basis[:, i]) for i in range(len(block))]
            continue
        for half in reversed(halves(block, *split)):
            inner = half.T @ block @ half
            parts.append((basis @ half, (inner + inner.T) / 2))
    values = np.array([value for value, _ in done[:wanted]])
    vectors = np.array([vector for _, vector in done[:wanted]]).reshape(len(values), size)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[order] / np.linalg.norm(vectors[order], axis=1, keepdims=True)


# ---- passes over the vectors ----------------------------------------------------


def whole_numbers(column: pa.Array, dimensions: int) -> np.ndarray:
    """(rows, dimensions) of floor(scale * c) + offset."""
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * entries).astype(np.int64).reshape(-1, dimensions) + OFFSET


def usable(vectors: DataFrame, vector: str, keep: list[str]) -> tuple[DataFrame, int]:
    """_k0, ... (the columns of ``keep``) and _v (the vector as doubles) of the rows that take part, and their dimensions."""
    most = float(2**53 - OFFSET) / SCALE
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < most))
    rows = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(good)
    rows = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(vector).cast("array<double>").alias("_v"))
    sizes = rows.groupBy(F.size("_v").alias("d")).count()
    best = sizes.agg(F.max(F.struct("count", "d")).alias("best")).first().best
    dimensions = best.d if best else 0
    if dimensions > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dimensions} dimensions; at most {MOST_DIMENSIONS}")
    return rows.filter(F.size("_v") == dimensions), dimensions


def sums(rows: DataFrame, dimensions: int) -> tuple[int, np.ndarray]:
    """Rows, and the exact sum of every dimension."""

    def add(batches):
        total, count = np.zeros(dimensions, object), 0
        for batch in batches:
            x = whole_numbers(batch.column("_v"), dimensions)
            count += len(x)
            total += (x >> 32).sum(0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, dimensions), pa.int32()), pa.array([count, *map(int, total)], pa.decimal128(38, 0))], names=["i", "s"]
        )

    added = rows.select("_v").mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    found = {row.i: int(row.s) for row in added.collect()}  # one row a dimension
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(dimensions)], object)


class Centre:
    """The mean as a fraction: vectors are moved by it exactly, then divided."""

    def __init__(self, n: int, total: np.ndarray):
        self.n, self.total = n, total
        self.short = all(abs(int(s)) < 2**62 for s in total)

    def moved(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        if self.short and int(np.abs(x).max(initial=0)) * self.n < 2**62:
            return x * self.n - self.total.astype(np.int64)
        return x.astype(object) * self.n - self.total

    def deviations(self, moved: np.ndarray) -> list[int | None]:
        """Sums of squares, exact; None where no long holds them."""
        rough = (moved.astype(np.float64) ** 2).sum(1)
        if moved.dtype != object and rough.max(initial=0) < 2**62:
            return (moved * moved).sum(1).tolist()
        exact = (moved.astype(object) ** 2).sum(1)
        return [int(v) if v < 2**63 else None for v in exact]

    def centred(self, moved: np.ndarray) -> np.ndarray:
        return moved.astype(np.float64) / self.n


def covariance(rows: DataFrame, centre: Centre, dimensions: int) -> np.ndarray:
    """Covariance with divisor n; a task hands on one matrix."""

    def add(batches):
        total = np.zeros((dimensions, dimensions))
        for batch in batches:
            x = centre.centred(centre.moved(whole_numbers(batch.column("_v"), dimensions)))
            total += x.T @ x
        for i in range(dimensions):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(dimensions - i, i, np.int32)), pa.array(np.arange(i, dimensions, dtype=np.int32)), pa.array(total[i, i:])],
                names=["i", "j", "s"],
            )

    added = rows.select("_v").mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((dimensions, dimensions))
    i, j, s = (added.column(c).to_numpy() for c in ("i", "j", "s"))
    out[i, j] = out[j, i] = s / centre.n
    return out


def project(rows: DataFrame, centre: Centre, dimensions: int, axes: np.ndarray, keep: int) -> DataFrame:
    """_k0, ..., deviation and white (an array): centred vectors along the scaled axes."""
    schema = T.StructType(
        [f for f in rows.schema if f.name != "_v"]
        + [T.StructField("deviation", T.LongType()), T.StructField("white", T.ArrayType(T.DoubleType()))]
    )
    names = schema.names

    def work(batches):
        for batch in batches:
            moved = centre.moved(whole_numbers(batch.column("_v"), dimensions))
            white = centre.centred(moved) @ axes.T
            offsets = np.arange(len(white) + 1, dtype=np.int32) * len(axes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f"_k{i}") for i in range(keep)]
                + [pa.array(centre.deviations(moved), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel()))],
                names=names,
            )

    return rows.mapInArrow(work, schema)


def identity_error(projected: DataFrame, count: int) -> float | None:
    """Greatest entry of the whitened vectors' covariance less the identity."""
    if not count:
        return None
    white = projected.select(*[F.col("white")[i].alias(f"w{i}") for i in range(count)])
    entries = [
        F.abs(F.covar_pop(f"w{i}", f"w{j}") - F.lit(float(i == j))) for i in range(count) for j in range(i, count)
    ]
    found = white.agg(*[e.alias(f"e{i}") for i, e in enumerate(entries)]).first()
    return max(found)


def whiten(vectors: DataFrame, keep: list[str], wanted: int | None = 8, vector: str = "embedding") -> DataFrame:
    """Columns of ``keep``, then component (from 1), n, deviation, whitened, explained and identity_error: a row for each vector and
    component. ``wanted`` None takes all components."""
    rows, dimensions = usable(vectors, vector, keep)
    n, total = sums(rows, dimensions) if dimensions else (0, np.zeros(0, object))
    tail = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        head = [T.StructField(c, vectors.schema[c].dataType) for c in keep]
        return vectors.sparkSession.createDataFrame([], T.StructType([*head, *T._parse_datatype_string(tail).fields]))
    centre = Centre(n, total)
    known = covariance(rows, centre, dimensions)
    trace = float(np.trace(known))
    values, axes = spectral_components(known, wanted)
    real = values > NO_VARIANCE * trace
    scaled = axes * np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)[:, None]
    projected = project(rows, centre, dimensions, scaled, len(keep))
    error = identity_error(projected, int(real.sum()))
    explained = F.array(*[F.lit(float(v) / trace if trace > 0 else 0.0) for v in values])
    opened = projected.select("*", F.posexplode("white").alias("at", "whitened"))
    return opened.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
