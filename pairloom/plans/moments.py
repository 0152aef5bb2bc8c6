"""Elastic-net grid search from one scan of moments.

A linear fit, its squared error, R2 and correlation depend on the rows only through counts, means
and covariances. One aggregation by (fold, split, side) therefore replaces one Spark ML fit
for each fold, split and setting; what remains are problems as large as the number of prediction
sets, solved in a task beside the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement, product

import numpy as np
import pandas as pd
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.config import ElasticNetGrid
from pairloom.functions.arrays import dot
from pairloom.session import small_side

ALL_ROWS = -1
ROWS_TOGETHER = 4096
TOLERANCE = 1e-13

_FITS = (
    "fold int, split int, setting int, alpha double, fit_intercept boolean, l1_ratio double, "
    "coef array<double>, intercept double, sample string, neg_mean_squared_error double, r2 double, "
    "corr_scorer double"
)
PARAMS = ["alpha", "fit_intercept", "l1_ratio"]


def moment_columns(features: list[str], label: str) -> dict[str, Column]:
    """Named aggregates: rows, means, and variances and covariances around them.

    Centred aggregates keep their digits however far the values lie from zero.
    """
    y = F.col(label)
    found = {"n": F.count("*").cast("double"), "y": F.avg(y), "yy": F.var_pop(y)}
    found |= {f"x_{f}": F.avg(F.col(f)) for f in features}
    found |= {f"xy_{f}": F.covar_pop(F.col(f), y) for f in features}
    found |= {f"xx_{f}_{g}": F.covar_pop(F.col(f), F.col(g)) for f, g in combinations_with_replacement(features, 2)}
    return found


def moments(df: DataFrame, features: list[str], label: str, by: list[str]) -> DataFrame:
    """One row for each group with its named aggregates; a missing value is an error, as fits need complete rows."""
    missing = F.raise_error(F.lit("a prediction or a label is missing")).cast("double")
    whole = df.withColumns({c: F.coalesce(F.col(c), missing) for c in [*features, label]})
    return whole.groupBy(*by).agg(*[value.alias(name) for name, value in moment_columns(features, label).items()])


def split_moments(rows: DataFrame, features: list[str], label: str, n_splits: int, bits: str = "test_splits") -> DataFrame:
    """(fold, split, train, test): the moments of both sides as arrays, in the order of ``moment_columns``.

    ``rows`` hold fold, features, label and the bits of their test sides, each once. A task hands on the moments of its rows, for each
    fold once for all rows and once for the test rows of each split. They are merged by fold, and the train side is all rows
    less the test rows. A missing value is an error.
    """
    columns = [*features, label]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, _Moments] = {}
        for batch in batches:
            values, tests = batch[columns].to_numpy(float), batch[bits].to_numpy()
            if np.isnan(values).any():
                raise ValueError("a prediction or a label is missing")
            for fold, places in batch.groupby("fold").indices.items():
                own, test = values[places], tests[places]
                for split in range(ALL_ROWS, n_splits):
                    part = own if split == ALL_ROWS else own[(test >> split) & 1 == 1]
                    found = _Moments.of(part[:, :-1], part[:, -1])
                    key = (int(fold), split)
                    held[key] = held[key].merged(found) if key in held else found
        if held:
            yield pd.DataFrame([(*key, found.packed()) for key, found in held.items()], columns=["fold", "split", "m"])

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        found = {
            split: reduce(_Moments.merged, [_Moments.unpacked(np.asarray(m), len(features)) for m in own["m"]])
            for split, own in parts.groupby("split")
        }
        every = found.pop(ALL_ROWS)
        made = [(key[0], split, every.without(test).packed(), test.packed()) for split, test in found.items()]
        return pd.DataFrame(made, columns=["fold", "split", "train", "test"])

    partial = rows.select("fold", bits, *[F.col(c).cast("double").alias(c) for c in columns])
    partial = partial.mapInPandas(gather, "fold int, split int, m array<double>")
    return partial.groupBy("fold").applyInPandas(merge, "fold int, split int, train array<double>, test array<double>")


def by_side(packed: DataFrame, features: list[str], label: str) -> DataFrame:
    """fold, split, side and the named moments, a row for each side."""
    names = list(moment_columns(features, label))
    sides = F.inline(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("m")) for side in ("train", "test")]))
    rows = packed.select("fold", "split", sides)
    return rows.select("fold", "split", "side", *[F.col("m")[i].alias(name) for i, name in enumerate(names)])


class _Moments:
    """Rows, means and centred second moments of one side."""

    def __init__(self, n: float, y: float, yy: float, x: np.ndarray, xy: np.ndarray, xx: np.ndarray):
        self.n, self.y, self.yy, self.x, self.xy, self.xx = n, y, yy, x, xy, xx

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> "_Moments":
        p = x.shape[1]
        if not len(y):
            return cls(0.0, 0.0, 0.0, np.zeros(p), np.zeros(p), np.zeros((p, p)))
        mx, my = x.mean(axis=0), float(y.mean())
        dx, dy = x - mx, y - my
        return cls(float(len(y)), my, float(dy @ dy) / len(y), mx, dx.T @ dy / len(y), dx.T @ dx / len(y))

    def packed(self) -> list[float]:
        return [self.n, self.y, self.yy, *self.x, *self.xy, *self.xx[np.triu_indices(len(self.x))]]

    @classmethod
    def unpacked(cls, packed: np.ndarray, p: int) -> "_Moments":
        xx = np.zeros((p, p))
        xx[np.triu_indices(p)] = packed[3 + 2 * p :]
        xx = xx + xx.T - np.diag(xx.diagonal())
        return cls(*packed[:3], packed[3 : 3 + p], packed[3 + p : 3 + 2 * p], xx)

    def merged(self, other: "_Moments") -> "_Moments":
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        a, b = self.n / n, other.n / n
        dx, dy = other.x - self.x, other.y - self.y
        return _Moments(
            n,
            a * self.y + b * other.y,
            a * self.yy + b * other.yy + a * b * dy * dy,
            a * self.x + b * other.x,
            a * self.xy + b * other.xy + a * b * dx * dy,
            a * self.xx + b * other.xx + a * b * np.outer(dx, dx),
        )

    def without(self, part: "_Moments") -> "_Moments":
        """The other rows, where ``part`` holds some of these."""
        n = self.n - part.n
        if not part.n or not n:
            return self if n else _Moments.of(np.zeros((0, len(self.x))), np.zeros(0))
        a, b = self.n / n, part.n / n
        y, x = a * self.y - b * part.y, a * self.x - b * part.x
        dx, dy = part.x - x, part.y - y
        share = part.n / self.n
        return _Moments(
            n,
            y,
            max(a * self.yy - b * part.yy - share * dy * dy, 0.0),
            x,
            a * self.xy - b * part.xy - share * dx * dy,
            a * self.xx - b * part.xx - share * np.outer(dx, dx),
        )

    def problem(self, centred: bool) -> tuple[np.ndarray, np.ndarray]:
        if centred:
            return self.xx, self.xy
        return self.xx + np.outer(self.x, self.x), self.xy + self.x * self.y

    def scores(self, w: np.ndarray, b: float) -> tuple[float, float | None, float | None]:
        cov, var_p = w @ self.xy, w @ self.xx @ w
        gap = self.y - self.x @ w - b
        mse = max(self.yy - 2 * cov + var_p, 0.0) + gap**2
        r2 = 1 - mse / self.yy if self.yy > 0 else None
        corr = cov / np.sqrt(self.yy * var_p) if self.yy > 0 and var_p > 1e-18 else None
        return -mse, r2, corr


def coordinate_descent(
    gram: np.ndarray, xty: np.ndarray, l1: np.ndarray, l2: np.ndarray, max_iter: int
) -> np.ndarray:
    """Minimise ``w'Gw/2 - w'c + l1|w| + l2 w'w/2`` for all settings at once: (settings, features)."""
    w = np.zeros((len(l1), len(xty)))
    plain = (l1 == 0) & (l2 == 0)
    if plain.any():
        w[plain] = np.linalg.lstsq(gram, xty, rcond=None)[0]
    turn = ~plain
    l1, l2 = l1[turn], l2[turn]
    v = w[turn]
    for _ in range(max_iter):
        before = v.copy()
        for j in range(len(xty)):
            rest = xty[j] - v @ gram[:, j] + v[:, j] * gram[j, j]
            scale = gram[j, j] + l2
            shrunk = np.sign(rest) * np.maximum(np.abs(rest) - l1, 0.0)
            v[:, j] = np.divide(shrunk, scale, out=np.zeros_like(shrunk), where=scale > 1e-15)
        if np.abs(v - before).max(initial=0.0) < TOLERANCE:
            break
    w[turn] = v
    return w


def elastic_net_fits(packed: DataFrame, n_features: int, grid: ElasticNetGrid) -> DataFrame:
    """Fit and score every setting of the grid for each (fold, split)."""
    settings = list(product(grid.alpha, grid.fit_intercept, grid.l1_ratio))
    alpha, intercept, ratio = (np.array(column) for column in zip(*settings))

    def fitted(fold: int, split: int, sides: dict[str, _Moments]) -> Iterator[tuple]:
        known = sides["train"]
        weights = np.zeros((len(settings), n_features))
        for centred in (True, False):
            turn = intercept == centred
            if turn.any():
                gram, xty = known.problem(centred)
                l1, l2 = alpha * ratio, alpha * (1 - ratio)
                weights[turn] = coordinate_descent(gram, xty, l1[turn], l2[turn], grid.max_iter)
        for number, (w, setting) in enumerate(zip(weights, settings)):
            b = known.y - known.x @ w if setting[1] else 0.0
            for sample, side in sides.items():
                yield (fold, split, number, *setting, w, b, sample, *side.scores(w, b))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for fold, split, train, test in zip(batch.fold, batch.split, batch.train, batch.test):
                sides = {s: _Moments.unpacked(np.asarray(m), n_features) for s, m in (("train", train), ("test", test))}
                rows += fitted(fold, split, sides)
                if split == 0:  # both sides of any split are all rows
                    every = sides["train"].merged(sides["test"])
                    rows += fitted(fold, ALL_ROWS, {"train": every, "test": every})
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in _FITS.split(", ")])

    return packed.mapInPandas(fit, _FITS)


def absolute_errors(rows: DataFrame, fits: DataFrame, features: list[str], label: str, bits: str = "test_splits") -> DataFrame:
    """Mean absolute error of each fit, the one score that needs the rows again.

    ``rows`` are (fold, bits, features, label), each once. The coefficients of the grid, a table of folds x splits x settings,
    go along with the tasks. A task adds up the errors of its rows for all splits and settings at once and hands on one row
    for each (fold, split, side, setting); those of the train side are those of all rows less those of the test rows.
    """
    trained = fits.filter((F.col("sample") == "train") & (F.col("split") != ALL_ROWS))
    table = trained.select("fold", "split", "setting", "coef", "intercept").toPandas()
    models = {
        fold: (part["split"].to_numpy(), part["setting"].to_numpy(), np.stack(part["coef"]).T, part["intercept"].to_numpy())
        for fold, part in table.groupby("fold")
    }

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            x, y, tests = batch[features].to_numpy(float), batch[label].to_numpy(float), batch[bits].to_numpy()
            for fold, places in batch.groupby("fold").indices.items():
                splits, _, coefs, intercepts = models[fold]
                for first in range(0, len(places), ROWS_TOGETHER):
                    at = places[first : first + ROWS_TOGETHER]
                    errors = np.abs(y[at, None] - (x[at] @ coefs + intercepts))
                    test = (tests[at, None] >> splits) & 1
                    found = np.stack([np.full(len(splits), len(at)), errors.sum(0), test.sum(0), (errors * test).sum(0)])
                    totals[fold] = totals.get(fold, 0) + found
        for fold, (n, error, n_test, error_test) in totals.items():
            splits, settings = models[fold][:2]
            for sample, count, total in (("test", n_test, error_test), ("train", n - n_test, error - error_test)):
                yield pd.DataFrame(
                    {"fold": fold, "split": splits, "sample": sample, "setting": settings, "n": count.astype(int), "error": total}
                )

    schema = "fold int, split int, sample string, setting int, n bigint, error double"
    partial = rows.select("fold", bits, *features, label).mapInPandas(add_up, schema)
    return partial.groupBy("fold", "split", "setting", "sample").agg(
        (-F.sum("error") / F.sum("n")).alias("neg_mean_absolute_error")
    )


def linear_regression(alpha: float, l1_ratio: float, fit_intercept: bool, label_std: float) -> LinearRegression:
    """The same problem for Spark ML, which divides the squared penalty by the label's population
    deviation.

    One such fit is one job over the rows; the sums above give the whole grid in one.
    """
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * label_std
    return LinearRegression(
        featuresCol="features",
        labelCol="score",
        fitIntercept=fit_intercept,
        standardization=False,
        maxIter=5000,
        tol=1e-9,
        regParam=l1 + l2,
        elasticNetParam=l1 / (l1 + l2) if l1 + l2 > 0 else 0.0,
    )


def best_fits(fits: DataFrame) -> DataFrame:
    """The refit of each fold: the setting with the best mean test correlation, fitted on all rows.

    A setting without a correlation in some split, as it predicts a constant there, comes last.
    """
    tested = fits.filter((F.col("sample") == "test") & (F.col("split") != ALL_ROWS))
    known = F.when(~F.isnan("corr_scorer"), F.col("corr_scorer"))
    mean = F.when(F.count(known) == F.count("*"), F.avg(known))
    means = tested.groupBy("fold", "setting").agg(mean.alias("cv_score"))
    best = means.groupBy("fold").agg(
        F.max_by(F.struct("setting", "cv_score"), F.struct("cv_score", -F.col("setting"))).alias("best")
    )
    refits = fits.filter((F.col("sample") == "train") & (F.col("split") == ALL_ROWS))
    return refits.join(
        best.select("fold", F.col("best.setting").alias("setting"), F.col("best.cv_score").alias("cv_score")),
        ["fold", "setting"],
    ).select("fold", "setting", *PARAMS, "cv_score", "coef", "intercept")


def with_linear_prediction(df: DataFrame, best: DataFrame, features: list[str], name: str = "en") -> DataFrame:
    """Predict each row by the fit of its fold."""
    fitted = small_side(best.select(F.col("fold").alias("_fold"), "coef", "intercept"))
    guess = F.col("intercept") + dot(F.array(*features), F.col("coef"))
    joined = df.join(fitted, F.col("fold") == F.col("_fold"), "left")
    return joined.withColumn(name, guess).drop("_fold", "coef", "intercept")
