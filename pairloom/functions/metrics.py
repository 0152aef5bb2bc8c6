"""Losses and scores as aggregate expressions, for use in one ``groupBy().agg()``.

All of them keep a fixed number of partial sums per group, so a group of any size is combined
on the map side first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions.arrays import log_softmax_at

Metric = Callable[[Column, Column], Column]

# Lower bound of a logarithm and the stabiliser of the concordance losses.
LOG_FLOOR = -100.0
CCC_EPS = 1e-6


def _paired(y: Column, p: Column) -> tuple[Column, Column]:
    both = y.isNotNull() & p.isNotNull()
    return F.when(both, y.cast("double")), F.when(both, p.cast("double"))


def pearson(y: Column, p: Column) -> Column:
    """Null for constant input and for a single row."""
    y, p = _paired(y, p)
    return F.try_divide(F.covar_pop(y, p), F.stddev_pop(y) * F.stddev_pop(p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def _floored_log(q: Column) -> Column:
    """Null stays null; zero has the floor."""
    return F.when(q.isNotNull(), F.greatest(F.coalesce(F.ln(q), F.lit(LOG_FLOOR)), F.lit(LOG_FLOOR)))


def bce(y: Column, p: Column) -> Column:
    """Rows without a label or a prediction take no part; a prediction that is no probability is an error."""
    outside = F.raise_error(F.lit("a prediction lies outside [0, 1]")).cast("double")
    p = F.when((p < 0) | (p > 1), outside).otherwise(p)
    return F.avg(-(y * _floored_log(p) + (1 - y) * _floored_log(1 - p)))


def bce_with_logits(y: Column, x: Column) -> Column:
    return F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x))))


def cross_entropy(label: Column, logits: Column) -> Column:
    return -F.avg(log_softmax_at(logits, label))


def pcc_loss(y: Column, p: Column) -> Column:
    y, p = _paired(y, p)
    return 1 - F.try_divide(F.covar_samp(y, p), F.stddev_samp(y) * F.stddev_samp(p))


def _ccc_denominator(y: Column, p: Column) -> Column:
    gap = F.avg(p) - F.avg(y)
    return F.var_samp(p) + F.var_samp(y) + gap * gap + F.lit(CCC_EPS)


def ccc_loss(y: Column, p: Column) -> Column:
    y, p = _paired(y, p)
    return 1 - 2 * F.covar_samp(y, p) / _ccc_denominator(y, p)


def ccc_sum_loss(y: Column, p: Column) -> Column:
    """The numerator is a sum over rows and grows with them."""
    y, p = _paired(y, p)
    return -2 * F.covar_samp(y, p) * (F.count(y) - 1) / _ccc_denominator(y, p)


def neg_mae(y: Column, p: Column) -> Column:
    return -F.avg(F.abs(p - y))


def neg_mse(y: Column, p: Column) -> Column:
    return -mse(y, p)


def r2(y: Column, p: Column) -> Column:
    y, p = _paired(y, p)
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    return F.when(sst == 0, F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - F.try_divide(sse, sst))


LOSSES: dict[str, Metric] = {
    "MSE": mse,
    "BCE": bce,
    "BCEWithLogits": bce_with_logits,
    "CE": cross_entropy,
    "PCC": pcc_loss,
    "CCC1": ccc_loss,
    "CCC2": ccc_sum_loss,
}

SCORERS: dict[str, Metric] = {
    "neg_mean_absolute_error": neg_mae,
    "neg_mean_squared_error": neg_mse,
    "r2": r2,
    "corr_scorer": pearson,
}


def loss(name: str) -> Metric:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}, choose one of {sorted(LOSSES)}")
    return LOSSES[name]


def scorer(name: str) -> Metric:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}, choose one of {sorted(SCORERS)}")
    return SCORERS[name]
