"""Expressions over score arrays and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five similarity levels in class order.
LEVELS = (0.0, 0.25, 0.5, 0.75, 1.0)


def class_of_score(score) -> Column:
    """Class number of a similarity level; any other score has none."""
    score = F.col(score) if isinstance(score, str) else score
    chain = F
    for k, level in enumerate(LEVELS):
        chain = chain.when(score == F.lit(level), F.lit(k))
    return chain


def one_hot(label: Column, size: int = len(LEVELS)) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (k == label).cast("int"))


def arg_max(values) -> Column:
    """Zero-based place of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; a lambda would evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_softmax_at(logits: Column, label: Column) -> Column:
    """Log probability of one class, with the largest logit taken out first."""

    def of_top(top):
        shifted = F.transform(logits, lambda x: F.exp(x - top))
        return F.element_at(logits, label + 1) - top - F.log(total(shifted))

    return bind(F.array_max(logits), of_top)


def layer_norm(vector: Column, eps: float = 1e-5) -> Column:
    """Centre and scale one vector by its own mean and population variance."""

    def centred(values):
        return bind(total(values) / F.size(values), lambda mean: F.transform(values, lambda x: x - mean))

    def scaled(values):
        var = total(F.transform(values, lambda x: x * x)) / F.size(values)
        return bind(F.sqrt(var + F.lit(eps)), lambda sd: F.transform(values, lambda x: x / sd))

    return bind(vector.cast("array<double>"), lambda v: bind(centred(v), scaled))


def pad(ids: Column, length: Column, filler: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(filler), (length - F.size(ids)).cast("int")))


def attention_mask(ids: Column, length: Column) -> Column:
    return F.concat(
        F.array_repeat(F.lit(1), F.size(ids)),
        F.array_repeat(F.lit(0), (length - F.size(ids)).cast("int")),
    )


def binary_digits(index: Column, width: int) -> list[Column]:
    """Digits of a category number, the most significant one first."""
    return [F.shiftright(index, b).bitwiseAND(F.lit(1)).cast("int") for b in range(width - 1, -1, -1)]
