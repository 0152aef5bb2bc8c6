"""The fold as numbers for a meta-learner: a fitted stage that is saved with the model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORED = "fold int, name string, place int, value double"


@dataclass(frozen=True)
class FoldEncoder:
    """Column names, and their values for each fold that was there when it was fitted. A fold without values is an error."""

    names: tuple[str, ...]
    table: dict[int, tuple[float, ...]]

    def values(self, fold: int) -> tuple[float, ...]:
        if fold not in self.table:
            raise ValueError(f"fold {fold} was not there when the encoder was fitted")
        return self.table[fold]

    def encoded(self, df: DataFrame, fold: str = "fold") -> DataFrame:
        """``df`` with one column for each name."""
        unknown = F.raise_error(F.concat(F.lit("the encoder has no values for fold "), F.coalesce(F.col(fold).cast("string"), F.lit("null"))))
        return df.withColumns({name: self._column(F.col(fold), place, unknown) for place, name in enumerate(self.names)})

    def _column(self, fold: Column, place: int, unknown: Column) -> Column:
        found = None
        for number, values in self.table.items():
            found = F.when(fold == number, F.lit(float(values[place]))) if found is None else found.when(fold == number, F.lit(float(values[place])))
        return found.otherwise(unknown.cast("double")) if found is not None else unknown.cast("double")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(fold, name, place, float(values[place])) for fold, values in self.table.items() for place, name in enumerate(self.names)]
        spark.createDataFrame(rows, STORED).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FoldEncoder":
        rows = sorted(spark.read.schema(STORED).parquet(path).collect(), key=lambda row: (row.fold, row.place))
        names = tuple(dict.fromkeys(row.name for row in rows))
        folds = dict.fromkeys(row.fold for row in rows)
        return cls(names, {fold: tuple(row.value for row in rows if row.fold == fold) for fold in folds})


def digits(folds: list[int]) -> FoldEncoder:
    """Binary digits of the fold counted from 1, the greatest first; the largest fold gives their count."""
    width = (max(folds) + 1).bit_length()
    table = {fold: tuple(float(fold + 1 >> bit & 1) for bit in range(width - 1, -1, -1)) for fold in folds}
    return FoldEncoder(tuple(f"fold_digit_{i}" for i in range(width)), table)


def one_hot(folds: list[int]) -> FoldEncoder:
    """A column for each fold."""
    return FoldEncoder(tuple(f"fold_is_{fold}" for fold in folds), {fold: tuple(float(fold == other) for other in folds) for fold in folds})


KINDS = {"digits": digits, "onehot": one_hot}


def fit_encoder(choice: bool | str | dict, folds: list[int]) -> FoldEncoder | None:
    """The encoder of a setting: a kind by name (True: digits), or a user's own values for each fold."""
    if not choice:
        return None
    if isinstance(choice, dict):
        widths = {len(values) for values in choice.values()}
        missing = sorted(set(folds) - set(choice))
        if missing or len(widths) != 1:
            raise ValueError(f"own fold values need the same count for every fold; missing folds: {missing}")
        return FoldEncoder(tuple(f"fold_value_{i}" for i in range(widths.pop())), {fold: tuple(map(float, choice[fold])) for fold in sorted(choice)})
    kind = "digits" if choice is True else choice
    if kind not in KINDS:
        raise ValueError(f"unknown fold encoder {kind!r}, choose one of {sorted(KINDS)}")
    return KINDS[kind](folds)
