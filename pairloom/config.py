"""Run settings of the jobs and the checks between them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RunConfig:
    """Settings of one version; the defaults are fixed values. ``balance_by`` and what follows serve an external trainer."""

    version: str = "base"
    n_folds: int = 4
    folds: tuple[int, ...] | None = None
    seed: int = 42
    use_class_text: bool = True
    use_mentions: bool = False
    sample_rows: int | None = None
    balance_by: str | None = "context"
    batch_size: int = 32
    loss: str = "MSE"
    target_size: int = 1
    patience: int = 5

    def __post_init__(self):
        if self.target_size not in (1, 5):
            raise ValueError("target_size must be 1 (regression) or 5 (classes)")
        if (self.target_size == 5) != (self.loss == "CE"):
            raise ValueError("cross entropy goes with five classes, and only with them")
        if self.balance_by not in (None, "label", "context"):
            raise ValueError("balance_by must be None, 'label' or 'context'")
        if self.folds is not None and not set(self.folds) <= set(range(self.n_folds)):
            raise ValueError("folds must lie between 0 and n_folds - 1")

    @property
    def run_folds(self) -> tuple[int, ...]:
        return tuple(range(self.n_folds)) if self.folds is None else self.folds

    @classmethod
    def debug(cls, **changes) -> "RunConfig":
        """A short run: two folds over a sample of 200 rows."""
        return cls(**{"n_folds": 2, "sample_rows": 200, **changes})


# Grids and defaults of both meta-learners.
@dataclass(frozen=True)
class ElasticNetGrid:
    alpha: tuple[float, ...] = (0.0, 0.2, 0.4, 0.5, 0.75)
    fit_intercept: tuple[bool, ...] = (True, False)
    l1_ratio: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    max_iter: int = 5000

    @classmethod
    def debug(cls) -> "ElasticNetGrid":
        return cls(alpha=(0.5, 1.0), fit_intercept=(True,), l1_ratio=(0.0, 1.0), max_iter=10)


@dataclass(frozen=True)
class ForestGrid:
    n_estimators: tuple[int, ...] = (150,)
    max_depth: tuple[int, ...] = (4, 5, 6, 7, 8)
    min_samples_split: tuple[int, ...] = (2, 4, 6)

    @classmethod
    def debug(cls) -> "ForestGrid":
        return cls(n_estimators=(10,), max_depth=(2,), min_samples_split=(2,))


@dataclass(frozen=True)
class StackConfig:
    versions: tuple[str, ...]
    learners: tuple[str, ...] = ("rf", "en")
    n_splits: int = 5
    test_size: float = 0.2
    seed: int = 39  # fixed value
    encode_fold: bool | str | dict = False  # True or 'digits', 'onehot', or own values for each fold
    elastic_net: ElasticNetGrid = field(default_factory=ElasticNetGrid)
    forest: ForestGrid = field(default_factory=ForestGrid)
