import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.operators.rank_cuts import assign_folds, assign_repeated_split, assign_split


def frame(spark, labels):
    return spark.createDataFrame([(str(i), label) for i, label in enumerate(labels)], "id string, label string")


def assert_folds(rows, k):
    sizes = Counter(row.fold for row in rows)
    assert max(sizes.get(f, 0) for f in range(k)) - min(sizes.get(f, 0) for f in range(k)) <= 1
    for label in {row.label for row in rows}:
        inside = Counter(row.fold for row in rows if row.label == label)
        assert max(inside.get(f, 0) for f in range(k)) - min(inside.get(f, 0) for f in range(k)) <= 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=40), st.integers(2, 5))
def test_fold_sizes(spark, labels, k):
    rows = assign_folds(frame(spark, labels), "label", k).collect()
    assert sorted(int(row.id) for row in rows) == list(range(len(labels)))
    assert_folds(rows, k)


def test_group_folds_of_eight_rows(spark):
    rows = assign_folds(frame(spark, "aaaabbbb"), "label", 2).collect()
    assert Counter((row.label, row.fold) for row in rows) == {(g, f): 2 for g in "ab" for f in (0, 1)}


def test_group_split_of_eight_rows(spark):
    rows = assign_split(frame(spark, "aaaabbbb"), "label", 0.5).collect()
    assert Counter((row.label, row.side) for row in rows) == {(g, s): 2 for g in "ab" for s in ("train", "test")}


def test_one_label_fills_most_rows(spark):
    """A hot stratum, a rare one, and rows without a label."""
    labels = ["hot"] * 3000 + ["rare"] * 7 + [None] * 10
    rows = assign_folds(frame(spark, labels), "label", 4).collect()
    assert len(rows) == 3017
    assert_folds(rows, 4)


@pytest.mark.parametrize("labels", ["a" * 11 + "b" * 4 + "c" * 7, "a" * 97 + "b" * 3])
def test_split_quota(spark, labels):
    rows = assign_split(frame(spark, labels), "label", 0.2).collect()
    tested = Counter(row.label for row in rows if row.side == "test")
    total = math.ceil(0.2 * len(labels))
    assert sum(tested.values()) == total
    for label, n in Counter(labels).items():
        assert abs(tested[label] - n * total / len(labels)) < 1


def test_repeated_splits_differ(spark):
    df = frame(spark, "ab" * 50)
    rows = assign_repeated_split(df, "label", 3).collect()
    assert len(rows) == 300
    chosen = [frozenset(r.id for r in rows if r.split == s and r.side == "test") for s in range(3)]
    assert [len(c) for c in chosen] == [20, 20, 20] and len(set(chosen)) == 3


def test_split_within_groups(spark):
    df = frame(spark, "ab" * 60).withColumn("fold", (F.col("id").cast("int") % 3).cast("int"))
    rows = assign_split(df, "label", 0.25, groups=("fold",)).collect()
    assert Counter(row.fold for row in rows if row.side == "test") == {0: 10, 1: 10, 2: 10}


def test_same_result_without_small_tables(spark, distributed):
    df = frame(spark, "aab" * 30)
    spread = {(row.id, row.fold) for row in assign_folds(df, "label", 4).collect()}
    assert len(spread) == 90
    assert_folds(assign_folds(df, "label", 4).collect(), 4)


def test_small_and_distributed_agree(spark, monkeypatch):
    from pairloom import session

    df = frame(spark, "aaabbc" * 20)
    local = sorted(assign_split(df, "label", 0.3).collect())
    monkeypatch.setattr(session, "SMALL_SIDE_ROWS", 0)
    assert sorted(assign_split(df, "label", 0.3).collect()) == local


def test_empty_input(spark):
    assert assign_folds(frame(spark, ["a"]).limit(0), "label", 4).count() == 0


def test_fold_count_is_checked(spark):
    with pytest.raises(ValueError):
        assign_folds(frame(spark, "ab"), "label", 1)
