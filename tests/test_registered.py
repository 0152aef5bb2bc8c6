"""Every registered query against its SQL, and the contract of the entry module."""

from functools import lru_cache

import pytest

import __spark_entry__ as spark_entry
import check_queries
from pairloom.queries import common


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    """Find the folds and store the predictions once for all queries of this module."""
    patch = pytest.MonkeyPatch()
    patch.setattr(common, "folded", lru_cache(common.folded))
    patch.setattr(common, "stored_oof", lru_cache(common.stored_oof))
    yield
    patch.undo()


@pytest.fixture(scope="module")
def engine(sf_dir):
    return check_queries.sql_engine(sf_dir)


def test_every_sql_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(spark_entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, engine, name):
    sql = spark_entry.oracle_sql()[name]
    result = spark_entry.queries()[name](spark, sf_dir)
    assert check_queries.compare(result.toPandas(), engine.execute(sql).df()) == ""
    assert check_queries.type_gaps(result.dtypes, engine, sql) == ""


def test_entry(spark):
    rows = spark_entry.entry(spark).collect()
    assert [row.fold for row in rows] == [0, 1, 2, 3]
    assert sum(row.n for row in rows) == 1500
    assert all(row.pearson > 0.5 for row in rows)
