import pandas as pd
import pytest

from pairloom.operators import dictionary
from pairloom.plans import translation
from pairloom.session import scratch_path


def test_later_entry_wins_and_missing_term_is_null(spark):
    entries = spark.createDataFrame([("t", "x", 0), ("t", "y", 1), ("u", "z", 0)], "term string, mapped string, seq int")
    df = spark.createDataFrame([("t", "u"), ("u", "v"), (None, "t")], "anchor string, target string")
    got = dictionary.substitute(df, dictionary.last_entries(entries, "seq"), ["anchor", "target"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("y", "z"), ("z", None), (None, "y")], key=str)


def test_one_term_fills_the_table(spark):
    df = spark.range(5000).selectExpr("'hot' AS anchor", "cast(id AS string) AS target")
    entries = dictionary.distinct_terms(df, ["anchor", "target"]).selectExpr("term", "concat('x', term) AS mapped")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = dictionary.substitute(df, entries, ["anchor", "target"])
        assert got.count() == 5000
        assert got.filter("anchor <> 'xhot' OR target NOT LIKE 'x%'").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_build_resumes(spark, tmp_path):
    calls = tmp_path / "calls"

    def mapper(terms: pd.Series) -> pd.Series:
        with open(calls, "a") as file:
            file.write(f"{len(terms)}\n")
        return terms.str.upper()

    def broken(terms: pd.Series) -> pd.Series:
        if "t7" in set(terms):
            raise RuntimeError("the service is gone")
        return mapper(terms)

    rows = [(t,) for t in ("a,b", 'say "c"', "d ", "two\nlines", "done", *[f"t{i}" for i in range(20)])]
    terms = spark.createDataFrame(rows, "term string")
    done = spark.createDataFrame([("done", "KEPT")], "term string, mapped string")
    path = scratch_path(spark, "t")
    with pytest.raises(Exception, match="service is gone"):
        translation.build_dictionary(terms, broken, path, done, size=3, commits=5)
    kept = translation.stored_entries(spark, path).count()
    calls.unlink(missing_ok=True)
    built = translation.build_dictionary(terms, mapper, path, done, size=3, commits=5)
    got = {row.term: row.mapped for row in built.collect()}
    assert got == {t: "KEPT" if t == "done" else t.upper() for (t,) in rows}
    sizes = [int(line) for line in calls.read_text().split()]
    assert max(sizes) <= 3 and sum(sizes) == 24 - kept
    assert translation.build_dictionary(terms, broken, path, done, size=3).count() == 25


def test_union_with_translated_rows(spark):
    left = spark.createDataFrame([("1", "a")], "id string, anchor string")
    right = spark.createDataFrame([("b", "1", "zh")], "anchor string, id string, lang string")
    rows = dictionary.with_translated(left, right).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([("1", "a", None), ("1", "b", "zh")], key=str)


def test_translated_dimension(spark):
    classes = spark.createDataFrame([("H01", "power"), ("H02", "power"), ("H03", None)], "context string, description string")
    got = translation.translated_dimension(classes, "description", lambda s: s + "!")
    assert {(row.context, row.description) for row in got.collect()} == {
        ("H01", "power!"),
        ("H02", "power!"),
        ("H03", None),
    }
