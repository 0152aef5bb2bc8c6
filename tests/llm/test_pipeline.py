"""The pipeline against its stages done by hand, and on odd rows."""

from collections import Counter

import corpus_pipeline
import pytest

import __spark_entry__ as spark_entry
from pairloom.llm import queries, toxicity
from pairloom.session import written
from tests.llm.test_repeats import brute_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string"


def odd_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "0.5D AS score", "'x' AS size")
    more = [
        (None, "a text without an id", "en", "src1", 20, 0.1, "x"), (9001, None, "en", "src1", None, None, None),
        (9002, "", None, None, 0, 0.1, "x"), (9003, "word " * 30_000, "en", "src2", 150_000, 0.1, "x"),
        (9004, "plain words stand here only once", "en", "src3", 32, 0.1, "x"),
        (9005, "you are an idiot and a moron", "en", "src3", 28, 0.1, "x"),
    ]
    return docs.unionByName(spark.createDataFrame([*more, more[4], more[1]], SCHEMA))


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = written(odd_documents(spark, sf_dir), "odd")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), name))
    return out


def test_order_and_columns(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxic_documents", "near_copies", "repeated_passages", "source_mixing", "token_coding",
    ]
    for frame in steps[1:-1]:
        assert frame.columns == steps[0].columns
    assert steps[-1].columns == [*steps[0].columns, "n_tokens", "ids", "decoded_sha256"]


def test_toxic_documents_go(steps, spark, sf_dir):
    lexicon = toxicity.learn(steps[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(steps[0], lexicon, ["doc_id"]).collect()
    want = Counter(r.doc_id for r in scored if not r.predicted)
    assert Counter(r.doc_id for r in steps[1].collect()) == want
    assert 9005 not in want and 9004 in want and None in want


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    groups = brute_groups(rows)
    kept = Counter(r.doc_id for r in steps[2].collect() if (r.text or "").strip())
    assert kept == Counter({key for key, size, least in groups if size and (key == least or key is None)})
    empty = lambda frame: sum(not (r.text or "").strip() for r in frame.collect())
    assert empty(steps[2]) == empty(steps[1])


def test_passages_and_mix(steps):
    before = {r.doc_id: r for r in steps[2].collect()}
    after = {r.doc_id: r for r in steps[3].collect()}
    assert set(before) == set(after)
    for key, row in after.items():
        if row.text != before[key].text:
            assert row.n_chars == len(row.text) < len(before[key].text)
        else:
            assert row == before[key]
    mixed = Counter(r.doc_id for r in steps[4].collect())
    assert set(mixed) <= set(after) and max(v for k, v in mixed.items() if k != 9001) <= 2
    assert {(r.doc_id, r.text) for r in steps[4].collect()} <= {(k, r.text) for k, r in after.items()}


def test_registered(spark, sf_dir):
    found = spark_entry.queries()
    assert found["pipeline"] is corpus_pipeline.run
    assert set(queries.QUERIES) <= set(found)
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert rows.count() > 0
