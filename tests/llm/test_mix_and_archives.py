"""Source mixing and WARC archives."""

import base64
import gzip
import hashlib
import os

import duckdb
import pytest

import check_queries
from pairloom.llm import queries, source_mix, warc_store
from pairloom.session import scratch_path


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    engine = check_queries.sql_engine(sf_dir)
    result = queries.QUERIES[name](spark, sf_dir)
    assert check_queries.compare(result.toPandas(), engine.execute(queries.SQL[name]).df()) == ""
    assert check_queries.type_gaps(result.dtypes, engine, queries.SQL[name]) == ""


DOCS = "doc_id long, text string, source string, size int, copies string"


def mixed_rows():
    rows = [(i, "w " * (1 + i % 9), f"s{i % 5}", 1, "c") for i in range(400)]
    rows += [(None, "a b", None, 1, "c"), (500, None, "s1", 1, "c"), (501, "", None, 1, "c"), (7, "x", "s2", 1, "c")]
    return [*rows, (7, "x", "s2", 1, "c"), (600, "w " * 20_000, "big", 1, "c"), (601, None, "none", 1, "c")]


def test_mix_meets_its_targets(spark):
    docs = spark.createDataFrame(mixed_rows(), DOCS).repartition(5)
    found = source_mix.mix_copies(docs, keep=("doc_id", "source")).toPandas()
    assert len(found) == len(mixed_rows())
    assert (found["copies"] <= 2).all()
    total = found["size"].sum()
    by = found.assign(taken=found["size"] * found["copies"]).groupby("source", dropna=False)
    assert by["target"].first().sum() == pytest.approx(1.5 * total)
    for name in ("s0", "s1", "s2", "s3", "s4"):
        part = by.get_group(name)
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 2 * part["size"].max()
        assert part["target"].iloc[0] <= 2 * part["source_size"].iloc[0]
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == found["copies"].sum()
    again = source_mix.mix_copies(docs.repartition(2), keep=("doc_id", "source")).toPandas()
    rows = lambda f: sorted(map(str, f[["doc_id", "size", "copies"]].fillna(-1).itertuples(index=False)))
    assert rows(again) == rows(found)


def test_mix_equals_sql_on_ties_and_nulls(spark):
    docs = spark.createDataFrame(mixed_rows(), DOCS)
    engine = duckdb.connect()
    engine.register("documents", docs.toPandas())
    found = source_mix.mix_copies(docs)
    found = found.withColumn("taken", found["size"] * found["copies"]).drop("copies")
    assert check_queries.compare(found.toPandas(), engine.execute(queries.MIX_SQL).df()) == ""


def test_mix_of_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert source_mix.mix_copies(docs).count() == 0
    assert source_mix.mix(spark.createDataFrame([(1, None, "a", 1, "c")], DOCS)).count() <= 2


PAGES = [
    (1, "http://a/1", "<p>one</p>"), (5, "http://a/5", "<p>one</p>"), (3, "http://a\r\n/%3", "<p>one</p>"),
    (None, "http://a/n", "<p>one</p>"), (2, None, None), (4, "u", ""), (6, "u", "é" * 20_000), (7, "u", "z"), (7, "u", "z"),
    (None, None, "lonely"), (None, "v", "lonely"),
]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def archive(spark, pages, **settings):
    folder = scratch_path(spark, "warc-test")
    manifest = warc_store.write_archives(pages, folder, **settings).collect()
    place = os.path.join(folder.removeprefix("file://"), "archive")
    return folder, place, {r.file: r for r in manifest}


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, _sha string").repartition(4)
    folder, place, manifest = archive(spark, pages, file_bytes=1500)
    assert len(manifest) > 2
    assert set(os.listdir(place)) >= set(manifest)
    for name, row in manifest.items():
        data = open(os.path.join(place, name), "rb").read()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (row.bytes, row.sha256)
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == row.records + 1
    rows = warc_store.read_archives(spark, folder, payload=True).collect()
    heads = {"<p>one</p>": 5, "": 4, "z": 7}
    want = []
    for page_id, url, html in PAGES:
        head = heads.get(html or "")
        revisit = head is not None and page_id != head
        size = len((html or "").encode())
        body = None if revisit else (html or "").encode()
        want.append((page_id, url, "revisit" if revisit else "response", head if revisit else None, size, sha(html), body))
    got = [(*r[:6], None if r.payload is None else bytes(r.payload)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_same_files_whatever_the_partitions(spark):
    made = [(i, f"u{i}", "page " * (i % 50)) for i in range(300)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    first, again = (archive(spark, pages.repartition(n), file_bytes=4000)[2] for n in (1, 7))
    assert first == again and len(first) > 3


def test_broken_archives_are_told(spark):
    folder, place, manifest = archive(spark, spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"))
    (name,) = manifest
    data = open(os.path.join(place, name), "rb").read()
    open(os.path.join(place, name), "wb").write(data[:-9])
    with pytest.raises(Exception, match="inside a record"):
        warc_store.read_archives(spark, folder).collect()


def test_no_pages(spark):
    folder, _, manifest = archive(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest == {}
    assert warc_store.read_archives(spark, folder).count() == 0


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy")], "page_id long, url string, html string")
    folder, _, _ = archive(spark, pages, least_bytes=3)
    assert {r.record_type for r in warc_store.read_archives(spark, folder).collect()} == {"response"}
