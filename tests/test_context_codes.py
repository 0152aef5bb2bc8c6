import time

from pyspark.sql import functions as F

from pairloom.operators import context_codes

LINK = r'<a href="([^"]*)">([^<]*)</a>'
HTML = (
    "<title>see A01 and b02 (old A03)</title>"
    '<a href="/A">Section</a><a href="/A01">Farming [x]</a><a href="/A01B">Soil</a><a href="/B02">Mills of A01</a>'
)
# Codes and titles stand in different elements, one title fewer than codes.
CLASS_PAGE = (
    "<span class='symbol'>H</span><span class='symbol'>H01</span><span class='symbol'>H01L</span><span class='symbol'>H02</span>"
    "<div class='class-title'>ELECTRICITY</div><div class='class-title'>BASIC ELEMENTS (H02)</div><div class='class-title'>see h02</div>"
)


def pages(spark):
    return spark.createDataFrame([(1, HTML), (2, "<title>none</title><a href='x'>y</a>")], "page_id bigint, html string")


def listed(spark):
    titled = pages(spark).withColumn("page_title", F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    found = context_codes.listed_entries(titled, (LINK, 1), (LINK, 2), ("page_title",))
    return found.withColumns({"symbol": F.replace(F.col("code"), F.lit("/"), F.lit("")), "raw": F.concat_ws(" ", "title", "page_title")})


def test_links(spark):
    rows = listed(spark).orderBy("place").collect()
    assert [(row.place, row.symbol, row.title) for row in rows] == [
        (0, "A", "Section"),
        (1, "A01", "Farming [x]"),
        (2, "A01B", "Soil"),
        (3, "B02", "Mills of A01"),
    ]


def test_codes_and_titles_from_different_elements(spark):
    page = spark.createDataFrame([(1, CLASS_PAGE)], "page_id bigint, html string")
    code, title = (r"class='symbol'>([^<]*)<", 1), (r"class='class-title'>([^<]*)<", 1)
    found = context_codes.listed_entries(page, code, title).withColumnsRenamed({"code": "symbol", "title": "raw"})
    assert [(r.place, r.symbol, r.raw) for r in found.orderBy("place").collect()] == [
        (0, "H", "ELECTRICITY"), (1, "H01", "BASIC ELEMENTS (H02)"), (2, "H01L", "see h02"),
    ]
    (row,) = context_codes.context_dictionary(found).collect()
    assert (row.context, row.description, row.mentioned_groups) == ("H01", "basic elements ", "")


def test_zip_stops_at_the_shorter_list(spark):
    codes, titles = F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("x"), F.lit("y"))
    got = spark.range(1).select(context_codes.zip_shorter(codes, titles, ("code", "title"))).first()[0]
    assert [tuple(row) for row in got] == [("a", "x"), ("b", "y")]


def test_dictionary(spark):
    rows = {row.context: row for row in context_codes.context_dictionary(listed(spark)).collect()}
    assert set(rows) == {"A01", "B02"}
    assert rows["A01"].description == "farming  see a01 and b02 "
    assert rows["A01"].mentioned_groups == "A01"
    assert rows["B02"].description == "mills of a01 see a01 and b02 "


def test_concat_over_many_spans(spark):
    """One code fills most rows; its pieces are ordered in many groups."""
    entries = spark.range(2000).select(
        F.lit("hot").alias("context"), F.col("id").alias("page_id"), F.lit(0).alias("place"), F.col("id").cast("string").alias("d")
    )
    empty = spark.createDataFrame([("none", 5, 0, "")], entries.schema)
    span = F.floor(F.col("page_id") / 16)
    got = context_codes.ordered_concat(entries.unionByName(empty), "context", "d", ["page_id", "place"], span)
    assert {row.context: row.d for row in got.collect()} == {"hot": "".join(map(str, range(2000))), "none": ""}


def test_mentions_equal_plain_search(spark):
    texts = ["abc abd", "ABC", "xxABxx", "", "é AB", "😀AB\nZZZZ", "b02"]
    codes = ["ABC", "AB", "XX", "ZZZZ", "ZZ", "é", "B02", "b0"]
    raw = spark.createDataFrame([(t,) for t in texts], "raw string")
    known = spark.createDataFrame([(c,) for c in codes], "context string")
    got = {tuple(row) for row in context_codes.mentioned_codes(raw, known).collect()}
    assert got == {(t, c) for t in texts for c in codes if c in t}
    assert context_codes.mentioned_codes(raw, known.limit(0)).count() == 0


def test_long_texts_take_one_pass(spark):
    raw = spark.createDataFrame([("ab c" * 20_000 + "Q17",)], "raw string")
    known = spark.createDataFrame([("Q17",), ("zzz",)], "context string")
    context_codes.mentioned_codes(raw, known).collect()
    start = time.perf_counter()
    assert [row.code for row in context_codes.mentioned_codes(raw, known).collect()] == ["Q17"]
    assert time.perf_counter() - start < 10


def test_few_and_many_codes_agree(spark, monkeypatch):
    from pairloom.operators import context_codes

    texts = spark.createDataFrame([("see A01 and b12.",), ("A0 A01A01",), ("",), (None,), ("none here",)], "raw string")
    codes = spark.createDataFrame([("A01",), ("A0",), ("b12",), ("zz",), ("",)], "context string")
    few = sorted(context_codes.mentioned_codes(texts, codes).collect())
    monkeypatch.setattr(context_codes, "FEW_CODES", 1)
    many = sorted(context_codes.mentioned_codes(texts, codes).collect())
    assert few == many and len(few) == 5


def test_entries_are_not_taken_to_the_driver(spark):
    """Repeated texts compress to small files, so a join that trusts file sizes would broadcast them."""
    from pairloom.session import written

    rows = spark.range(3000).select(
        F.col("id").alias("page_id"), F.lit(0).alias("place"), F.concat(F.lit("A0"), F.col("id") % 2).alias("symbol"), F.lit("see A01 " * 20).alias("raw")
    )
    entries = written(context_codes.class_entries(rows), "entries")
    mentions = context_codes.mentioned_codes(entries, context_codes.code_dictionary(entries))
    for found in (context_codes.mention_sets(entries, mentions), context_codes.context_dictionary(rows)):
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert {row.context: row.mentioned_groups for row in found.collect()} == {"A00": "A01", "A01": "A01"}
