"""Codes, titles and mentions out of stored classification pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.session import written

FEW_CODES = 10_000  # codes that are looked up inside a text's row
FEW_CODES_SIGNS = 200_000
MAP_BITS = 22  # places of the bitmap for more codes
Pattern = tuple[str, int]  # a regular expression and one of its groups

def zip_shorter(left: Column, right: Column, names: tuple[str, str]) -> Column:
    """Pairs of the i-th elements, as many as the shorter list has."""
    size = F.least(F.size(left), F.size(right))
    return F.arrays_zip(
        F.slice(left, F.lit(1), size).alias(names[0]), F.slice(right, F.lit(1), size).alias(names[1])
    )


def listed_entries(pages: DataFrame, code: Pattern, title: Pattern, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each listed code: page, place on the page, code, title, and the columns of ``keep``.

    ``code`` and ``title`` are a regular expression and a group each, found on their own in the page; the i-th code
    goes with the i-th title.
    """
    lists = pages.select(
        "page_id", *keep, *[F.regexp_extract_all("html", F.lit(p), F.lit(g)).alias(n) for n, (p, g) in (("codes", code), ("titles", title))]
    )
    listed = lists.withColumn("entries", zip_shorter(F.col("codes"), F.col("titles"), ("code", "title")))
    # The outer form keeps the optimiser from testing the list for rows first, with a second parse.
    exploded = listed.select("page_id", *keep, F.posexplode_outer("entries").alias("place", "entry"))
    return exploded.filter(F.col("place").isNotNull()).select("page_id", "place", "entry.code", "entry.title", *keep)


def class_entries(listed: DataFrame) -> DataFrame:
    """Entries below section level with class code and cleaned description.

    ``listed`` holds page_id, place, symbol and raw, the text that describes the symbol.
    """
    return listed.filter(F.length("symbol") > 1).select(
        "page_id",
        "place",
        "symbol",
        text.class_of("symbol").alias("context"),
        "raw",
        text.description_for("symbol", F.col("raw")).alias("description"),
    )


def code_dictionary(entries: DataFrame) -> DataFrame:
    return entries.select("context").distinct()


def mentioned_codes(raw_texts: DataFrame, codes: DataFrame) -> DataFrame:
    """Which of ``codes`` occur as a substring of each distinct text, case kept: rows (raw, code).

    A code occurs in a text exactly if it is one of the text's substrings of the code's length. Texts are made distinct
    first, and substrings inside their text. As long as the codes are few, a text hands on those of its substrings
    that are codes. Beyond that it hands on those that a bitmap of fixed size takes for codes, and an equality join decides.
    """
    known = codes.select(F.col("context").alias("code")).filter(F.length("code") > 0).distinct()
    few = [row.code for row in known.limit(FEW_CODES + 1).collect()]
    inside = len(few) <= FEW_CODES and sum(map(len, few)) <= FEW_CODES_SIGNS
    lengths = sorted({len(code) for code in few} if inside else {row.n for row in known.select(F.length("code").alias("n")).distinct().collect()})
    if not lengths:
        return raw_texts.select("raw", F.lit("").alias("code")).limit(0)
    pieces = F.concat(*[text.shingles("raw", size) for size in lengths])
    distinct = raw_texts.select("raw").distinct()
    if inside:
        return distinct.select("raw", F.explode(F.filter(pieces, lambda piece: piece.isin(few))).alias("code"))
    place = F.xxhash64("code").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    mark = known.select(F.shiftright(place, 6).alias("_word"), F.expr("shiftleft(1L, CAST(xxhash64(code) & 63 AS INT))").alias("_bit"))
    bitmap = mark.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))  # at most 2^(MAP_BITS - 6) rows
    found = distinct.select("raw", F.explode(pieces).alias("code")).withColumn("_word", F.shiftright(place, 6))
    near = found.join(F.broadcast(bitmap), "_word").filter(F.expr("shiftright(_bits, CAST(xxhash64(code) & 63 AS INT)) & 1") == 1)
    return near.select("raw", "code").join(known.hint("merge"), "code", "left_semi").select("raw", "code")


def ordered_concat(entries: DataFrame, key: str, value: str, order: list[str], span_of: Column) -> DataFrame:
    """Texts of each key joined in order.

    Empty texts add nothing and are left out. Pieces are put together by ``span_of`` first (a
    value that never falls along ``order``), so a key that fills a large part of the table is
    ordered in many tasks, and the last step joins the finished pieces only.
    """
    filled = entries.filter(F.col(value) != "").select(
        key, span_of.alias("_span"), F.struct(*order, F.col(value).alias("_text")).alias("_item")
    )
    keys = entries.select(key).distinct()

    def joined(items: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda item: item["_text"]), "")

    pieces = filled.groupBy(key, "_span").agg(joined("_item").alias("_text"))
    whole = (
        pieces.select(key, F.struct("_span", "_text").alias("_item")).groupBy(key).agg(joined("_item").alias(value))
    )
    return keys.join(whole.hint("merge"), key, "left").withColumn(value, F.coalesce(value, F.lit("")))


def mention_sets(entries: DataFrame, mentions: DataFrame) -> DataFrame:
    """Union of the mentions of all entries of a class, as sorted text.

    Duplicate (class, mention) pairs go before the sets are built, so a set never holds more than
    the code dictionary.
    """
    # Files of entries are far smaller than their rows, so joins are hinted: no side is taken to the driver by file size.
    own = entries.select("context", "raw").distinct().hint("merge")
    links = own.join(mentions, "raw").select("context", "code").distinct()
    sets = links.groupBy("context").agg(F.collect_set("code").alias("codes"))
    return (
        entries.select("context")
        .distinct()
        .join(sets.hint("merge"), "context", "left")
        .select("context", text.set_text(F.coalesce("codes", F.array().cast("array<string>"))).alias("mentioned_groups"))
    )


def context_dictionary(listed: DataFrame, pages_per_span: int = 4096) -> DataFrame:
    """Listed symbols with their texts to the class dimension: code, description, mentioned codes.

    Pages are parsed once; the entries, far smaller, are written for the steps that follow.
    """
    entries = written(class_entries(listed), "entries")
    span = F.floor(F.col("page_id") / pages_per_span)
    descriptions = ordered_concat(entries, "context", "description", ["page_id", "place"], span)
    mentions = mention_sets(entries, mentioned_codes(entries, code_dictionary(entries)))
    return descriptions.join(mentions.hint("merge"), "context")
