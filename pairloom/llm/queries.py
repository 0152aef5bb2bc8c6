"""Registered queries of this subpackage, one for each operator, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import digests, hilbert_search, ngram_join, page_text, periodic_runs, private_spans
from pairloom.llm import source_mix, substring_dedup, token_codes, token_counts, toxicity, warc_store, whitening
from pairloom.llm.common import table
from pairloom.llm.pieces import read_tokenizer
from pairloom.queries.common import Registry, sql_key, sql_unit

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql
TOKEN_LIMIT = 512

MIX_SQL = f"""WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes GROUP BY source),
weighed AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM sources),
ratios AS (SELECT *, CAST(source_size AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio FROM weighed),
summed AS (SELECT *,
    coalesce(sum(source_size * 2) OVER before, 0) AS stops, coalesce(sum(weight) OVER before, 0) AS weights,
    sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight
  FROM ratios WINDOW before AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (CAST(1.5 AS DOUBLE) * CAST(all_size AS DOUBLE) - CAST(stops AS DOUBLE))
    / CAST(all_weight - weights AS DOUBLE) AS level FROM summed),
found AS (SELECT level FROM levels WHERE level * weight <= source_size * 2 ORDER BY ratio, rank LIMIT 1),
targets AS (SELECT source, source_size,
    least(CAST(source_size * 2 AS DOUBLE), coalesce((SELECT level FROM found), 'inf'::DOUBLE) * weight) AS target FROM levels),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS place FROM sizes),
stepped AS (SELECT p.doc_id, p.size, t.source_size, t.target, CAST(p.place AS DOUBLE) AS place,
    CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0 END AS step,
    {sql_unit(sql_key("coalesce('s' || p.source, 'n')", source_mix.SEED))} AS start
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * least(2,
    CAST(floor((place + 1) * step + start) AS BIGINT) - CAST(floor(place * step + start) AS BIGINT)) AS BIGINT) AS taken
FROM stepped"""


@registry(MIX_SQL)
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix_copies(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@registry()
def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return token_codes.code_documents(table(spark, sf_dir, "documents"), spec, ["doc_id"], outputs)


@registry()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), spec, ["doc_id"])
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@registry()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@registry()
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@registry()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, lexicon, ["doc_id"])
    return found.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


WARC_SQL = """WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
digests AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM payloads),
heads AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS head FROM digests),
bits AS (SELECT page_id, payload_bytes, head, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
      (CAST('0x' || substr(hex || '0', 1 + CAST(i * 5 // 4 AS INTEGER), 2) AS INTEGER)
        >> CAST(3 - i * 5 % 4 AS INTEGER)) & 31) AS INTEGER), 1) FOR i IN range(32)], '') AS payload_digest FROM heads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM head OR head IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM bits"""


@registry(WARC_SQL)
def op5_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_store.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@registry()
def op8_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.with_next(table(spark, sf_dir, "documents"))


@registry()
def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = page_text.extract(pages, page_text.learn(pages), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


@registry()
def op3_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hilbert_search.search(vectors, F.col("vec_id") % 20 == 0)


WORD = r"[^\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents as op11 reads them: in one of ten, chosen by id, the words from some place on repeat the first of them."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("edit"))
    n = F.size("words")
    placed = chosen.withColumn("words", F.when(F.col("edit"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))))
    placed = placed.withColumn("a", F.when(F.col("edit") & (n > 0), (F.col("g") % n).cast("int")))
    placed = placed.withColumn("p", F.expr("CAST(1 + (size(words) - a) div (3 + g % 8) AS INT)"))
    rest = n - F.col("a")
    copies = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))
    edited = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(F.flatten(copies), F.lit(1), rest))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(edited, " ")).otherwise(F.col("text")).alias("text"))


@registry()
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse_runs(with_planted_runs(table(spark, sf_dir, "documents")), ["doc_id"])
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    order = F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))
    found = found.withColumn("best", F.array_max(order))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@registry()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), ["vec_id"])


def private_sql() -> str:
    """Every kind's matches, placed by the pieces between them, confirmed and scored as in the operator."""
    digits = "list_transform(string_split(reverse({0}), ''), lambda c, i: CAST(c AS INTEGER) * (2 - i % 2))"
    luhn = f"list_sum(list_transform({digits}, lambda v: v - CASE WHEN v > 9 THEN 9 ELSE 0 END)) % 10 = 0"
    bare = "replace(replace(m, ' ', ''), '-', '')"
    base = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", f"regexp_matches(m, '{private_spans.ADDRESS}')"),
        "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({bare}) BETWEEN 13 AND 19 AND {luhn.format(bare)}"),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
    }
    unknown = "NOT (before = '' AND start > 0)"
    near = f"right(before, {private_spans.NEAR}) || ' ' || left(after, {private_spans.NEAR})"
    lengths = ", ".join(f"('{c}', {n})" for c, n in private_spans.ACCOUNT_LENGTHS.items())
    rules = {kind.name: kind for kind in private_spans.KINDS}
    selects = []
    for place, (name, kind) in enumerate(rules.items()):
        pattern, fits = base.get(name, (kind.pattern, "true"))
        if name == "ssn":
            fits = f"regexp_matches(m, '{private_spans.INSURANCE}') AND {unknown} AND NOT regexp_matches(right(before, 1), '[0-9A-Za-z-]') AND NOT regexp_matches(left(after, 1), '[0-9A-Za-z-]')"
        if name == "tel":
            fits = (
                f"{unknown} AND NOT regexp_matches(right(before, {private_spans.NEAR}), '[+0-9][ ().-]*$') AND NOT regexp_matches(after, '^[ ().-]?[0-9]')"
                " AND NOT regexp_matches(right(before, 1), '[0-9A-Za-z]') AND NOT regexp_matches(left(after, 1), '[0-9A-Za-z]')"
            )
        if name == "iban":
            fits = f"{unknown} AND account_end IS NOT NULL AND NOT regexp_matches(right(before, 1), '[A-Za-z0-9]')"
        scored = f"{kind.score} + CASE WHEN regexp_matches(lower({near}), '{private_spans.word_pattern(kind.words)}') THEN {private_spans.HINT} ELSE 0 END"
        end = "start + account_end" if name == "iban" else "start + length(m)"
        account = """, (SELECT CASE WHEN length(c) >= l AND (SELECT list_reduce(list_prepend(0, list_transform(
      string_split(substr(left(c, l), 5) || left(c, 4), ''), lambda x: CAST(CASE WHEN x BETWEEN '0' AND '9' THEN ascii(x) - 48 ELSE ascii(x) + 945 END AS INTEGER))),
      lambda a, x: CASE WHEN x < 1000 THEN (a * 10 + x) % 97 ELSE (a * 100 + x - 1000) % 97 END)) = 1
      AND NOT regexp_matches(left(substr(m, l + spaces + 1) || after, 1), '[A-Za-z0-9]') THEN l + spaces END FROM (
      SELECT replace(m, ' ', '') AS c, l, (SELECT count(*) FROM (SELECT unnest(range(1, length(m) + 1)) AS i) WHERE m[i] = ' '
        AND length(replace(left(m, i), ' ', '')) < l) AS spaces FROM lengths WHERE country = left(m, 2))) AS account_end""" if name == "iban" else ""
        selects.append(f"""SELECT row, {place} AS place, '{name}' AS kind, start, {end} AS stop, {str(kind.base).lower()} AS base FROM (
  SELECT *{account} FROM (SELECT row, unnest(list_transform(range(1, len(ms) + 1), lambda i: {{'m': ms[i], 'before': ps[i], 'after': ps[i + 1],
    'start': CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT)}}), recursive := true)
    FROM (SELECT row, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM texts)))
  WHERE {fits} AND ({str(kind.base).lower()} OR {scored} >= {private_spans.ENOUGH})""")
    line = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start)"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{k}' AND base) AS BIGINT) AS n_{k}" for k in base)
    return f"""WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
lengths(country, l) AS (VALUES {lengths}),
spans AS ({" UNION ALL ".join(selects)})
SELECT doc_id, {counts}, sha256(coalesce({line} FILTER (WHERE base), '')) AS base_sha256, coalesce({line}, '') AS spans
FROM texts LEFT JOIN spans USING (row) GROUP BY row, doc_id"""


@registry(private_sql())
def op12_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans.find_spans(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s.base)

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.base & (s.kind == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind.name) for kind in private_spans.KINDS if kind.base]
    return found.select("doc_id", *counts, F.sha2(private_spans.listed(base), 256).alias("base_sha256"), private_spans.listed(F.col("spans")).alias("spans"))
