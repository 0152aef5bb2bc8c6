"""The job's input tables, derived from the driver tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_key, unit
from pairloom.operators import context_codes
from pairloom.sources import schemas

SEED = 42
N_FOLDS = 4
# Names of the test prediction sets with the width of their noise.
VERSIONS = {"alpha": 0.6, "beta": 0.8, "gamma": 1.0, "delta": 1.2, "kappa": 1.4}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.DRIVER_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _code() -> Column:
    return F.concat(
        F.char(F.lit(65) + F.col("n_regionkey")), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.char(F.lit(65) + F.col("r_regionkey")).alias("context_grp_1"),
        F.lower("r_name").alias("text_grp_1"),
    )


def sections_all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default language has a null ``lang``, the mapped one its name."""
    default = sections(spark, sf_dir).withColumn("lang", F.lit(None).cast("string"))
    mapped = default.withColumns({"text_grp_1": F.reverse("text_grp_1"), "lang": F.lit("zh-tw")})
    return default.unionByName(mapped)


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some nations are left out, so that pairs without a class text exist."""
    nations = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 7 != 0)
    own = nations.select(
        _code().alias("context"),
        F.lower("n_name").alias("description"),
        F.col("n_nationkey").alias("key"),
        F.col("n_regionkey").alias("region"),
    )
    other = nations.select(_code().alias("other"), F.col("n_regionkey").alias("region"))
    mentions = (
        own.filter(F.col("key") % 5 != 0)
        .join(other, "region")
        .filter(F.col("other") != F.col("context"))
        .groupBy("context")
        .agg(F.array_join(F.array_sort(F.collect_list("other")), "; ").alias("mentioned_groups"))
    )
    return own.select("context", "description").join(mentions, "context", "left")


def pairs(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Labelled pairs; ``orders`` may be a stream."""
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("o_orderkey").cast("string").alias("id"),
            F.lower("o_orderpriority").alias("anchor"),
            F.lower("c_mktsegment").alias("target"),
            _code().alias("context"),
            ((F.substring("o_orderpriority", 1, 1).cast("double") - 1) / 4).alias("score"),
        )
    )


def test_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled pairs of the same shape, one for each customer."""
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.lower("c_mktsegment").alias("anchor"),
        F.lower("n_name").alias("target"),
        _code().alias("context"),
    )


# A listed code with its title, and the page title, in the driver's pages.
LINK = r'<a href="([^"]*)">([^<]*)</a>'
PAGE_TITLE = r"<title>([^<]*)</title>"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links stand for listed codes: page, place, symbol, title, page title, and the text that describes the symbol."""
    pages = table(spark, sf_dir, "pages").withColumn("page_title", F.regexp_extract("html", PAGE_TITLE, 1))
    return context_codes.listed_entries(pages, (LINK, 1), (LINK, 2), ("page_title",)).select(
        "page_id",
        "place",
        F.replace(F.col("code"), F.lit("/"), F.lit("")).alias("symbol"),
        "title",
        "page_title",
        F.concat(F.col("title"), F.lit(" "), F.col("page_title")).alias("raw"),
    )


def prediction(width: float, *salts) -> Column:
    """A score with repeatable noise of the given width, to six digits."""
    noisy = F.col("score") + (unit(hash_key("id", *salts)) - 0.5) * width
    return F.floor(noisy * 1_000_000 + 0.5) / 1_000_000


def with_predictions(df: DataFrame) -> DataFrame:
    """One column for each prediction set."""
    return df.withColumns({name: prediction(width, name) for name, width in VERSIONS.items()})


def predictions_long(df: DataFrame) -> DataFrame:
    """One row for each id and prediction set."""
    keep = [F.col(c) for c in ("id", "fold", "score")]
    return with_predictions(df).unpivot(keep, list(VERSIONS), "version", "pred")


def steps(
    spark: SparkSession, sf_dir: str, events: DataFrame | None = None, keep_time: bool = False
) -> DataFrame:
    """Training log rows out of the event table, or out of a stream of it.

    Losses are whole numbers, so their sums are exact in any order.
    """
    events = table(spark, sf_dir, "events") if events is None else events
    return events.select(
        *(["ts"] if keep_time else []),
        F.col("event_type").alias("run"),
        (F.col("user_id") % 4).cast("int").alias("fold"),
        F.dayofmonth("ts").alias("epoch"),
        F.col("event_id").alias("step"),
        (F.lit(1) + F.col("event_id") % 32).alias("n"),
        F.round(F.col("value") * 100).alias("loss"),
    )
