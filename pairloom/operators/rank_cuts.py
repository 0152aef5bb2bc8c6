"""Exact order statistics per stratum, and splits made from them.

A shuffled, stratified split puts the rows of a stratum in a random but repeatable order (hash
key of the id) and cuts that order at given ranks. The rows need not be sorted or moved for it:
counts by hash prefix tell in which small bucket each cut lies, only the rows of those buckets
are ranked, and every row is then compared with the few cut keys of its stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_key
from pairloom.session import hex_digits, same, settled

# Fixed value: 16**3 buckets a stratum leave few rows beside a cut and keep the counts short.
MOST_DIGITS = 3


def _match(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & same(left[key], right[f"_r{key}"])
    return condition


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({key: f"_r{key}" for key in keys})


def bucket_counts(keyed: DataFrame, strata: list[str]) -> DataFrame:
    """Rows by stratum and hash prefix: one row a bucket, combined before the shuffle."""
    digits = hex_digits(keyed.sparkSession, MOST_DIGITS)
    bucket = F.substring("_key", 1, digits).alias("_bucket")
    return settled(keyed.groupBy(*strata, bucket).agg(F.count("*").alias("_n")), "bucket-counts")


def cut_keys(keyed: DataFrame, strata: list[str], ranks) -> DataFrame:
    """``strata`` with ``_cuts``, the hash keys found at the wanted ranks of each stratum.

    ``ranks`` turns the table (strata, ``_total``) into (strata, ``_rank``), one row for each
    cut. A rank of 0 lies before all rows.
    """
    digits = hex_digits(keyed.sparkSession, MOST_DIGITS)
    counts = bucket_counts(keyed, strata)
    wanted = ranks(counts.groupBy(*strata).agg(F.sum("_n").alias("_total")))
    before = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_bucket")) - F.col("_n")
    reached = _renamed(counts.withColumn("_before", before), strata)
    places = settled(
        wanted.join(
            reached,
            _match(wanted, reached, strata)
            & (F.col("_rank") > F.col("_before"))
            & (F.col("_rank") <= F.col("_before") + F.col("_n")),
        ).select(*strata, "_bucket", "_rank", (F.col("_rank") - F.col("_before")).alias("_place")),
        "cut-places",
    )
    edge = _renamed(places.select(*strata, "_bucket").distinct(), [*strata, "_bucket"])
    rows = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
    inside = rows.join(edge, _match(rows, edge, [*strata, "_bucket"]), "left_semi")
    order = Window.partitionBy(*strata, "_bucket").orderBy("_key")
    ranked = inside.withColumn("_place", F.row_number().over(order))
    named = _renamed(places, [*strata, "_bucket", "_place"])
    found = ranked.join(named, _match(ranked, named, [*strata, "_bucket", "_place"])).select(*strata, "_key")
    first = wanted.filter(F.col("_rank") <= 0).select(*strata, F.lit("").alias("_key"))
    cuts = found.unionByName(first).groupBy(*strata).agg(F.sort_array(F.collect_list("_key")).alias("_cuts"))
    return settled(cuts, "cuts")


def cuts_passed(
    df: DataFrame, cuts: DataFrame, strata: list[str], key: Column, n_cuts: int
) -> tuple[DataFrame, Column]:
    """``df`` with the cuts of its stratum, and the number of cuts that lie before the row."""
    named = _renamed(cuts, strata)
    joined = df.join(named, _match(df, named, strata), "left")
    passed = sum(F.coalesce((F.get("_cuts", F.lit(i)) < key).cast("int"), F.lit(0)) for i in range(n_cuts))
    return joined, passed


def _without_cuts(df: DataFrame, strata: list[str]) -> DataFrame:
    return df.drop("_cuts", *[f"_r{key}" for key in strata])


def _quotas(test_size: float, groups: list[str], strata: list[str]):
    """Test rows of each stratum: proportional, rounded by the largest remainder."""

    def ranks(totals: DataFrame) -> DataFrame:
        group = Window.partitionBy(*groups)
        size = F.sum("_total").over(group)
        shares = totals.withColumn("_size", size).withColumn(
            "_test", F.ceil(F.lit(test_size) * F.col("_size").cast("double")).cast("decimal(18,0)")
        )
        whole = shares.withColumn("_exact", F.col("_total").cast("decimal(18,0)") * F.col("_test")).withColumns(
            {"_base": F.expr("_exact div _size"), "_rest": F.expr("_exact % _size")}
        )
        spare = F.col("_test").cast("bigint") - F.sum("_base").over(group)
        turn = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("_rest"), *strata))
        return whole.withColumns({"_spare": spare, "_turn": turn}).select(
            *groups, *strata, (F.col("_base") + (F.col("_turn") <= F.col("_spare")).cast("bigint")).alias("_rank")
        )

    return ranks


def _fold_ranks(n_folds: int, strata: list[str]):
    """Fold sizes as if the strata were laid end to end and dealt out in turn."""

    def ranks(totals: DataFrame) -> DataFrame:
        start = F.sum("_total").over(Window.orderBy(*strata)) - F.col("_total")

        def dealt(upto: Column, k: Column) -> Column:
            return F.floor((upto + F.lit(n_folds - 1) - k) / F.lit(n_folds))

        sizes = F.transform(
            F.sequence(F.lit(0), F.lit(n_folds - 2)),
            lambda k: dealt(F.col("_start") + F.col("_total"), k) - dealt(F.col("_start"), k),
        )
        sums = F.transform(
            F.sequence(F.lit(1), F.lit(n_folds - 1)),
            lambda k: F.aggregate(F.slice("_sizes", 1, k), F.lit(0).cast("bigint"), lambda acc, x: acc + x),
        )
        return (
            totals.withColumn("_start", start)
            .withColumn("_sizes", sizes)
            .select(*strata, F.explode(sums).alias("_rank"))
        )

    return ranks


def assign_folds(
    df: DataFrame,
    stratum: str | list[str],
    n_folds: int = 4,
    seed: int = 42,
    id_col: str = "id",
    name: str = "fold",
) -> DataFrame:
    """Shuffled stratified folds; sizes differ by one at most, per stratum and in total.

    Pass another column than the label as ``stratum`` for group-stratified folds. The rows stay
    where they are: three narrow scans find the cuts, one broadcast join applies them.
    """
    if n_folds < 2:
        raise ValueError("n_folds must be at least 2")
    strata = [stratum] if isinstance(stratum, str) else list(stratum)
    keyed = df.select(*strata, hash_key(id_col, seed).alias("_key"))
    cuts = cut_keys(keyed, strata, _fold_ranks(n_folds, strata))
    joined, passed = cuts_passed(df, cuts, strata, hash_key(id_col, seed), n_folds - 1)
    return _without_cuts(joined.withColumn(name, passed.cast("int")), strata)


def assign_split(
    df: DataFrame,
    stratum: str | list[str],
    test_size: float = 0.2,
    seed: int = 39,
    id_col: str = "id",
    groups: tuple[str, ...] = (),
    name: str = "side",
) -> DataFrame:
    """Stratified split of each group into ``train`` and ``test`` rows."""
    strata = [stratum] if isinstance(stratum, str) else list(stratum)
    keys = [*groups, *strata]
    keyed = df.select(*keys, hash_key(id_col, seed).alias("_key"))
    cuts = cut_keys(keyed, keys, _quotas(test_size, list(groups), strata))
    joined, passed = cuts_passed(df, cuts, keys, hash_key(id_col, seed), 1)
    side = F.when(passed == 0, F.lit("test")).otherwise(F.lit("train"))
    return _without_cuts(joined.withColumn(name, side), keys)


def with_test_splits(
    df: DataFrame,
    stratum: str | list[str],
    n_splits: int = 5,
    test_size: float = 0.2,
    seed: int = 39,
    id_col: str = "id",
    groups: tuple[str, ...] = (),
    name: str = "test_splits",
) -> DataFrame:
    """Several independent splits in one column: bit s is set in rows that are test rows of split s.

    Keys of all splits are counted where a row lies; the row itself is joined once, with the cuts of its stratum.
    """
    if not 1 <= n_splits <= 31:
        raise ValueError("n_splits must lie between 1 and 31")
    strata = [stratum] if isinstance(stratum, str) else list(stratum)
    own = [*groups, *strata]
    keys = ["split", *own]
    numbers = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))
    keyed = df.select(id_col, *own, numbers.alias("split")).select(*keys, hash_key(id_col, seed, F.col("split")).alias("_key"))
    found = cut_keys(keyed, keys, _quotas(test_size, ["split", *groups], strata))
    cuts = found.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("split", F.get("_cuts", F.lit(0))))).alias("_cuts"))
    named = _renamed(cuts, own)
    joined = df.join(named, _match(df, named, own), "left")
    bits = sum(
        F.when(F.coalesce(F.element_at("_cuts", F.lit(s)) < hash_key(id_col, seed, F.lit(s)), F.lit(False)), F.lit(0)).otherwise(F.lit(1 << s))
        for s in range(n_splits)
    )
    return _without_cuts(joined.withColumn(name, bits.cast("int")), own)


def in_test(split: int | Column, bits: str = "test_splits") -> Column:
    """Whether a row is a test row of the split."""
    place = F.lit(1 << split) if isinstance(split, int) else F.shiftleft(F.lit(1), split)
    return F.col(bits).bitwiseAND(place) != 0


def assign_repeated_split(
    df: DataFrame,
    stratum: str | list[str],
    n_splits: int = 5,
    test_size: float = 0.2,
    seed: int = 39,
    id_col: str = "id",
    groups: tuple[str, ...] = (),
) -> DataFrame:
    """Several independent splits: every row once for each ``split`` with its ``side``."""
    marked = with_test_splits(df, stratum, n_splits, test_size, seed, id_col, groups, "_test")
    repeated = marked.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    place = F.expr("shiftright(_test, split) & 1")
    return repeated.withColumn("side", F.when(place == 1, F.lit("test")).otherwise(F.lit("train"))).drop("_test")
