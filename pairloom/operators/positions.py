"""Global positions and batch numbers without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.hashing import hash_key, unit
from pairloom.session import hex_digits, small_side, written

ROW_BITS = 33  # monotonically_increasing_id keeps the place inside a partition in the low bits


def numbered(df: DataFrame, order: list[Column], name: str, index: str = "_index") -> DataFrame:
    """Add each row's place (from 0) in the order of ``order`` over the whole table.

    Rows are range-partitioned and sorted inside their range, then written once, so that places stay
    the same whenever a task is repeated. Offsets of the ranges have one row for each partition.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", ROW_BITS).cast("int")
    inside = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return (
        placed.withColumn("_part", part)
        .withColumn("_inside", inside)
        .join(F.broadcast(starts), "_part")  # one row for each partition
        .withColumn(index, F.col("_start") + F.col("_inside"))
        .drop("_at", "_part", "_inside", "_start")
    )


def with_position(df: DataFrame, order: list[Column], bucket: Column, buckets: int, name: str) -> DataFrame:
    """Zero-based place of each row in ``order``.

    ``bucket`` is a whole number below ``buckets`` that never falls along ``order``. Rows are
    ranked inside their bucket; the rows of all earlier buckets are added from a table of
    ``buckets`` rows, which is what bounds the broadcast.
    """
    bucketed = df.withColumn("_bucket", bucket)
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    offsets = small_side(
        counts.select(F.col("_bucket").alias("_offset_bucket"), before.alias("_before")), max_rows=buckets
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return (
        bucketed.withColumn("_place", place)
        .join(offsets, F.col("_bucket") == F.col("_offset_bucket"))
        .withColumn(name, F.col("_before") + F.col("_place"))
        .drop("_bucket", "_place", "_offset_bucket", "_before")
    )


def shuffled_position(df: DataFrame, id_col: str = "id", seed: int = 42, name: str = "position") -> DataFrame:
    """Position in a random but repeatable order of distinct ids."""
    digits = hex_digits(df.sparkSession)
    key = hash_key(id_col, seed)
    bucket = F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")
    return with_position(df, [key, F.col(id_col)], bucket, 16**digits, name)


def weighted_position(
    df: DataFrame,
    weights: DataFrame,
    by: str,
    id_col: str = "id",
    seed: int = 42,
    inverse: bool = False,
    name: str = "position",
) -> DataFrame:
    """Position in a weighted random order without replacement.

    ``weights`` holds the share of every value of ``by`` (a few labels or sections). A row's sort
    key is exponential with the weight of its value, so heavy values tend to come first. The
    shares also give the distribution of the keys over the whole table, and that distribution
    function splits the order into buckets of about equal size. A value without a share is an
    error, as the row would have no place; a level that no row has (share 0) is left out.
    """
    buckets = 16 ** hex_digits(df.sparkSession)
    weight = F.col("share") if not inverse else 1 / F.col("share")
    table = weights.filter("share > 0").select(F.col(by).alias("_by"), "share", weight.alias("_weight"))
    mixture = table.agg(F.sort_array(F.collect_list(F.struct("_weight", "share"))).alias("_mixture"))
    known = F.when(
        F.col("_weight").isNull(), F.raise_error(F.lit(f"a value of {by} has no share")).cast("double")
    ).otherwise(F.col("_weight"))
    key = -F.ln(unit(hash_key(id_col, seed))) / known
    keyed = (
        df.join(table.select("_by", "_weight"), F.col(by).eqNullSafe(F.col("_by")), "left")
        .withColumn("_key", key)
        .withColumn("_mixture", mixture.scalar())
    )
    below = F.aggregate(
        "_mixture",
        F.lit(0.0),
        lambda acc, part: acc + part["share"] * (1 - F.exp(-F.col("_key") * part["_weight"])),
    )
    bucket = F.least(F.floor(below * buckets), F.lit(buckets - 1)).cast("bigint")
    placed = with_position(keyed, [F.col("_key"), F.col(id_col)], bucket, buckets, name)
    return placed.drop("_by", "_weight", "_key", "_mixture")


def batch_of(position: str | Column, size: int) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / F.lit(size)).cast("bigint")


def with_batch(df: DataFrame, size: int, id_col: str = "id", seed: int = 42, name: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows in shuffled order, the last one short."""
    placed = shuffled_position(df, id_col, seed, "_position")
    return placed.withColumn(name, batch_of("_position", size)).drop("_position")
