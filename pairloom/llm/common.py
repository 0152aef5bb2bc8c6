"""Helpers shared by the operators: row keys, global places, tables between steps."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.positions import ROW_BITS, numbered
from pairloom.session import written

__all__ = ["discard", "freeing", "give_back", "numbered", "running", "stored", "table", "text_key"]

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
STORED_CONF = {SHUFFLE_CLEANUP: "true", BATCH_BYTES: str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column | str) -> list[Column]:
    """128 bits that stand for a text; null and empty count as one."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [F.xxhash64(col, F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), col).alias("k2")]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``written``, and the shuffle files of that job go as soon as the table stands, not when the driver next collects garbage.

    Its tasks send few bytes to Python at once: long texts and bitmaps take their memory on both sides. A session that
    sends even fewer goes on doing so.
    """
    conf = df.sparkSession.conf
    before = {key: conf.get(key) for key in STORED_CONF}
    for key, value in STORED_CONF.items():
        if not (key == BATCH_BYTES and before[key].isdigit() and int(before[key]) < int(value)):
            conf.set(key, value)
    try:
        return written(df, name)
    finally:
        for key, value in before.items():
            conf.set(key, value)


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` made, once all that was built on it stands written itself."""
    spark = table.sparkSession
    files = table.inputFiles()
    if files and "/pairloom/" in files[0]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def give_back() -> None:
    """Return what this process has freed to the system: neither Arrow's pool nor the C library does by itself."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def freeing(work):
    """``work``, a task's function of its batches; what it has freed leaves the worker, which lives on beside later stages."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def running(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Add sums over all earlier rows of the whole table: ``sums`` maps a new column to the summed one."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_part", F.shiftright("_at", ROW_BITS).cast("int"))
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{new}") for new, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_part", *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_s_{new}") for new in sums]
    )
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = placed.join(F.broadcast(starts), "_part")  # one row for each partition
    found = found.withColumns(
        {new: F.col(f"_s_{new}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in sums.items()}
    )
    return found.drop("_part", "_at", *[f"_s_{new}" for new in sums])
