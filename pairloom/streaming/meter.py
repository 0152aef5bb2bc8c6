"""Weighted running means over arriving training steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from pairloom.session import scratch_path


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def meter_by_key(steps: DataFrame, keys: list[str], value: str = "loss", weight: str = "n") -> DataFrame:
    """State is two sums for each key, whatever the number of steps."""
    return steps.groupBy(*keys).agg(F.count("*").alias("steps"), weighted_mean(value, weight).alias("avg"))


def meter_by_window(
    steps: DataFrame, keys: list[str], time: str, width: str, delay: str, value: str = "loss", weight: str = "n"
) -> DataFrame:
    """Tumbling windows on event time; a window leaves the state once the watermark passes it."""
    timed = steps.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return timed.groupBy(F.window(time, width).alias("window"), *keys).agg(
        F.count("*").alias("steps"), weighted_mean(value, weight).alias("avg")
    )


def run_complete(meter: DataFrame) -> DataFrame:
    """Run over what has arrived; every micro-batch writes the whole, small result table."""
    spark = meter.sparkSession
    out = scratch_path(spark, "meter")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = (
        meter.writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", scratch_path(spark, "meter-log"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(meter.schema).parquet(out)


def run_update(meter: DataFrame, keys: list[str]) -> DataFrame:
    """Run over what has arrived; the table holds every group of ``keys`` as it stood last, open windows included.

    A micro-batch writes the groups that it changed, so closed windows can leave the state. A repeated batch
    replaces its own folder.
    """
    spark = meter.sparkSession
    out = scratch_path(spark, "windows")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    query = (
        meter.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", scratch_path(spark, "windows-log"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(StructType(meter.schema.fields).add("_batch", LongType())).parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in meter.columns if c not in keys]), "_batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*meter.columns)
