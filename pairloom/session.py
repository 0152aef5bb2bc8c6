"""Session helpers: local builder, scratch folder, size-checked small sides."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SMALL_SIDE_ROWS = 200_000

_local_scratch: str | None = None


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "pairloom") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session.

    Only a local master without that setting falls back to a folder of this machine, which goes with the process.
    """
    global _local_scratch
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="pairloom-")
            atexit.register(shutil.rmtree, _local_scratch, ignore_errors=True)
        base = _local_scratch
    return f"{base.rstrip('/')}/pairloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Materialise a summary table when it is small, else hand it back unchanged.

    At most ``max_rows + 1`` rows reach the driver. A table within the bound becomes a local
    relation of known size in one partition: Spark broadcasts it by its own threshold, and
    groups or windows over it need no shuffle. A larger one stays a distributed DataFrame.
    """
    spark = df.sparkSession
    max_rows = SMALL_SIDE_ROWS if max_rows is None else max_rows
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return spark.createDataFrame(rows, schema=df.schema).coalesce(1)


def settled(df: DataFrame, name: str, max_rows: int | None = None) -> DataFrame:
    """A table that later steps read several times: local when small, written out otherwise."""
    small = small_side(df, max_rows)
    return written(df, name) if small is df else small


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over the tasks of a shuffle, for steps that make many rows or hashes of each: a small file is scanned by one task."""
    spark = df.sparkSession
    return df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def hex_digits(spark: SparkSession, most: int = 6) -> int:
    """Hex digits of a hash prefix that give several buckets per shuffle partition."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(1, math.ceil(math.log(4 * partitions, 16))))


def same(left, right):
    """Null-safe equality, so that rows with a null key keep their match."""
    return left.eqNullSafe(right)
