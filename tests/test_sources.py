from concurrent.futures import ThreadPoolExecutor

import pytest

from pairloom.session import scratch_path, written
from pairloom.sources import claims, schemas, tables
from pairloom.streaming import meter


def test_csv_round_trip(spark):
    rows = [("12e4", 'say "x", y', " b ", "A01", 0.25), ("2", None, "c\\", "A02", None)]
    df = spark.createDataFrame(rows, schemas.PAIRS_TRAIN)
    path = scratch_path(spark, "csv")
    tables.write_csv(df, path)
    assert sorted(tables.read_csv(spark, path, schemas.PAIRS_TRAIN).collect()) == sorted(df.collect())


def test_line_breaks_in_csv(spark):
    df = spark.createDataFrame([("1", "two\nlines")], "id string, anchor string")
    path = scratch_path(spark, "csv")
    tables.write_csv(df, path, line_breaks=True)
    assert tables.read_csv(spark, path, df.schema, multi_line=True).collect() == df.collect()
    with pytest.raises(Exception, match="line break"):
        tables.write_csv(df, scratch_path(spark, "csv"))


def test_version_is_written_once(spark):
    path = scratch_path(spark, "version")
    assert claims.write_new_version(spark.range(3), path)
    assert not claims.write_new_version(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_one_of_two_writers_wins(spark, monkeypatch, kind):
    if kind == "hadoop":
        monkeypatch.setattr(claims, "_files", lambda session, path: claims._HadoopFiles(session))
    path = scratch_path(spark, "race")
    first, second = claims.claim(spark, path), claims.claim(spark, path)
    assert first is not None and second is None
    assert claims.claim(spark, path, stale_after=3600) is None  # not old enough
    assert not claims.committed(spark, path)
    spark.range(4).write.parquet(first.attempt)
    first.commit()
    assert claims.committed(spark, path) and spark.read.parquet(path).count() == 4
    assert claims.claim(spark, path, stale_after=0) is None  # what is committed stays


def test_many_writers_at_once(spark):
    path = scratch_path(spark, "race")
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda _: claims.claim(spark, path), range(32)))
    assert sum(one is not None for one in made) == 1


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_broken_claim_is_taken_over(spark, monkeypatch, kind):
    if kind == "hadoop":
        monkeypatch.setattr(claims, "_files", lambda session, path: claims._HadoopFiles(session))
    path = scratch_path(spark, "broken")
    slow = claims.claim(spark, path)
    spark.range(1).write.parquet(slow.attempt)
    with ThreadPoolExecutor(4 if kind == "local" else 1) as pool:  # Hadoop's own view of a local disk promises no atomic moves
        taken = [one for one in pool.map(lambda _: claims.claim(spark, path, stale_after=0), range(4)) if one]
    # Each later one may find the claim before it stale again; whoever holds it now commits, the others can't.
    holders = [one for one in taken if one.held()]
    assert len(holders) == 1 and not slow.held()
    spark.range(7).write.parquet(holders[0].attempt)
    holders[0].commit()
    with pytest.raises(claims.ClaimLost):
        slow.commit()
    assert spark.read.parquet(path).count() == 7


def test_commit_that_broke_off_is_completed(spark):
    path = scratch_path(spark, "half")
    own = claims.claim(spark, path)
    spark.range(5).write.parquet(own.attempt)
    own.files.create_new(own.done, own.run)  # and then the run ends
    assert claims.committed(spark, path) and spark.read.parquet(path).count() == 5
    assert claims.claim(spark, path, stale_after=0) is None


def test_versions_are_pruned(spark):
    rows = [("1", 0, 0.5, 0.1, "v"), ("1", 0, 0.5, 0.2, "w")]
    path = scratch_path(spark, "oof")
    tables.write_versioned(spark.createDataFrame(rows, schemas.OOF), path)
    read = tables.read_versions(spark, path, ["w"])
    assert [(row.pred, row.version) for row in read.collect()] == [(0.2, "w")]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "version" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_written_table_keeps_schema(spark):
    df = spark.createDataFrame([(1, [0.5])], "a int, b array<double>")
    assert written(df, "t").collect() == df.collect()


def test_cluster_needs_a_shared_folder(monkeypatch, spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        scratch_path(Session(), "x")


def test_streaming_meter_over_several_files(spark):
    path = scratch_path(spark, "steps")
    rows = [("a", 1.0, 1), ("a", 4.0, 2), ("b", 2.0, 5)]
    spark.createDataFrame(rows, "run string, loss double, n bigint").repartition(3).write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = meter.run_complete(meter.meter_by_key(stream, ["run"])).collect()
    assert {row.run: (row.steps, row.avg) for row in got} == {"a": (2, 3.0), "b": (1, 2.0)}
