import pytest
from pyspark.sql import functions as F

from pairloom.config import ElasticNetGrid, ForestGrid, RunConfig, StackConfig
from pairloom.plans import runs, stacking
from pairloom.session import scratch_path
from pairloom.sources import claims, schemas, tables, views
from pairloom.streaming import scoring


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    base = scratch_path(spark, "runs")
    paths = {name: f"{base}/{name}" for name in ("train", "test", "sections", "classes", "translated")}
    pairs = views.pairs(spark, sf_dir).select(*schemas.PAIRS_TRAIN.fieldNames())
    tables.write_csv(pairs, paths["train"])
    tables.write_csv(pairs.withColumn("anchor", F.upper("anchor")), paths["translated"])
    tables.write_csv(views.test_pairs(spark, sf_dir), paths["test"])
    tables.write_csv(views.sections(spark, sf_dir), paths["sections"])
    tables.write_csv(views.classes(spark, sf_dir), paths["classes"])
    return runs.Inputs(output=f"{base}/out", **paths)


def check_stream(spark, inputs, version):
    """Pairs that arrive in parts, in a stream that is stopped and taken up again, are scored once, as in batch."""
    base = scratch_path(spark, "arriving")
    test = tables.read_csv(spark, inputs.test, schemas.PAIRS_TEST).orderBy("id")
    rows = test.collect()

    def arrive(part):
        spark.createDataFrame(part, schemas.PAIRS_TEST).repartition(2).write.mode("append").parquet(f"{base}/in")

    def score():
        return runs.score_arriving(arriving, inputs, version, f"{base}/out", f"{base}/progress")

    arrive(rows[:40])
    arriving = spark.readStream.schema(schemas.PAIRS_TEST).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    assert score().count() == 40
    assert score().count() == 40  # nothing new
    arrive(rows[40:90])
    stop_in_the_middle(arriving, inputs, version, base)
    arrive(rows[90:])
    found = {row.id: row.score for row in score().collect()}
    assert score().count() == len(rows) == len(found)
    batch = tables.read_csv(spark, f"{inputs.output}/submission/{version}", schemas.SUBMISSION)
    want = {row.id: row.score for row in batch.collect()}
    assert found == pytest.approx(want, abs=1e-12)


def stop_in_the_middle(arriving, inputs, version, base):
    """A batch fails after some of its rows: its files stay, but not in the table's log."""
    wide = runs.version_predictions(arriving, inputs, version)
    broken = F.when(F.hash("id") % 5 == 0, F.raise_error(F.lit("executor lost")).cast("double")).otherwise(F.lit(0.0))
    with pytest.raises(Exception, match="executor lost"):
        scoring.append_available(wide.select("id", broken.alias("score")), f"{base}/out", f"{base}/progress")


def test_broken_training_is_taken_over(spark, sf_dir, inputs):
    """A run that broke off leaves a claim and parts of its output; the next one replaces them."""
    from dataclasses import replace

    plain = replace(inputs, translated=None)
    config = RunConfig(version="three", n_folds=2)
    own = claims.claim(spark, f"{plain.output}/runs/three")
    spark.range(2).write.parquet(f"{plain.output}/oof/version=three")
    with pytest.raises(runs.VersionExists):
        runs.train_version(spark, plain, config)
    with pytest.raises(ValueError, match="not trained"):
        runs.predict_version(spark, plain, "three")
    assert runs.train_version(spark, plain, config, stale_after=0).count() == 3
    assert not own.held()
    assert tables.read_versions(spark, f"{plain.output}/oof", ["three"]).filter("pred IS NOT NULL").count() == 1500


def test_train_predict_stack(spark, inputs):
    from dataclasses import replace

    plain = replace(inputs, translated=None)
    for version, link in (("one", "identity"), ("two", "sigmoid")):
        config = RunConfig(version=version, n_folds=2, use_class_text=version == "one")
        scores = runs.train_version(spark, plain, config, "linear", link).collect()
        assert {row.fold for row in scores} == {0, 1, None} and all(row.pearson > 0.8 for row in scores)
        assert runs.stored_settings(spark, plain, version).link == link
        submission = runs.predict_version(spark, plain, version)
        assert submission.count() == submission.select("id").distinct().count() == 150
    linked = tables.read_csv(spark, f"{plain.output}/submission/two", schemas.SUBMISSION)
    assert linked.filter("score <= 0.4 OR score >= 0.8").count() == 0  # a sigmoid of scores between 0 and 1
    with pytest.raises(runs.VersionExists):
        runs.train_version(spark, plain, RunConfig(version="one", n_folds=2))
    check_stream(spark, plain, "two")
    config = StackConfig(
        ("one", "two"),
        n_splits=2,
        elastic_net=ElasticNetGrid(alpha=(0.0, 0.2)),
        forest=ForestGrid(n_estimators=(5,), max_depth=(2, 3), min_samples_split=(2,)),
    )
    final = {row.id: row.score for row in runs.stack_versions(spark, plain, config, [0, 1]).collect()}
    assert len(final) == 150 and None not in final.values()
    place = f"{plain.output}/stack/stack"
    marker = tables.read_marker(spark, f"{place}/best").first()
    assert marker.best_model in ("en", "rf", "one", "two")
    assert tables.read_csv(spark, f"{place}/leaderboard", schemas.LEADERBOARD).count() == 8
    # Stored models give the same scores without training, whichever wins.
    again = runs.predict_stack(spark.newSession(), plain, config, [0, 1])
    assert {row.id: row.score for row in again.collect()} == final
    stack = stacking.load_stack(spark, place)
    assert set(stack.forests) == {0, 1}
    matrix = runs.test_matrix(spark, plain, ["one", "two"], [0, 1])
    for winner in ("en", "rf"):
        chosen = replace(stack, best=spark.createDataFrame([(winner,)], "model string"))
        assert stacking.stacked_scores(matrix, chosen, ["one", "two"], [0, 1]).filter("score IS NOT NULL").count() == 150
    for kind, settings, axes in (("linear", 2 * 2 * 6, 2), ("forest", 2, 3)):
        summary = spark.read.parquet(f"{place}/grid/{kind}/summary")
        assert summary.count() == 2 * settings * 2
        curves = spark.read.parquet(f"{place}/grid/{kind}/curves")
        assert curves.select("metric", "param").distinct().count() == 4 * axes
        assert curves.filter("part = 'band'").count() == 2 * curves.filter("part = 'line' AND sample = 'test'").count()


def test_translated_rows_join_the_training_set(spark, inputs):
    rows = runs.training_rows(spark, inputs, RunConfig(n_folds=2, use_mentions=True))
    assert rows.count() == 3000
    assert rows.filter("anchor = upper(anchor)").count() >= 1500


def test_debug_run_takes_a_sample(spark, inputs):
    from dataclasses import replace

    rows = runs.training_rows(spark, replace(inputs, translated=None), RunConfig.debug())
    assert rows.count() == 200 and rows.select("fold").distinct().count() == 2


def test_report(spark, inputs):
    from dataclasses import replace

    rates, codes, budget = runs.data_report(spark, replace(inputs, translated=None), RunConfig())
    assert rates.first().missing_text_grp_1 == 0 and 0 < rates.first().missing_text_grp_2 < 1
    assert codes.count() == 4
    assert budget.first().max_len > 4


def test_without_class_text(spark, inputs):
    from dataclasses import replace

    rows = runs.training_rows(spark, replace(inputs, translated=None), RunConfig(use_class_text=False))
    assert rows.filter("text LIKE '%; %'").count() == 0
