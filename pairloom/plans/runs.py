"""The three runs of the toolkit: train a version, score with it, stack several versions.

Every run reads tables below one folder layout and leaves tables there, so a run can be repeated
or continued on another cluster:

    <output>/runs/<version>          settings of a version; claimed first, committed once everything else stands
    <output>/oof/version=<v>         out-of-fold predictions
    <output>/models/version=<v>      one fitted model for each fold
    <output>/test/version=<v>        test predictions, a column for each fold model
    <output>/submission/<name>       final scores
    <output>/stack/<name>            leaderboard, best-model marker, grids with summaries and curves, meta-models
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.config import RunConfig, StackConfig
from pairloom.functions import arrays, metrics
from pairloom.operators import dictionary, distribution, enrich, vocabulary
from pairloom.operators.evaluation import row_mean
from pairloom.operators.rank_cuts import assign_folds
from pairloom.plans import base_models, stacking
from pairloom.sources import claims, schemas, tables
from pairloom.streaming import scoring


SETTINGS = (
    "version string, model string, link string, use_class_text boolean, use_mentions boolean, folds array<int>, settings string"
)


@dataclass(frozen=True)
class Inputs:
    """Paths of the input tables and of the output folder."""

    train: str
    test: str
    sections: str
    classes: str
    output: str
    translated: str | None = None
    translated_sections: str | None = None
    translated_classes: str | None = None


class VersionExists(Exception):
    """The version was trained before; choose another name."""


def _enriched(pairs: DataFrame, sections: str, classes: str, config: RunConfig) -> DataFrame:
    spark = pairs.sparkSession
    class_table = tables.read_csv(spark, classes, schemas.CLASSES) if config.use_class_text else None
    joined = enrich.enrich(pairs, tables.read_csv(spark, sections, schemas.SECTIONS), class_table)
    if class_table is None:
        none = F.lit(None).cast("string")
        return joined.withColumns({name: none for name in enrich.CLASS_COLUMNS.values()})
    return joined


def _text_columns(config: RunConfig) -> list[str]:
    columns = ["anchor", "target", "text_grp_1"]
    columns += ["text_grp_2"] if config.use_class_text else []
    return columns + (["context", "mentioned_groups_grp_2"] if config.use_mentions else [])


def training_rows(spark: SparkSession, inputs: Inputs, config: RunConfig) -> DataFrame:
    """Labelled rows with folds, context texts, model text and class number.

    Folds are assigned on the narrow rows, translated ones among them; each language then gets
    its own context texts.
    """
    rows = tables.read_csv(spark, inputs.train, schemas.PAIRS_TRAIN)
    if inputs.translated is not None:
        other = tables.read_csv(spark, inputs.translated, schemas.PAIRS_TRAIN)
        marked = other.withColumns({"id": F.concat("id", F.lit(":translated")), "translated": F.lit(True)})
        rows = dictionary.with_translated(rows, marked)
    if config.sample_rows is not None:
        rows = distribution.sample_rows(rows, config.sample_rows, seed=config.seed)
    folded = assign_folds(rows, "score", config.n_folds, config.seed)
    if inputs.translated is None:
        enriched = _enriched(folded, inputs.sections, inputs.classes, config)
    else:
        own = folded.filter(F.col("translated").isNull())
        foreign = folded.filter(F.col("translated"))
        sections = inputs.translated_sections or inputs.sections
        classes = inputs.translated_classes or inputs.classes
        enriched = _enriched(own, inputs.sections, inputs.classes, config).unionByName(
            _enriched(foreign, sections, classes, config)
        )
    texts = enrich.with_model_text(enriched, config.use_class_text, config.use_mentions)
    return texts.withColumn("score_map", arrays.class_of_score("score"))


def train_version(
    spark: SparkSession,
    inputs: Inputs,
    config: RunConfig,
    model: str = "linear",
    link: str = "identity",
    stale_after: float | None = None,
) -> DataFrame:
    """Train the fold models of a version; the result is its score for each fold and overall.

    Of several runs with the same version one trains. A run that broke off leaves its claim, which another one takes over if
    it is at least ``stale_after`` seconds old.
    """
    estimator = base_models.estimator(model)
    row = (config.version, model, link, config.use_class_text, config.use_mentions, list(config.run_folds), str(config))
    settings = spark.createDataFrame([row], SETTINGS)
    own = claims.claim(spark, f"{inputs.output}/runs/{config.version}", stale_after)
    if own is None:
        raise VersionExists(config.version)
    rows = training_rows(spark, inputs, config)
    oof, models = base_models.cross_validate(
        base_models.with_features(rows), estimator, config.run_folds, config.version, link
    )
    base_models.save_models(models, f"{inputs.output}/models", config.version)
    oof.select(*schemas.OOF.fieldNames()).drop("version").write.mode("overwrite").parquet(
        f"{inputs.output}/oof/version={config.version}"
    )
    settings.write.parquet(own.attempt)
    own.commit()
    scored = oof.rollup("fold").agg(metrics.pearson(F.col("score"), F.col("pred")).alias("pearson"))
    return scored.withColumn("version", F.lit(config.version))


def data_report(spark: SparkSession, inputs: Inputs, config: RunConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Missing rates, codes without a class text, and the token budget of the training rows."""
    rows = training_rows(spark, inputs, config)
    columns = ["text_grp_1", "text_grp_2", "mentioned_groups_grp_2"]
    return (
        rows.agg(*enrich.missing_rate(columns)),
        enrich.missing_codes(rows),
        vocabulary.token_budget(rows, _text_columns(config)),
    )


def stored_settings(spark: SparkSession, inputs: Inputs, version: str):
    """What a version was trained with: model, link, flags and folds; an error until its run has committed."""
    if not claims.committed(spark, f"{inputs.output}/runs/{version}"):
        raise ValueError(f"version {version!r} is not trained")
    return spark.read.schema(SETTINGS).parquet(f"{inputs.output}/runs/{version}").first()


def version_predictions(pairs: DataFrame, inputs: Inputs, version: str) -> DataFrame:
    """id and one prediction for each stored fold model of a version, by its own link and flags; ``pairs`` may be a stream."""
    own = stored_settings(pairs.sparkSession, inputs, version)
    config = RunConfig(version, use_class_text=own.use_class_text, use_mentions=own.use_mentions)
    texts = enrich.with_model_text(
        _enriched(pairs, inputs.sections, inputs.classes, config), config.use_class_text, config.use_mentions
    )
    models = base_models.load_models(f"{inputs.output}/models", version, tuple(own.folds))
    return base_models.fold_predictions(base_models.with_features(texts), models, own.link)


def score_arriving(arriving: DataFrame, inputs: Inputs, version: str, path: str, progress: str) -> DataFrame:
    """Score the pairs that have arrived since the last call with a version's stored fold models; the result is the whole table.

    ``progress`` is the checkpoint of the stream: a call that broke off is taken up there, and no pair is scored twice.
    """
    folds = list(stored_settings(arriving.sparkSession, inputs, version).folds)
    wide = version_predictions(arriving, inputs, version)
    scored = wide.select("id", row_mean([f"pred_{fold}" for fold in folds]).alias("score"))
    return scoring.append_available(scored, path, progress)


def predict_version(spark: SparkSession, inputs: Inputs, version: str) -> DataFrame:
    """Score the test rows with all fold models of a version, by its own link and flags; the row mean is the submission."""
    own = stored_settings(spark, inputs, version)
    wide = version_predictions(tables.read_csv(spark, inputs.test, schemas.PAIRS_TEST), inputs, version)
    path = f"{inputs.output}/test/version={version}"
    wide.write.mode("errorifexists").parquet(path)
    stored = spark.read.schema(wide.schema).parquet(path)
    submission = stored.select("id", row_mean([f"pred_{fold}" for fold in own.folds]).alias("score"))
    target = f"{inputs.output}/submission/{version}"
    tables.write_csv(submission, target)
    return tables.read_csv(spark, target, schemas.SUBMISSION)


def test_matrix(spark: SparkSession, inputs: Inputs, versions: list[str], folds: list[int]) -> DataFrame:
    """The stored test predictions, one column for each version and fold; versions meet by id."""
    schema = "id string, " + ", ".join(f"pred_{fold} double" for fold in folds)
    parts = [
        spark.read.schema(schema)
        .parquet(f"{inputs.output}/test/version={version}")
        .withColumnsRenamed({f"pred_{fold}": f"{version}_fold_{fold}" for fold in folds})
        for version in versions
    ]
    return reduce(lambda left, right: left.join(right, "id"), parts)


def stack_versions(
    spark: SparkSession, inputs: Inputs, config: StackConfig, folds: list[int], name: str = "stack"
) -> DataFrame:
    """Meta-training over stored predictions: leaderboard, marker, grids, curves and meta-models, and the submission."""
    versions = list(config.versions)
    long = tables.read_versions(spark, f"{inputs.output}/oof", versions).filter(F.col("fold").isin(folds))
    stack = stacking.train_stack(stacking.combined_oof(long, versions), config)
    tables.write_csv(stack.mean_scores.orderBy("dataset", "model"), f"{inputs.output}/stack/{name}/leaderboard")
    tables.write_marker(stack.best, f"{inputs.output}/stack/{name}/best")
    stacking.save_stack(stack, f"{inputs.output}/stack/{name}")
    return predict_stack(spark, inputs, config, folds, name)


def predict_stack(spark: SparkSession, inputs: Inputs, config: StackConfig, folds: list[int], name: str = "stack") -> DataFrame:
    """The stacked submission from stored meta-models; no training, any session."""
    versions = list(config.versions)
    stack = stacking.load_stack(spark, f"{inputs.output}/stack/{name}")
    target = f"{inputs.output}/submission/{name}"
    scores = stacking.stacked_scores(test_matrix(spark, inputs, versions, folds), stack, versions, folds)
    tables.write_csv(scores, target, mode="overwrite")
    return tables.read_csv(spark, target, schemas.SUBMISSION)
