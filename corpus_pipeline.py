"""Corpus preparation: each stage is one operator, applied to what its predecessor kept.

A stage takes the session, the documents and the folder of all tables, and returns documents. ``run`` writes what a stage
returns as Parquet below the shared folder and reads it for the next one, so a lost executor repeats one stage at most.
Tasks of all stages send few bytes to Python at once (``LEAN``): texts are long, and an executor holds them on both sides.
Rows with null ids, null or empty texts and repeated rows pass through every stage by the rules in its operator's docstring.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import ngram_join, source_mix, substring_dedup, token_codes, toxicity
from pairloom.llm.common import BATCH_BYTES, table
from pairloom.llm.pieces import read_tokenizer
from pairloom.session import written

TOKENIZER = "word_bpe_49k.json"
LEAN = {BATCH_BYTES: str(2 << 20)}
CODED_BYTES = 1 << 18  # of texts that token_coding codes together


def lean(stage):
    """``stage`` with ``LEAN`` in its session, which also holds for the job that writes what it returns."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, value in LEAN.items():
            spark.conf.set(key, value)
        return stage(spark, docs, sf_dir)

    return run


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon takes for toxic go."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, lexicon)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand anywhere else go; texts that lose nothing stay as they are."""
    return substring_dedup.without_repeats(docs, size="n_chars")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of every source as often as its target weight asks for."""
    return source_mix.mix(docs)


def token_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and a digest of the text that these decode to."""
    spec = read_tokenizer(public_tokenizers.path(TOKENIZER))
    outputs = ("n_tokens", "ids", "decoded_sha256")
    return token_codes.code_documents(docs, spec, [c for c in docs.columns if c not in outputs], outputs, size=CODED_BYTES)


STAGES = [
    ("toxic_documents", toxic_documents),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("source_mixing", source_mixing),
    ("token_coding", token_coding),
]
STAGES = [(name, lean(stage)) for name, stage in STAGES]

ORACLE_SQL = None  # learned weights and token ids have no counterpart in SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
