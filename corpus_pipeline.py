"""From raw documents to training shards, a stage at a time."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import op2_training_order, op3_language, op4_decontamination, op5_minhash, op8_mixing
from sensorloom.llm.common import scratch, stage, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an unknown language go."""
    return op3_language.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, similarity 0.8."""
    return op5_minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return op4_decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until the sources have their weights."""
    return op8_mixing.mix(docs)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each sequence of tokens lies in the shards."""
    return op2_training_order.training_order(docs, public_tokenizers.path(op2_training_order.MODEL))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("training_order", training_order),
]

#: Trained models, hashes of signatures and tokens are beyond SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages hand on to each other goes when they are there."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        for name, function in STAGES:
            docs = function(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = stage(docs, name)
        return keep(docs, "sequences")
