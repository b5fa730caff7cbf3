"""The training-corpus pipeline: each stage is one operator, written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import mixing, packing, secret_scan, simhash, toxicity
from quillstone.llm.common import cut, drop_cut, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by marks; no document goes."""
    return secret_scan.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights: a document stands there once for each time it is taken, in training order."""
    return mixing.training_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in which training sequence; sequences, by their ids, keep the order of mixing."""
    return packing.pack_digests(docs)


STAGES = [("toxicity", toxicity_stage), ("simhash", simhash_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
ORACLE_SQL = None  # neither the fitted grammar nor the tokenizer can be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents in turn."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
