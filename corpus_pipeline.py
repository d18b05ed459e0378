"""Corpus pipeline: quality rules, near-duplicate removal, decontamination, redaction of secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. A stage's output is
written as Parquet and read back as the next one's input, so a lost executor costs no more than the running stage.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ability_engine.llm import decontaminate, neardup, packing, quality_rules, secrets
from ability_engine.llm.common import new_path, scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filter_documents(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, linked from a similarity of 0.8 on."""
    return neardup.keep_one(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """All documents, with secrets replaced by a mark. A ledger in a folder of its own outlives the stage: the next run scans only what it lacks."""
    return secrets.redact(docs, secrets.update(docs, ledger or new_path(spark, "ledger")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a training sequence, with its token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't express the fitted model, the tokenizer and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """All stages. ``ledger``: a folder for the ledger of scanned texts that later runs take up again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        if stage is secret_stage and ledger:
            stage = partial(secret_stage, ledger=ledger)
        path, schema = new_path(spark, name.replace(" ", "-")), docs.schema
        with scratch(spark):  # a stage's own tables go once its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
