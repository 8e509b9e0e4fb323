"""From raw documents to a training mix: toxicity, near-duplicates, benchmark leaks, secrets, and the mix of sources.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Between stages the documents are
written as Parquet to the shared folder and read again, so a lost executor costs one stage at most. Decisions that a
stage makes by row are carried beside the documents' own columns, so rows with a null or repeated doc_id are treated as
rows too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.classify import without_toxic
from tidewater.llm.common import materialize, read_table
from tidewater.llm.decontaminate import without_leaks
from tidewater.llm.mixing import longer_first, mix
from tidewater.llm.near_dedup import without_near_duplicates
from tidewater.llm.secrets import redact_secrets

# toxicity is learned from labels and the near-duplicate and mixing stages hash: no SQL states the rows
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.3 or more; the classifier learns from the labelled rows among docs."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest doc_id."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blanks out live secrets in the texts; copied examples and placeholders stay. No document is dropped."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of the documents that the mix takes, copies times each."""
    return mix(docs, importance=longer_first()).where("copies > 0")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
