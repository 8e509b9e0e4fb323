"""Upserts as set operations: newest row by key, and monotone merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """target with the rows of source inserted or put in place of those with equal keys.

    Of several source rows with one key the first by order stays; without an order they fail the query. Keys compare
    null-safely. Write the result to a new place and swap: it reads its own target.
    """
    if not order:
        times = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        source = source.withColumn("_n", F.when(times > 1, F.raise_error(F.lit("several source rows have one key: give an order")).cast("long"))).where("_n is null").drop("_n")
    else:
        source = source.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    both = target.withColumn("_new", F.lit(0)).unionByName(source.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_new").desc()))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_new")


def monotone_upsert(rows: DataFrame, key: str, seq: str, confidence: str = "confidence", evidence: str = "evidence", summary: str = "summary") -> DataFrame:
    """Folds arrivals by key: the highest confidence, the evidence that came with it (the later of equals), the last summary that isn't null."""
    return rows.groupBy(key).agg(
        F.max(confidence).alias(confidence),
        F.max_by(evidence, F.struct(confidence, seq)).alias(evidence),
        F.max_by(summary, F.when(F.col(summary).isNotNull(), F.col(seq))).alias(summary),
        F.count(F.lit(1)).alias("arrivals"),
    )
