"""Retrieval: keyword and vector search, score fusion, reranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def keyword_search(df: DataFrame, column: str, terms: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """Rows that hold any of the terms, by how many they hold and then by order; adds hits. limit is the report's size."""
    low = F.lower(F.col(column))
    hits = sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))
    return df.withColumn("hits", hits).where("hits > 0").orderBy(F.col("hits").desc(), *order).limit(limit)


def with_margin(ranked: DataFrame, high: float, sure: float, margin: float) -> DataFrame:
    """First hits with the lead over the second, and whether they are accepted: similar enough, and ahead or nearly equal to one."""
    following = F.lead("similarity").over(Window.partitionBy("query_id").orderBy("rank"))
    first = ranked.withColumn("second", following).where("rank = 1").withColumn("lead", F.col("similarity") - F.coalesce("second", F.lit(0.0)))
    accepted = (F.col("similarity") >= high) & ((F.col("similarity") >= sure) | (F.col("lead") >= margin))
    return first.withColumn("accepted", accepted).select("query_id", "vec_id", "similarity", "lead", "accepted")


def hybrid_merge(keyword: DataFrame, semantic: DataFrame, alpha: float, limit: int) -> DataFrame:
    """(id, keyword_score, semantic_score, score): outer merge of keyword(id, rank) and semantic(id, score).

    The n keyword hits score 1 - (rank - 1) / n; a missing score is zero.
    """
    n = keyword.agg(F.count(F.lit(1)).alias("n"))
    k = keyword.crossJoin(F.broadcast(n)).select("id", (1 - (F.col("rank") - 1) / F.col("n")).alias("keyword_score"))
    met = k.join(semantic.select("id", F.col("score").alias("semantic_score")), "id", "full_outer").na.fill(0.0, ["keyword_score", "semantic_score"])
    score = alpha * F.col("semantic_score") + (1 - alpha) * F.col("keyword_score")
    return met.withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(limit)


def adaptive_cutoff(df: DataFrame, score: str, floor: float, share: float = 0.82, least: int = 4) -> DataFrame:
    """Rows that reach the larger of floor and a share of the best score; with fewer rows than least, all that reach floor."""
    stats = df.agg(F.max(score).alias("_best"), F.count(F.lit(1)).alias("_n"))
    bound = F.when(F.col("_n") >= least, F.greatest(F.lit(floor), share * F.col("_best"))).otherwise(F.lit(floor))
    return df.crossJoin(F.broadcast(stats)).where(F.col(score) >= bound).drop("_best", "_n")


def best_clusters(rows: DataFrame, features: str, most: int = 10, seed: int = 42) -> tuple[int, DataFrame]:
    """The number of k-means clusters from 2 to most, or half the rows, with the best silhouette, and rows with a column cluster.

    features is a vector column without nulls. Of equal silhouettes the smaller number wins. Fewer than four rows make
    one cluster. Every fit and every silhouette is a job over all rows; keep rows in a table or cache.
    """
    top = min(most, rows.count() // 2)
    if top < 2:
        return 1, rows.withColumn("cluster", F.lit(0))
    judge = ClusteringEvaluator(featuresCol=features, predictionCol="cluster")
    best = None
    for k in range(2, top + 1):
        found = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(rows).transform(rows)
        # rows that are all alike end up in one cluster, which has no silhouette
        score = judge.evaluate(found) if found.select("cluster").distinct().count() > 1 else -1.0
        if best is None or score > best[0]:
            best = score, k, found
    return best[1], best[2]
