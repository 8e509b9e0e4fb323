"""Ranked retrieval from a stored index: posting lists in buckets by term, with the best score that each block can give.

The index is written once and answers any number of queries. A query reads the buckets of its terms alone, and of those
the blocks of documents whose best possible score reaches the k-th best found so far.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions.stem import porter, vocabulary
from tidewater.operators.work import map_batches, written

K1, B = 1.2, 0.75
FIRST_BLOCKS = 4  # blocks of each query that are scored to get a bound for the others


@dataclass
class Index:
    """Where postings(bucket, term, block, id, n, tf) and blocks(bucket, term, block, most, held) lie, with the number of documents and their mean length.

    n is a document's length, tf how often it holds the term; most is the largest share() in a block, held its number of postings.
    """

    path: str
    buckets: int
    stemmed: bool
    id_type: str
    docs: int
    mean: float

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        own = f"id {self.id_type}, n long, tf long" if name == "postings" else "most double, held long"
        return spark.read.schema(f"term string, block long, {own}, bucket int").parquet(f"{self.path}/{name}")

    def idf(self, df: Column) -> Column:
        return F.log(1 + (F.lit(float(self.docs)) - df + 0.5) / (df + 0.5))

    def share(self, factor: Column) -> Column:
        """factor times a posting's part of a BM25 score; with the idf it is the whole."""
        return factor * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(self.mean)))


def tokens(text: Column) -> Column:
    """Lower-case runs of two letters or digits and more."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def _stemmed(rows: DataFrame) -> DataFrame:
    """rows with their column word replaced by its stem, which is worked out once for each distinct word."""
    known = written(vocabulary(rows), "vocabulary")
    return rows.join(known, "word").withColumn("word", F.col("stem")).drop("stem")


_WORD, _LETTERS = re.compile("[a-z0-9]{2,}"), re.compile("[a-z]+")


@lru_cache(1 << 18)
def _stem(word: str) -> str:
    return porter(word) if _LETTERS.fullmatch(word) else word


def _counted(docs: DataFrame, stemmed: bool) -> DataFrame:
    """(id, n, term, tf) of docs(id, text): the tokens of each text counted where it is read, so that nothing but these rows is shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lengths, terms, counts = [], [], [], []
            for text in batch.column("low").to_pylist():
                found = Counter(_WORD.findall(text))
                length = found.total()
                if stemmed:
                    merged = Counter()
                    for word, n in found.items():
                        merged[_stem(word)] += n
                    found = merged
                sizes.append(len(found))
                lengths.append(length)
                terms += found.keys()
                counts += found.values()
            at = np.repeat(np.arange(batch.num_rows), sizes)
            held = [batch.column("id").take(pa.array(at)), pa.array(np.repeat(np.array(lengths, np.int64), sizes)), pa.array(terms, pa.string()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(held, names=["id", "n", "term", "tf"])

    low = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    return map_batches(low, task, f"id {docs.schema['id'].dataType.simpleString()}, n long, term string, tf long")


def build(docs: DataFrame, path: str, stemmed: bool = True, buckets: int = 64, block_rows: int = 4096) -> Index:
    """Writes the index of docs(id, text) to path, a new folder that all executors reach.

    Blocks hold about block_rows documents, dealt by a hash of their ids. Documents without tokens count in the mean
    length but have no postings. Postings hold counts, not weights, so they are shuffled and written once: how rare a
    term is follows from its blocks when it is asked for.
    """
    spark = docs.sparkSession
    size = docs.select("id").count()
    index = Index(path, buckets, stemmed, docs.schema["id"].dataType.simpleString(), size, 1.0)
    blocks = max(1, -(-size // block_rows))
    posted = _counted(docs, stemmed).withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "block": F.pmod(F.xxhash64("id"), F.lit(blocks))})
    # a bucket with a hot term is dealt out by block, where rows of one id and length meet too and are one document; sorted
    # by term, so that footers tell which parts hold it
    posted = posted.repartition("bucket", "block").groupBy("bucket", "block", "term", "id", "n").agg(F.sum("tf").alias("tf"))
    posted = posted.select("term", "block", "id", "n", "tf", "bucket").sortWithinPartitions("bucket", "term", "block")
    posted.write.partitionBy("bucket").parquet(f"{path}/postings")
    posted = index.read(spark, "postings")
    total = posted.agg(F.sum("tf").alias("total")).first().total
    index.mean = (total or 0) / max(size, 1) or 1.0
    most = posted.groupBy("bucket", "term", "block").agg(F.max(index.share(F.lit(1.0))).alias("most"), F.count(F.lit(1)).alias("held"))
    most.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/blocks")
    return index


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k best documents of queries(query_id, text), ties to the smaller id.

    Scores count to nine decimals. Documents that share no term with a query aren't found by it.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("word"))
    asked = (_stemmed(asked) if index.stemmed else asked).distinct()
    bucket = F.pmod(F.xxhash64("word"), F.lit(index.buckets)).cast("int")
    asked = written(asked.select("query_id", bucket.alias("bucket"), F.col("word").alias("term")), "asked")
    lists = written(index.read(spark, "blocks").join(asked.select("bucket", "term").distinct(), ["bucket", "term"]), "lists")
    rare = lists.groupBy("bucket", "term").agg(index.idf(F.sum("held")).alias("idf"))
    asked = written(asked.join(rare, ["bucket", "term"]), "rare")
    bounds = asked.join(lists, ["bucket", "term"])
    per = written(bounds.groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("most")), "bounds")
    order = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "block")
    first = written(per.withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIRST_BLOCKS).select("query_id", "block"), "first")

    def scored(wanted: DataFrame) -> DataFrame:
        met = asked.join(wanted, "query_id").join(index.read(spark, "postings"), ["bucket", "term", "block"])
        return met.groupBy("query_id", "id").agg(F.round(F.sum(index.share(F.col("idf"))), 9).alias("score"))

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    early = written(scored(first), "early")
    ranked = early.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    least = ranked.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = per.join(first, ["query_id", "block"], "left_anti").join(least, "query_id", "left")
    rest = written(rest.where(F.col("least").isNull() | (F.col("most") >= F.col("least") - 1e-8)).select("query_id", "block"), "rest")
    found = ranked.drop("rank").unionByName(scored(rest))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
