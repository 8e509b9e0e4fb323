"""Dictionaries of phrases: which lists' phrases a text holds, by one join on hashed runs of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import word_grams


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def phrase_hits(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, list, phrases, weight): the lists of phrases(list, domain, phrase, weight) of which docs(id, domain, text) hold phrases.

    A phrase is a run of whole words. Phrases without a domain hold for all documents, except those of a domain that has
    phrases of that list itself: these override them. phrases counts distinct phrases, weight sums their weights. Rows
    without hits have no rows; repeated phrases count once, with their largest weight; phrases without words fit nothing.

    Every run of as many words as some phrase has is hashed once, however many phrases there are.
    """
    known = phrases.select("list", "domain", tokens(F.col("phrase")).alias("w"), F.coalesce("weight", F.lit(1.0)).alias("weight")).where(F.size("w") > 0)
    lengths = sorted(r.n for r in known.select(F.size("w").alias("n")).distinct().collect())  # a few small numbers
    known = known.groupBy("list", "domain", F.xxhash64(F.array_join("w", " ")).alias("gram")).agg(F.max("weight").alias("weight"))
    rows = docs.select("id", "domain", tokens(F.col("text")).alias("w"))
    if not lengths:
        return rows.where("false").select("id", F.lit("").alias("list"), F.lit(0).cast("long").alias("phrases"), F.lit(0.0).alias("weight"))
    runs = lambda n: F.transform(word_grams(F.col("w"), n), lambda g: F.xxhash64(g))
    each = rows.select("id", "domain", F.explode(F.array_distinct(F.concat(*map(runs, lengths)))).alias("gram"))
    own = known.where("domain is not null").select("list", "domain").distinct()
    general = each.join(known.where("domain is null").drop("domain"), "gram")
    general = general.join(own, ["list", "domain"], "left_anti")
    special = each.join(known.where("domain is not null"), ["gram", "domain"])
    hits = general.select("id", "list", "gram", "weight").unionByName(special.select("id", "list", "gram", "weight"))
    return hits.groupBy("id", "list").agg(F.count(F.lit(1)).alias("phrases"), F.sum("weight").alias("weight"))


def without_listed(docs: DataFrame, phrases: DataFrame, least: int = 1) -> DataFrame:
    """The rows of docs(id, domain, text, ...) that hold fewer than least phrases of every list."""
    return docs.join(phrase_hits(docs, phrases).where(F.col("phrases") >= least).select("id").distinct(), "id", "left_anti")
