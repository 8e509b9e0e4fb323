"""Landed feeds: reading dumps, the best body of an entry, filter chains, and deduplication against what is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import collapse, normalise_url, strip_html
from tidewater.operators.filters import contains_any, ingest_reject_reason

ENTRY = "feed_id string, title string, link string, published string, summary string, description string, content array<struct<value:string>>"


def read_feed_dump(spark: SparkSession, path: str, feed_id: str | None = None) -> DataFrame:
    """Entries of landed JSON lines; of one feed only if asked, which prunes files where the dump is partitioned by feed."""
    rows = spark.read.schema(ENTRY).json(path)
    return rows if feed_id is None else rows.where(F.col("feed_id") == feed_id)


def entry_body() -> Column:
    """The longest text of an entry: full content, then description, then summary."""
    parts = F.array(F.array_join("content.value", "\n"), F.col("description"), F.col("summary"))
    clean = F.transform(F.array_compact(parts), strip_html)
    return F.reduce(clean, F.lit(""), lambda best, c: F.when(F.length(c) > F.length(best), c).otherwise(best))


def filter_chain(rows: DataFrame, text: Column, url: Column, whitelist: Sequence[str] = (), blacklist: Sequence[str] = (), exclude_url: Sequence[str] = (), include_url: Sequence[str] = ()) -> DataFrame:
    """Any word of the whitelist, none of the blacklist, then URL exclusion and inclusion; empty lists pass all."""
    if whitelist:
        rows = rows.where(contains_any(text, whitelist))
    if blacklist:
        rows = rows.where(~contains_any(text, blacklist))
    if exclude_url:
        rows = rows.where(~contains_any(url, exclude_url))
    return rows.where(contains_any(url, include_url)) if include_url else rows


def new_entries(entries: DataFrame, stored: DataFrame, days: int = 7) -> DataFrame:
    """Entries whose URL was never stored and whose title wasn't within so many days before; one row for each URL.

    Both tables hold url, title and at. URLs are compared normalised, titles by their lower-case hash.
    """
    key = lambda df: df.withColumn("_u", normalise_url(F.col("url"))).withColumn("_t", F.md5(F.lower(collapse("title"))))
    rows = key(entries).join(key(stored).select("_u").where("_u is not null").distinct(), "_u", "left_anti")
    recent = key(stored).select("_t", F.col("at").alias("_at"))
    rows = rows.join(recent, (rows["_t"] == recent["_t"]) & (F.col("_at") >= F.col("at") - F.make_dt_interval(F.lit(days))) & (F.col("_at") <= F.col("at")), "left_anti")
    first = rows.groupBy("_u").agg(F.min_by(F.struct(*entries.columns), F.struct("at", "_t")).alias("r"))
    return first.select("r.*")


def gated(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries that pass the ingest gates, and the refused with their reason."""
    judged = entries.withColumn("reject_reason", ingest_reject_reason(F.col("title"), F.col("body"), F.col("url")))
    return judged.where("reject_reason is null").drop("reject_reason"), judged.where("reject_reason is not null")


def union_domains(parts: dict[str, DataFrame], column: str = "domain_key") -> DataFrame:
    """The same table of several domains as one, with the domain's name; missing columns are null."""
    tagged = [df.withColumn(column, F.lit(name)) for name, df in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def backfill(articles: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """Articles without a context."""
    return articles.join(linked.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
