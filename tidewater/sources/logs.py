"""Log archives: JSON lines to rows, bad lines left out, written by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_entries(lines: DataFrame, line: Column, source: str, at: str = "$.timestamp") -> DataFrame:
    """(source, entry, level, logged_at) of the lines that are JSON objects."""
    rows = lines.select(F.trim(line).alias("entry"))
    rows = rows.where(F.col("entry").startswith("{") & F.try_parse_json("entry").isNotNull())
    return rows.select(F.lit(source).alias("source"), "entry", F.get_json_object("entry", "$.level").alias("level"), F.try_to_timestamp(F.get_json_object("entry", at)).alias("logged_at"))


def read_archive(spark: SparkSession, path: str, source: str) -> DataFrame:
    return parse_entries(spark.read.text(path), F.col("value"), source)


def write_archive(entries: DataFrame, path: str) -> None:
    """Appends by source and day, one partition each, so that later scans prune."""
    entries.withColumn("day", F.to_date("logged_at")).write.mode("append").partitionBy("source", "day").parquet(path)


def level_rollup(entries: DataFrame) -> DataFrame:
    """Entries of each source and day by level."""
    level = F.lower(F.coalesce("level", F.lit("")))
    return entries.groupBy("source", F.to_date("logged_at").alias("day")).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(level == "error").alias("errors"), F.count_if(level.isin("warning", "warn")).alias("warnings"), F.count_if(level == "info").alias("infos")
    )
