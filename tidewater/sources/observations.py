"""Observation series: values as text with a mark for missing, several sources for one series, request windows, filings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_observations(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is a number; the mark for a missing value, a point, is none."""
    return rows.withColumn(value, F.expr(f"try_cast({value} as double)")).where(F.col(value).isNotNull())


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """(date, value, realtime_start, realtime_end) of landed responses."""
    body = spark.read.schema("observations array<struct<date:string,value:string,realtime_start:string,realtime_end:string>>").option("multiLine", True).json(path)
    rows = body.select(F.explode("observations").alias("o")).select(F.to_date("o.date").alias("date"), "o.value", "o.realtime_start", "o.realtime_end")
    return parse_observations(rows)


def request_windows(spark: SparkSession, start: str, end: str, days: int = 30) -> DataFrame:
    """(start, end) pieces of a range, each at most so many days long."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.make_dt_interval(F.lit(days)))).alias("start"))
    return one.select("start", F.least(F.date_add("start", days - 1), F.lit(end).cast("date")).alias("end"))


def unified(rows: DataFrame, order: Sequence[str], unit: str | None = None) -> DataFrame:
    """For each date the value of the first source in order, rows of the wanted unit before others."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    place = F.when(place > 0, place).otherwise(len(order) + 1)
    other = F.lit(0) if unit is None else (~F.col("unit").eqNullSafe(F.lit(unit))).cast("int")
    first = F.row_number().over(Window.partitionBy("date").orderBy(other, place, "source"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def latest_value(value: Column, at: Column) -> Column:
    """Aggregate: the newest value that isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), at))


ITEMS = {"item_1": ("1", "1A"), "item_7": ("7", "7A"), "item_8": ("8", "9")}


def filing_items(text: Column) -> Column:
    """Map of a filing's main items to their text, from one heading to the next; missing items are left out."""
    between = lambda a, b: F.regexp_extract(text, rf"(?is)\bitem\s+{a}\b[.:\s-]*(.*?)(?=\bitem\s+{b}\b|\z)", 1)
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), between(a, b).alias("value")) for k, (a, b) in ITEMS.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: F.trim(p["value"]) != ""))


def sections(text: Column, heading: str = r"(?m)^(?:[0-9]+(?:\.[0-9]+)*\.?\s+)?[A-Z][A-Z \t]{3,60}$") -> Column:
    """Headings of a text and what follows each, as an array of (title, body)."""
    titles = F.regexp_extract_all(text, F.lit(heading), F.lit(0))
    bodies = F.slice(F.split(text, heading, -1), 2, 1_000_000)
    return F.zip_with(titles, bodies, lambda t, b: F.struct(F.trim(t).alias("title"), F.trim(b).alias("body")))
