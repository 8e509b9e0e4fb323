"""Joins beyond equality: bands, overlaps, co-occurrence, nearest earlier match."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.windows import carried
from tidewater.operators.work import written

PART_PAIRS = 2_000_000


def co_occurrence(df: DataFrame, context: str, member: str, least: int = 1) -> DataFrame:
    """(a, b, contexts): pairs of different members that share at least so many contexts.

    Members that occur in fewer than least contexts can't reach it and post nothing. Each context's distinct members meet
    in a self-join, so a pair is counted once for each context. Pairs are dealt into parts of about PART_PAIRS, so what a task
    counts doesn't grow with the rows.
    """
    rows = df.where(F.col(context).isNotNull() & F.col(member).isNotNull()).select(context, member).distinct()
    if least > 1:
        often = rows.groupBy(member).count().where(F.col("count") >= least).select(member)
        rows = rows.join(often, member, "left_semi")
    rows = written(rows, "members")
    met = F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)
    parts = max(1, math.ceil((rows.groupBy(context).count().agg(met).first()[0] or 0) / PART_PAIRS))
    pairs = rows.select(context, F.col(member).alias("a")).join(rows.select(context, F.col(member).alias("b")), context).where("a < b")
    return pairs.select("a", "b").repartition(parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") >= least)


def band_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, days: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of equal keys whose dates lie at most so many days apart.

    Days are cut into bins as wide as the band. The right side is posted to its own bin and both neighbours, which makes
    the range an equi-join and no pair double.
    """
    width = max(1, days)
    bin_of = lambda name: F.floor(F.unix_date(F.to_date(name)) / width).cast("long")
    l = left.withColumn("_bin", bin_of(left_at))  # noqa: E741
    r = right.withColumn("_bin", F.explode(F.array(*(bin_of(right_at) + n for n in (-1, 0, 1)))))
    near = F.abs(F.date_diff(F.to_date(left_at), F.to_date(right_at))) <= days
    return l.join(r, [*keys, "_bin"]).where(near).drop("_bin")


def precision_window(precision: Column) -> Column:
    """Days within which two dates of a precision may be the same."""
    days = {"exact": 1, "week": 7, "month": 31, "quarter": 93, "year": 366}
    out = F.lit(None).cast("int")
    for name, n in days.items():
        out = F.when(precision == name, n).otherwise(out)
    return F.coalesce(out, F.lit(1))


def overlap_pairs(df: DataFrame, owner: str, member: str, least: int) -> DataFrame:
    """(a, b, shared): owners that share at least so many distinct members."""
    return co_occurrence(df.select(F.col(member).alias("_m"), F.col(owner).alias("_o")), "_m", "_o", least).withColumnRenamed("contexts", "shared")


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, columns: Sequence[str]) -> DataFrame:
    """Each left row with the columns of the last right row of its key at or before it; nulls where there is none.

    Both sides go through one ordered pass over ranges of key and time; no row of one side is paired with all of the
    other, and no key's rows all meet in one task. Of right rows of one key and time the greatest in the columns counts.
    """
    l = left.select(key, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))  # noqa: E741
    kind = right.select(F.struct(*columns).alias("_r")).schema["_r"].dataType
    l = l.withColumn("_r", F.col("_r").cast(kind))  # noqa: E741
    r = right.select(key, F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(*columns).alias("_r"))
    both = carried(l.unionByName(r), key, ["_at", "_side", "_r"], "_r").where("_side = 1")
    return both.select("_l.*", *(F.col(f"last.{c}").alias(c) for c in columns))


def anti_chain(df: DataFrame, key: Column, others: Sequence[tuple[DataFrame, Column]]) -> DataFrame:
    """Rows whose normalised key is in none of the other tables."""
    out = df.withColumn("_key", key)
    for other, column in others:
        out = out.join(other.select(column.alias("_key")).where("_key is not null").distinct(), "_key", "left_anti")
    return out.drop("_key")
