"""Ranked and ordered windows. Every ranking takes a full order, so that results don't depend on the partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.work import written


def top_per_group(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group. Spark limits each group before the shuffle as well as after it."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def keep_best(df: DataFrame, keys: Sequence[Column | str], order: Sequence[Column]) -> DataFrame:
    return top_per_group(df, keys, order, 1, "_rank").drop("_rank")


def latest_per_key(df: DataFrame, key: str, at: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """The newest row of every key as one aggregate: partial maxima are taken before the shuffle."""
    newest = F.max_by(F.struct(*columns), F.struct(at, tie)).alias("_r")
    return df.groupBy(key).agg(newest).select(key, *(f"_r.{c}" for c in columns))


def recent_average(df: DataFrame, key: str, order: Sequence[Column], value: str, n: int) -> DataFrame:
    """Average of the last n values of each key, and how many there were."""
    return top_per_group(df, [key], order, n).groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("average"))


def with_delta(df: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """Adds previous and delta, the change since the previous row of the key."""
    previous = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("previous", previous).withColumn("delta", F.col(value) - F.col("previous"))


def gaps(df: DataFrame, key: str, at: str, tie: str, least_days: Column | int) -> DataFrame:
    """Pairs of consecutive dates of a key that lie more than least_days apart."""
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at, tie))
    out = df.where(F.col(at).isNotNull()).select(key, F.to_date(at).alias("gap_start"), F.to_date(following).alias("gap_end"))
    return out.withColumn("gap_days", F.date_diff("gap_end", "gap_start").cast("long")).where(F.col("gap_days") > least_days)


def change_percent(df: DataFrame, key: str, at: str, tie: str, value: str) -> DataFrame:
    """100 * (last - first) / first of every key; null with fewer than two values or a first of zero."""
    at_ = F.struct(at, tie)
    ends = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, at_).alias("first"), F.max_by(value, at_).alias("last"))
    change = F.when(F.col("n") > 1, 100 * (F.col("last") - F.col("first")) / F.nullif("first", F.lit(0.0)))
    return ends.withColumn("change_pct", change)


def monotone_runs(df: DataFrame, key: str | None, at: str, value: str, least: int = 3) -> DataFrame:
    """Maximal strictly rising or falling runs of at least so many points: key, direction, start, end, points.

    Gaps and islands: the sign of each step is compared with the one before, and a running sum numbers the runs. A turning
    point ends one run and starts the next.
    """
    by = Window.partitionBy(*([key] if key else [])).orderBy(at)
    steps = df.withColumn("_before", F.lag(value).over(by)).withColumn("_from", F.lag(at).over(by))
    steps = steps.where("_before is not null").withColumn("_sign", F.signum(F.col(value) - F.col("_before")))
    new = (F.col("_sign") != F.coalesce(F.lag("_sign").over(by), F.lit(9))).cast("int")
    steps = steps.withColumn("_run", F.sum(new).over(by))
    keys = [key] if key else []
    runs = steps.where("_sign <> 0").groupBy(*keys, "_run", "_sign").agg(F.min("_from").alias("start"), F.max(at).alias("end"), (F.count(F.lit(1)) + 1).alias("points"))
    return runs.where(F.col("points") >= least).select(*keys, F.when(F.col("_sign") > 0, "rising").otherwise("falling").alias("direction"), "start", "end", "points")


def rolling_volatility(df: DataFrame, key: str | None, at: str, value: str, width: int = 5) -> DataFrame:
    """Population deviation over absolute mean of the width rows up to each one, at most 1; only full windows."""
    keys = [key] if key else []
    over = Window.partitionBy(*keys).orderBy(at).rowsBetween(1 - width, 0)
    out = df.withColumn("_n", F.count(value).over(over)).withColumn("_m", F.abs(F.avg(value).over(over)))
    volatility = F.when(F.col("_m") > 0, F.least(F.stddev_pop(value).over(over) / F.col("_m"), F.lit(1.0))).otherwise(0.0)
    return out.withColumn("volatility", volatility).where(F.col("_n") == width).drop("_n", "_m")


def placed(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Adds place, from 1, and of, the number of rows, within each key by the columns order, nulls first.

    Rows are dealt out by ranges of key and order, and counted within them after what the ranges before hold, so a key
    with a third of all rows is no one task's work. order should tell rows apart.
    """
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(df.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part", F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))  # a row for each range and key
    by = Window.partitionBy("_key")
    before = F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = written(sums.select(F.col("_part").alias("_p"), "_key", before.alias("_before"), F.sum("_n").over(by).alias("of")), "range_sums")
    local = F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))
    met = ranged.withColumn("_local", local).join(sums, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    return met.withColumn("place", F.col("_local") + F.col("_before")).select(*df.columns, "place", "of")


def carried(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Adds last, the last value that isn't null up to and with each row, within each key by the columns order, nulls first.

    Each range of key and order takes what the ranges before end with, so a key's rows are dealt out over many tasks.
    """
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(df.repartitionByRange(n, key, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = ranged.where(F.col(value).isNotNull()).groupBy("_part", F.col(key).alias("_key")).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    all_ranges = ranged.select("_part", F.col(key).alias("_key")).distinct().join(ends.withColumnsRenamed({"_part": "_p", "_key": "_k"}), (F.col("_part") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(all_ranges.select(F.col("_part").alias("_p"), "_key", before.alias("_start")), "range_starts")  # a row for each range and key
    local = F.last(value, ignorenulls=True).over(Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    met = ranged.withColumn("_local", local).join(starts, (F.col("_part") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_key")))
    return met.withColumn("last", F.coalesce("_local", "_start")).select(*df.columns, "last")
