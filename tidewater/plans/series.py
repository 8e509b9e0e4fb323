"""Queries over time series: anomalies, rollups, gaps, deltas, runs and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.windows import change_percent, gaps, monotone_runs, placed, recent_average, rolling_volatility, top_per_group, with_delta
from tidewater.operators.windows import latest_per_key as newest
from tidewater.plans.registry import query
from tidewater.sources.tables import table


@query("""
WITH hourly AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1),
stats AS (SELECT avg(n) AS mean, stddev_pop(n) AS dev FROM hourly),
recent AS (SELECT hour, n, row_number() OVER (ORDER BY hour DESC) AS rn FROM hourly)
SELECT CAST(hour AS TIMESTAMP) AS hour, n, round((n - mean) / nullif(dev, 0), 6) AS z,
  abs((n - mean) / nullif(dev, 0)) > 2.0 AS is_anomaly,
  CASE WHEN abs((n - mean) / nullif(dev, 0)) > 3 THEN 'high' WHEN abs((n - mean) / nullif(dev, 0)) > 2.5 THEN 'medium'
    WHEN abs((n - mean) / nullif(dev, 0)) > 2 THEN 'low' ELSE 'none' END AS severity
FROM recent, stats WHERE rn <= 24
""")
def hourly_zscore_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_hours(table(spark, sf_dir, "events"), "ts")


def score_hours(rows: DataFrame, ts: str, last: int = 24, threshold: float = 2.0) -> DataFrame:
    """Counts per hour, with the z-score of the last hours against all hours; statistics come from one small aggregate."""
    hourly = rows.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    stats = hourly.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("dev"))
    z = F.try_divide(F.col("n") - F.col("mean"), F.nullif("dev", F.lit(0.0)))
    recent = hourly.orderBy(F.col("hour").desc()).limit(last).join(F.broadcast(stats))  # one row
    severity = F.when(F.abs(z) > 3, "high").when(F.abs(z) > 2.5, "medium").when(F.abs(z) > threshold, "low").otherwise("none")
    return recent.select("hour", "n", F.round(z, 6).alias("z"), (F.abs(z) > threshold).alias("is_anomaly"), severity.alias("severity"))


@query("""
WITH m AS (SELECT max(ts) AS as_of FROM events),
c AS (SELECT event_type, count(*) FILTER (WHERE ts > as_of - INTERVAL 1 DAY) AS recent, count(*) FILTER (WHERE ts > as_of - INTERVAL 8 DAY AND ts <= as_of - INTERVAL 1 DAY) / 7.0 AS daily FROM events, m GROUP BY 1)
SELECT event_type, recent, round(daily, 6) AS daily_average, round(recent / CASE WHEN daily = 0 THEN 1 ELSE daily END, 6) AS ratio, recent / CASE WHEN daily = 0 THEN 1 ELSE daily END > 3 AS is_anomaly FROM c
""")
def source_ratio_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last day's count of each type against its daily average over the week before."""
    rows = table(spark, sf_dir, "events").select("event_type", "ts")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("as_of"))))  # one row
    day = F.expr("interval 1 day")
    recent = F.count_if(F.col("ts") > F.col("as_of") - day)
    before = F.count_if((F.col("ts") > F.col("as_of") - F.expr("interval 8 days")) & (F.col("ts") <= F.col("as_of") - day))
    per = rows.groupBy("event_type").agg(recent.alias("recent"), (before / 7.0).alias("daily"))
    ratio = F.col("recent") / F.when(F.col("daily") == 0, 1.0).otherwise(F.col("daily"))
    return per.select("event_type", "recent", F.round("daily", 6).alias("daily_average"), F.round(ratio, 6).alias("ratio"), (ratio > 3).alias("is_anomaly"))


@query("""
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS runs, count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
  count(*) FILTER (WHERE event_type = 'error') AS failed, round(avg(value), 6) AS avg_value, round(sum(value), 4) AS sum_value FROM events GROUP BY 1, 2
""")
def daily_phase_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"),
        F.round(F.avg("value"), 6).alias("avg_value"), F.round(F.sum("value"), 4).alias("sum_value"),
    )


@query("""
WITH m AS (SELECT max(ts) AS as_of FROM events)
SELECT event_type, count(*) FILTER (WHERE ts >= as_of - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (WHERE ts >= as_of - INTERVAL 24 HOUR) AS last_day,
  count(*) FILTER (WHERE ts >= as_of - INTERVAL 168 HOUR) AS last_week, count(*) FILTER (WHERE ts >= as_of - INTERVAL 168 HOUR AND value > 50) AS large_last_week FROM events, m GROUP BY 1
""")
def multi_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over several look-backs in one pass."""
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("as_of"))))
    since = lambda hours: F.col("ts") >= F.col("as_of") - F.expr(f"interval {hours} hours")
    return rows.groupBy("event_type").agg(
        F.count_if(since(1)).alias("last_hour"), F.count_if(since(24)).alias("last_day"), F.count_if(since(168)).alias("last_week"),
        F.count_if(since(168) & (F.col("value") > 50)).alias("large_last_week"),
    )


@query("""
SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS failed,
  round(100.0 * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*), 0), 4) AS fail_pct FROM events GROUP BY 1 HAVING count(*) >= 5
""")
def phase_fail_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.count_if(F.col("event_type") == "error")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), failed.alias("failed"))
    return per.where("total >= 5").withColumn("fail_pct", F.round(100.0 * F.col("failed") / F.nullif("total", F.lit(0)), 4))


@query("""
SELECT event_type, count(value) AS n, round(avg(value), 6) AS average FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 15 GROUP BY 1
""")
def recent_15_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recent_average(table(spark, sf_dir, "events"), "event_type", [F.col("ts").desc(), F.col("event_id").desc()], "value", 15)
    return out.withColumn("average", F.round("average", 6))


@query("""
SELECT user_id, last(event_id ORDER BY ts, event_id) AS event_id, last(event_type ORDER BY ts, event_id) AS event_type, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1
""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", ["event_id", "event_type", "value"])


@query("""
WITH g AS (SELECT user_id, CAST(ts AS DATE) AS gap_start, CAST(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DATE) AS gap_end FROM events)
SELECT user_id, CAST(gap_start AS VARCHAR) AS gap_start, CAST(gap_end AS VARCHAR) AS gap_end, (gap_end - gap_start)::BIGINT AS gap_days FROM g WHERE gap_end - gap_start > 2
""")
def gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gaps(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2)
    return out.withColumns({c: F.col(c).cast("string") for c in ("gap_start", "gap_end")})


@query("""
SELECT user_id, event_id, value, lag(value) OVER w AS previous, round(value - lag(value) OVER w, 6) AS delta, coalesce(event_type <> lag(event_type) OVER w, false) AS changed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def lag_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value against the one before it, and whether the type changed."""
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("changed", F.coalesce(F.col("event_type") != F.lag("event_type").over(over), F.lit(False)))
    return with_delta(rows, "user_id", [F.col("ts"), F.col("event_id")], "value").select("user_id", "event_id", "value", "previous", F.round("delta", 6).alias("delta"), "changed")


@query("""
SELECT user_id, event_type AS latest, before AS previous, event_type IS DISTINCT FROM before AS changed FROM (
  SELECT user_id, event_type, lead(event_type) OVER w AS before, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)) WHERE rn = 1
""")
def position_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest and the second newest position of every key."""
    two = top_per_group(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 2)
    per = two.groupBy("user_id").agg(F.max(F.when(F.col("rank") == 1, F.col("event_type"))).alias("latest"), F.max(F.when(F.col("rank") == 2, F.col("event_type"))).alias("previous"))
    return per.withColumn("changed", ~F.col("latest").eqNullSafe(F.col("previous")))


@query("""
SELECT o_custkey, count(*) AS n, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS "first", last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS "last",
  CASE WHEN count(*) > 1 THEN round(100 * (last(o_totalprice ORDER BY o_orderdate, o_orderkey) - first(o_totalprice ORDER BY o_orderdate, o_orderkey)) / nullif(first(o_totalprice ORDER BY o_orderdate, o_orderkey), 0), 4) END AS change_pct
FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1
""")
def first_last_pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = change_percent(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return out.withColumn("change_pct", F.round("change_pct", 4))


_HOURLY = "SELECT event_type, date_trunc('hour', ts) AS hour, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2"


def hourly_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH h AS ({_HOURLY}), w AS (SELECT event_type, hour, count(mean) OVER o AS k, abs(avg(mean) OVER o) AS m, stddev_pop(mean) OVER o AS s FROM h
  WINDOW o AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_type, CAST(hour AS TIMESTAMP) AS hour, round(CASE WHEN m > 0 THEN least(s / m, 1.0) ELSE 0 END, 6) AS volatility FROM w WHERE k = 5
""")
def hourly_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling_volatility(hourly_means(spark, sf_dir), "event_type", "hour", "mean").select("event_type", "hour", F.round("volatility", 6).alias("volatility"))


@query(f"""
WITH h AS ({_HOURLY}), s AS (SELECT *, lag(n) OVER w AS b, lag(hour) OVER w AS f FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
g AS (SELECT *, sign(n - b) AS sg FROM s WHERE b IS NOT NULL), r AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) OVER w THEN 1 ELSE 0 END AS nw FROM g WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
i AS (SELECT *, sum(nw) OVER (PARTITION BY event_type ORDER BY hour) AS run FROM r)
SELECT event_type, CASE WHEN sg > 0 THEN 'rising' ELSE 'falling' END AS direction, CAST(min(f) AS TIMESTAMP) AS "start", CAST(max(hour) AS TIMESTAMP) AS "end", count(*) + 1 AS points
FROM i WHERE sg <> 0 GROUP BY event_type, run, sg HAVING count(*) + 1 >= 4
""")
def monotone_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal rising and falling runs of hourly counts, at least four points long."""
    return monotone_runs(hourly_means(spark, sf_dir), "event_type", "hour", "n", 4)


@query(f"""
WITH h AS ({_HOURLY}), p AS (SELECT event_type, mean, row_number() OVER (PARTITION BY event_type ORDER BY hour) - 1 AS i FROM h),
l AS (SELECT unnest([3, 4, 5, 6]) AS len)
SELECT a.event_type, len::INTEGER AS cycle, round(corr(a.mean, b.mean), 6) AS correlation, coalesce(corr(a.mean, b.mean) > 0.5, false) AS is_cycle
FROM l JOIN p a ON a.i < len JOIN p b ON b.event_type = a.event_type AND b.i = a.i + len GROUP BY 1, 2
""")
def cycle_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the first cycle with the second, for cycles of three to six hours."""
    i = F.row_number().over(Window.partitionBy("event_type").orderBy("hour")) - 1
    p = hourly_means(spark, sf_dir).withColumn("i", i).where("i < 12").select("event_type", "mean", "i")
    a = p.withColumn("cycle", F.explode(F.array(*map(F.lit, (3, 4, 5, 6))))).where("i < cycle")
    b = p.select("event_type", F.col("mean").alias("second"), F.col("i").alias("j"))
    both = a.withColumn("j", F.col("i") + F.col("cycle")).join(b, ["event_type", "j"])
    r = F.corr("mean", "second")
    return both.groupBy("event_type", "cycle").agg(F.round(r, 6).alias("correlation"), F.coalesce(r > 0.5, F.lit(False)).alias("is_cycle"))


@query(f"""
WITH h AS ({_HOURLY}), t AS (SELECT event_type, first(mean ORDER BY hour) AS f, last(mean ORDER BY hour) AS l, count(*) AS points, sum(n) AS rows FROM h GROUP BY 1)
SELECT event_type, points, round(f, 6) AS first_mean, round(l, 6) AS last_mean, round(least(1.0, rows / 10.0), 4) AS confidence,
  CASE WHEN l > f * 1.1 THEN 'rising' WHEN l < f * 0.9 THEN 'falling' ELSE 'stable' END AS direction FROM t
""")
def series_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First against last hourly mean, ten percent either way."""
    t = hourly_means(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("points"), F.min_by("mean", "hour").alias("f"), F.max_by("mean", "hour").alias("l"), F.sum("n").alias("rows"))
    direction = F.when(F.col("l") > F.col("f") * 1.1, "rising").when(F.col("l") < F.col("f") * 0.9, "falling").otherwise("stable")
    return t.select("event_type", "points", F.round("f", 6).alias("first_mean"), F.round("l", 6).alias("last_mean"), F.round(F.least(F.lit(1.0), F.col("rows") / 10.0), 4).alias("confidence"), direction.alias("direction"))


@query("""
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT event_type, first(n ORDER BY day) AS f, last(n ORDER BY day) AS l, count(*) AS days, sum(n)::BIGINT AS total FROM d GROUP BY 1)
SELECT event_type, days, total, f AS first_day, l AS last_day, CASE WHEN l > f THEN 'increasing' WHEN l < f THEN 'decreasing' ELSE 'stable' END AS direction, coalesce(abs(l - f) / nullif(f, 0)::DOUBLE > 0.2, false) AS leading FROM t
""")
def volume_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    t = d.groupBy("event_type").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("total"), F.min_by("n", "day").alias("first_day"), F.max_by("n", "day").alias("last_day"))
    change = F.col("last_day") - F.col("first_day")
    direction = F.when(change > 0, "increasing").when(change < 0, "decreasing").otherwise("stable")
    return t.withColumn("direction", direction).withColumn("leading", F.coalesce(F.abs(change) / F.nullif("first_day", F.lit(0)) > 0.2, F.lit(False)))


@query("""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) AS users, count(*) AS n, round(least(0.9, 0.5 + 0.1 * least(count(*), 4)), 4) AS confidence FROM events GROUP BY 1 HAVING count(*) >= 2
""")
def temporal_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("n"))
    return per.where("n >= 2").withColumn("confidence", F.round(F.least(F.lit(0.9), 0.5 + 0.1 * F.least("n", F.lit(4))), 4))


@query("""
WITH c AS (SELECT user_id, event_type, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) >= 2)
SELECT user_id, event_type, days, round(least(0.9, 0.5 + 0.05 * least(days, 8)), 4) AS confidence FROM c
""")
def behavioral_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count_distinct(F.to_date("ts")).alias("days"))
    return per.where("days >= 2").withColumn("confidence", F.round(F.least(F.lit(0.9), 0.5 + 0.05 * F.least("days", F.lit(8))), 4))


@query("""
WITH h AS (SELECT event_type, value, ntile(2) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS half FROM events)
SELECT event_type, round(avg(value), 6) AS average, CASE WHEN avg(value) FILTER (WHERE half = 2) > avg(value) FILTER (WHERE half = 1) THEN 'improving' ELSE 'declining' END AS direction,
  round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM h GROUP BY 1
""")
def half_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average, the second half against the first, and each type's share of all rows."""
    rows = placed(table(spark, sf_dir, "events").select("event_type", "value", "ts", "event_id"), "event_type", ["ts", "event_id"])
    # of an odd number of rows the first half has one more
    h = rows.withColumn("half", F.when(F.col("place") * 2 <= F.col("of") + 1, 1).otherwise(2))
    mean = lambda n: F.avg(F.when(F.col("half") == n, F.col("value")))
    per = h.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("average"), F.when(mean(2) > mean(1), "improving").otherwise("declining").alias("direction"), F.count(F.lit(1)).alias("n"))
    all_rows = per.agg(F.sum("n").alias("all"))
    return per.crossJoin(F.broadcast(all_rows)).select("event_type", "average", "direction", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("""
SELECT event_type, CAST(time_bucket(INTERVAL 1 DAY, ts) AS TIMESTAMP) AS "start", count(*) AS n, round(max(value), 6) AS peak FROM events GROUP BY 1, 2
""")
def tumbling_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming tumbling window."""
    per = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("peak"))
    return per.select("event_type", F.col("w.start").alias("start"), "n", "peak")


@query("""
WITH e AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, h - INTERVAL (i) HOUR AS s, n FROM e, (SELECT unnest(range(0, 24)) AS i))
SELECT event_type, CAST(s AS TIMESTAMP) AS "start", sum(n)::BIGINT AS n FROM s GROUP BY 1, 2
""")
def sliding_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24-hour windows every hour, from hourly counts, so that rows are multiplied after they are aggregated."""
    hourly = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    slid = hourly.withColumn("start", F.explode(F.expr("sequence(h - interval 23 hours, h, interval 1 hour)")))
    return slid.groupBy("event_type", "start").agg(F.sum("n").alias("n"))


@query("""
WITH o AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o)
SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS "start", CAST(max(ts) AS TIMESTAMP) AS last_event, count(*) AS n FROM s GROUP BY user_id, k
""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six quiet hours; an extension, the batch twin of the streaming session window."""
    per = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("n"))
    return per.select("user_id", F.col("w.start").alias("start"), "last_event", "n")


@query("""
WITH m AS (SELECT max(o_orderdate) AS as_of FROM orders), l AS (SELECT o_custkey, max(o_orderdate) AS last_at, count(*) AS n FROM orders GROUP BY 1)
SELECT c_custkey, n, CAST(last_at AS TIMESTAMP) AS last_at, CASE WHEN last_at IS NULL THEN 'never' WHEN last_at < as_of - INTERVAL 90 DAY THEN 'dormant' ELSE 'active' END AS state
FROM customer LEFT JOIN l ON c_custkey = o_custkey, m
""")
def dormancy_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the age of their last order, as of the newest order."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_at"), F.count(F.lit(1)).alias("n"))
    as_of = orders.agg(F.max("last_at").alias("as_of"))
    met = table(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").crossJoin(F.broadcast(as_of))
    state = F.when(F.col("last_at").isNull(), "never").when(F.col("last_at") < F.col("as_of") - F.expr("interval 90 days"), "dormant").otherwise("active")
    return met.select("c_custkey", "n", "last_at", state.alias("state"))
