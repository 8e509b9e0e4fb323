"""Queries over sources, streams and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import models
from tidewater.operators import entities
from tidewater.plans.registry import query
from tidewater.sources import feeds, logs, observations
from tidewater.sources.tables import table
from tidewater.streaming import state
from tidewater.streaming import windows as streams


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.stream_table(spark, sf_dir, "events", "ts")


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS \"start\", count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by a stream that is replayed to its end."""
    return streams.replay(streams.tumbling_counts(event_stream(spark, sf_dir), "ts", "event_type", "1 hour", "40 days"), "complete", "tumbling")


@query("""
SELECT event_type, CAST(date_trunc('hour', ts) - INTERVAL (i) HOUR AS TIMESTAMP) AS "start", count(*) AS n FROM events, (SELECT unnest(range(0, 3)) AS i) GROUP BY 1, 2
""")
def stream_sliding_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.replay(streams.sliding_counts(event_stream(spark, sf_dir), "ts", "event_type", "3 hours", "1 hour", "40 days"), "complete", "sliding")


@query("""
WITH o AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM o) SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS "start", count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by a stream; an extension."""
    return streams.replay(streams.session_counts(event_stream(spark, sf_dir), "ts", "user_id", "6 hours", "40 days"), "complete", "sessions")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that pass a stream's deduplication."""
    rows = streams.deduplicated(event_stream(spark, sf_dir), "ts", ["user_id", "event_type"], "40 days")
    return streams.replay(rows.select("user_id", "event_type"), "append", "dedup")


@query("SELECT e.event_id, c.c_mktsegment, CASE WHEN e.event_type = 'error' THEN 'high' ELSE 'medium' END AS priority FROM events e JOIN customer c ON e.user_id = c.c_custkey WHERE e.value > 90")
def stream_update_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes joined with what is known of their key, and given a priority."""
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    rows = streams.static_join(event_stream(spark, sf_dir).where("value > 90"), known, "user_id")
    return streams.replay(rows.select("event_id", "c_mktsegment", F.when(F.col("event_type") == "error", "high").otherwise("medium").alias("priority")), "append", "queue")


@query("""
SELECT 'events' AS source, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS entries, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view') AS infos FROM events WHERE event_id % 7 <> 0 GROUP BY 2
""")
def log_archive_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines parsed back, every seventh broken on purpose and left out, and counted by day and level."""
    level = F.when(F.col("event_type") == "view", "info").otherwise(F.col("event_type"))
    made = F.to_json(F.struct(level.alias("level"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "value"))
    lines = table(spark, sf_dir, "events").withColumn("x", made).select(F.when(F.col("event_id") % 7 == 0, F.substring("x", 1, 12)).otherwise(F.col("x")).alias("value"))
    per = logs.level_rollup(logs.parse_entries(lines, F.col("value"), "events"))
    return per.select("source", F.col("day").cast("string").alias("day"), "entries", "errors", "infos")


@query("SELECT event_id, round(value, 2) AS value FROM events WHERE event_id % 10 <> 0")
def missing_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as text, a point for a missing one, read back as numbers."""
    text = F.when(F.col("event_id") % 10 == 0, ".").otherwise(F.col("value").cast("string"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("value"))
    return observations.parse_observations(rows).withColumn("value", F.round("value", 2))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS date, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, event_type) AS n FROM d)
SELECT CAST(date AS VARCHAR) AS date, event_type AS source, value FROM r WHERE n = 1
""")
def unified_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a day, from the preferred source that has one."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("source")).agg(F.round(F.avg("value"), 6).alias("value"))
    return observations.unified(daily, ["purchase", "view"]).select(F.col("date").cast("string").alias("date"), "source", "value")


@query("""
SELECT page_id FROM pages WHERE NOT contains(lower(url), '/es/') AND page_id % 5 <> 0
""")
def feed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as feed entries: filtered by URL, refused where already stored."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    kept = feeds.filter_chain(pages, F.col("url"), F.col("url"), exclude_url=["/es/"])
    return feeds.backfill(kept, pages.where("page_id % 5 = 0"), "page_id").select("page_id")


@query("""
WITH c AS (SELECT c_custkey AS id, lower(trim(c_name)) AS k FROM customer), m AS (SELECT o_orderkey AS mention_id, lower(trim(CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) WHEN o_orderkey % 3 = 1 THEN 'Dr. ' || c_name ELSE 'nobody' END)) AS k, o_orderkey % 3 AS w FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT mention_id, c.id, (CASE w WHEN 0 THEN 1 ELSE 3 END)::INTEGER AS rule FROM m JOIN c ON regexp_replace(m.k, '^dr\\. ', '') = c.k
""")
def mention_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions in other case, with a title, or of nobody, resolved to customers by the first rule that hits."""
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("person").alias("type"), F.array().cast("array<string>").alias("aliases"))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.upper("name")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Dr. "), "name")).otherwise("nobody")
    rows = table(spark, sf_dir, "orders").join(people, F.col("o_custkey") == F.col("id")).select(F.col("o_orderkey").alias("mention_id"), name.alias("name"), "type")
    return entities.resolve(rows, people)


@query("""
WITH c AS (SELECT o_orderpriority AS domain, o_custkey, count(*) AS mentions FROM orders GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY mentions DESC, o_custkey) AS n FROM c)
SELECT domain, o_custkey, mentions FROM r WHERE n <= 5 ORDER BY mentions DESC, domain, o_custkey LIMIT 15
""")
def key_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("domain"), "o_custkey")
    return entities.top_entities(rows, "domain", "o_custkey", 2, 5, 15)


@query("""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 20, 1) + 1, 180)) AS i FROM t WHERE len(w) > 0)
SELECT doc_id, ((i - 1) / 180)::INTEGER AS pos, md5(array_to_string(w[i:i + 199], ' ')) AS chunk_md5 FROM c
""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pieces of 200 words, by their hash."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(models.chunks(F.col("text"))).alias("pos", "chunk"))
    return rows.select("doc_id", "pos", F.md5("chunk").alias("chunk_md5"))


@query("""
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'imposed a fine' WHEN 1 THEN 'supports' WHEN 2 THEN 'leads' WHEN 3 THEN 'was seen' ELSE 'went' END AS predicate FROM orders)
SELECT predicate, CASE predicate WHEN 'imposed a fine' THEN 'ACTION' WHEN 'supports' THEN 'POSITION' WHEN 'leads' THEN 'RELATIONSHIP' WHEN 'was seen' THEN 'ATTRIBUTE' ELSE 'STATEMENT' END AS fact_type, count(*) AS n FROM p GROUP BY 1, 2
""")
def predicate_fact_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("imposed a fine", "supports", "leads", "was seen", "went")))
    rows = table(spark, sf_dir, "orders").select(F.element_at(words, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("predicate"))
    return rows.groupBy("predicate", models.fact_type(F.col("predicate")).alias("fact_type")).agg(F.count(F.lit(1)).alias("n"))


@query()
def hash_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-hashed vectors of all documents, by their length and largest place; no SQL states the hash."""
    vector = models.hash_embedding()(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", vector.alias("v"))
    return rows.select("doc_id", F.size("v").alias("n"), F.array_position("v", F.array_max("v")).alias("largest"))


@query()
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers that may be one, by the best rule; the operator is tested on a small example."""
    rows = lambda name, key, label: table(spark, sf_dir, name).select(F.concat(F.lit(label), key).alias("id"), F.col(f"{key[0]}_name").alias("name"), F.lit("organization").alias("type"), F.array().cast("array<string>").alias("aliases"))
    return entities.merge_candidates(rows("supplier", "s_suppkey", "s").unionByName(rows("customer", "c_custkey", "c")), 0.9)


@query("""
WITH o AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS was FROM events)
SELECT CASE WHEN was IS NULL THEN 'insert' WHEN was <> event_type THEN 'update' ELSE 'same' END AS change, count(*) AS n FROM o GROUP BY 1
""")
def stream_url_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often entries are new, change the row of their address, or leave it: users as addresses, events as contents."""
    entries = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("url"), F.unix_micros("ts").alias("at"), F.col("event_type").alias("content"))
    return streams.replay(state.url_upserts(entries), "append", "upserts").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def work_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commands of a queue in 16 shards: views add items, clicks claim, other events end work."""
    action = F.when(F.col("event_type") == "view", "add").when(F.col("event_type") == "click", "claim").otherwise("done")
    at = F.unix_seconds("ts")
    return event_stream(spark, sf_dir).select(
        (F.col("user_id") % 16).alias("shard"), F.col("event_id").alias("seq"), at.alias("at"), action.alias("action"), (F.col("event_id") % 50).alias("item"),
        (F.col("event_id") % 3).alias("priority"), (at + F.col("event_id") % 600).alias("due"), (F.col("event_id") % 4).alias("worker"),
    )


@query()
def stream_work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of claimed work whose leases last six hours, at most three times; tested against plain Python."""
    return streams.replay(state.work_queue(work_commands(spark, sf_dir), lease=6 * 3600, tries=3), "append", "work")
