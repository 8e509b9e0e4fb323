"""Queries of the relational core: filters, pages, joins, grouped aggregates, ranked groups, set operations, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.filters import apply_filters, contains_any, final_score, ingest_reject_reason, not_flagged, page, quality_reject_reason
from tidewater.operators.joins import as_of_join, band_join, co_occurrence, overlap_pairs
from tidewater.operators.upsert import monotone_upsert, upsert
from tidewater.operators.windows import keep_best, top_per_group
from tidewater.plans.registry import query
from tidewater.sources.tables import table


@query("""
SELECT doc_id, source, lang, n_chars FROM documents WHERE lower(text) LIKE '%the%' AND lang = 'en' AND n_chars >= 500 ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20
""")
def filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third block of twenty of a filtered and sorted list."""
    rows = apply_filters(table(spark, sf_dir, "documents"), terms={"text": "%the%"}, equal={"lang": "en"}, at_least={"n_chars": 500})
    return page(rows.select("doc_id", "source", "lang", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 20, 20)


@query("SELECT count(*) AS total FROM documents WHERE lang = 'en' AND n_chars >= 500 AND (lower(text) LIKE '%with%' OR lower(source) LIKE '%with%')")
def filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_filters(table(spark, sf_dir, "documents"), equal={"lang": "en"}, at_least={"n_chars": 500}, search=(["text", "source"], "with"))
    return rows.agg(F.count(F.lit(1)).alias("total"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlinked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_filters(table(spark, sf_dir, "documents"), unlinked=(table(spark, sf_dir, "labels"), "doc_id"))
    return rows.select("doc_id", "source")


@query("SELECT DISTINCT source FROM documents WHERE trim(source) <> ''")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("source").where(F.trim("source") != "").distinct()


@query("""
SELECT doc_id, CASE WHEN trim(title) = '' THEN 'empty_title' WHEN coalesce(trim(source), '') = '' THEN 'missing_url' WHEN length(trim(body)) < 20 AND length(trim(title)) < 10 THEN 'thin_item' END AS reason
FROM (SELECT doc_id, source, coalesce(regexp_extract(text, '^([^.!?\\n]*)', 1), '') AS title, coalesce(text, '') AS body FROM documents)
""")
def ingest_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason for which a document would be refused, its first sentence taken as the title."""
    title = F.regexp_extract("text", "^([^.!?\\n]*)", 1)
    return table(spark, sf_dir, "documents").select("doc_id", ingest_reject_reason(title, F.col("text"), F.col("source")).alias("reason"))


@query("""
SELECT d.doc_id, CASE WHEN 4 - quality > 3 THEN 'tier' WHEN toxic > 0.8 THEN 'clickbait' WHEN n_chars / 10000.0 < 0.05 THEN 'fact_density' END AS reason,
  round(0.7 * coalesce(quality, 0.6) + 0.3 * coalesce(toxic, 0.5), 6) AS final_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reason = quality_reject_reason(4 - F.col("quality"), F.col("toxic"), F.col("n_chars") / 10000.0, least_density=0.05)
    return rows.select("doc_id", reason.alias("reason"), F.round(final_score(F.col("quality").cast("double"), F.col("toxic").cast("double")), 6).alias("final_score"))


@query("SELECT count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS DISTINCT FROM '7'")
def flag_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(not_flagged(F.col("props"), "$.k", "7")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%bolt%') AND NOT lower(p_name) LIKE '%small%'")
def keyword_filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitelist, then blacklist, as plain substring tests."""
    rows = table(spark, sf_dir, "part").where(contains_any(F.col("p_name"), ["ring", "bolt"]) & ~contains_any(F.col("p_name"), ["small"]))
    return rows.select("p_partkey", "p_name")


@query("""
SELECT r_name, n_name, count(*) AS lines, count(DISTINCT o_custkey) AS customers, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
""")
def join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner chain of five tables; Spark broadcasts what its size statistics show to be small."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    met = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    met = met.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return met.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("o_custkey").alias("customers"), F.round(revenue, 2).alias("revenue"))


@query("""
SELECT c_custkey, c_name, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1, 2
""")
def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join with the date in the join condition, counting matches: aggregated before the join, so nothing fans out."""
    recent = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))
    met = table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(recent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return met.select("c_custkey", "c_name", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def semi_join_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(large, "p_partkey", "left_semi")


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
  AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal < 0)
""")
def claim_gap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of anti joins."""
    orders = table(spark, sf_dir, "orders")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    for bad in (orders.where("o_orderstatus = 'P'"), orders.where("o_totalprice > 400000")):
        rows = rows.join(bad.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    poor = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    return rows.join(poor, "c_nationkey", "left_anti").select("c_custkey")


@query("""
SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS contexts FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2
""")
def cooccurrence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that stand together in at least two orders."""
    return co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 2)


@query("""
WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS shared FROM s x JOIN s y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3
""")
def shared_entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share at least three parts they delivered."""
    return overlap_pairs(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", 3)


@query("""
WITH s AS (SELECT DISTINCT n_regionkey, c_nationkey, o_orderpriority || o_orderstatus || CAST(month(o_orderdate) AS VARCHAR) AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT x.c_nationkey AS a, y.c_nationkey AS b, count(*) AS n FROM s x JOIN s y ON x.m = y.m AND x.n_regionkey <> y.n_regionkey AND x.c_nationkey < y.c_nationkey GROUP BY 1, 2)
SELECT a, b, n, round(least(1.0, 0.55 + 0.04 * least(n, 8)), 4) AS strength FROM p WHERE n >= 2
""")
def cross_domain_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of different regions that share kinds of orders, with the strength of the link."""
    t = lambda n: table(spark, sf_dir, n)
    big = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = big.select("n_regionkey", "c_nationkey", F.concat("o_orderpriority", "o_orderstatus", F.month("o_orderdate").cast("string")).alias("m")).distinct()
    y = s.select(F.col("n_regionkey").alias("r2"), F.col("c_nationkey").alias("b"), "m")
    p = s.withColumnRenamed("c_nationkey", "a").join(y, "m").where("n_regionkey <> r2 and a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return p.where("n >= 2").withColumn("strength", F.round(F.least(F.lit(1.0), 0.55 + 0.04 * F.least("n", F.lit(8))), 4))


@query("""
SELECT a.o_orderkey AS a, b.o_orderkey AS b, abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE)))::INTEGER AS days
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(date_diff('day', CAST(a.o_orderdate AS DATE), CAST(b.o_orderdate AS DATE))) <= 7
""")
def range_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer within a week of each other."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    other = orders.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("o_orderdate").alias("other_date"))
    near = band_join(orders.withColumnRenamed("o_orderkey", "a"), other, "o_orderdate", "other_date", 7, ["o_custkey"]).where("a < b")
    return near.select("a", "b", F.abs(F.date_diff(F.to_date("o_orderdate"), F.to_date("other_date"))).alias("days"))


@query("""
SELECT e.event_id, coalesce(p.event_id, -1) AS purchase_id, p.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN
  (SELECT user_id, ts, last(event_id ORDER BY event_id) AS event_id, last(value ORDER BY event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def as_of_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the user's last purchase at or before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by(F.struct(F.col("event_id").alias("purchase_id"), F.col("value").alias("purchase_value")), "event_id").alias("p")).select("user_id", "ts", "p.*")
    return as_of_join(events.where("event_type = 'click'"), bought, "user_id", "ts", "ts", ["purchase_id", "purchase_value"]).select("event_id", F.coalesce("purchase_id", F.lit(-1)).alias("purchase_id"), "purchase_value")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1
""")
def keep_best_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return keep_best(rows, ["l_partkey", "l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")])


@query("""
SELECT o_custkey, l_partkey, mentions, rank FROM (SELECT o_custkey, l_partkey, count(*) AS mentions, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, l_partkey)::INTEGER AS rank
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) WHERE rank <= 3
""")
def top3_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = met.groupBy("o_custkey", "l_partkey").agg(F.count(F.lit(1)).alias("mentions"))
    return top_per_group(counts, ["o_custkey"], [F.col("mentions").desc(), F.col("l_partkey")], 3)


@query("""
SELECT l_partkey, count(DISTINCT r_name) AS regions, list_sort(list(DISTINCT r_name)) AS region_names FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1 HAVING count(DISTINCT r_name) >= 5
""")
def multi_domain_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that suppliers of at least five regions delivered, with the sorted names."""
    t = lambda n: table(spark, sf_dir, n)
    met = t("lineitem").select("l_partkey", "l_suppkey").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = met.select("l_partkey", "r_name").distinct().groupBy("l_partkey").agg(F.count(F.lit(1)).alias("regions"), F.sort_array(F.collect_set("r_name")).alias("region_names"))
    return per.where("regions >= 5")


@query("""
SELECT 'documents' AS name, source AS key, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2
UNION ALL SELECT 'orders', o_orderstatus, count(*) FROM orders GROUP BY 2
""")
def union_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lambda name, key: table(spark, sf_dir, name).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "key", "n")
    return counted("documents", "source").unionByName(counted("events", "event_type")).unionByName(counted("orders", "o_orderstatus"))


@query("""
SELECT CASE WHEN coalesce(quality, 0.5) >= 0.8 THEN 'high' WHEN coalesce(quality, 0.5) >= 0.6 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n, round(avg(n_chars), 4) AS avg_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
""")
def case_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.coalesce(F.col("quality").cast("double"), F.lit(0.5))
    return rows.groupBy(F.when(q >= 0.8, "high").when(q >= 0.6, "medium").otherwise("low").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS avg_price FROM part GROUP BY 1 HAVING count(*) >= 3")
def average_with_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 4).alias("avg_price")).where("n >= 3")


@query("""
SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS orders_in_time, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F'), []) AS finished FROM orders GROUP BY 1
""")
def ordered_array_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("s"), F.sort_array(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))).alias("finished")
    )
    return per.select("o_custkey", F.col("s.o_orderkey").alias("orders_in_time"), "finished")


@query("""
SELECT o_orderstatus, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 4) AS urgent_avg, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (WHERE o_totalprice > 200000) AS large FROM orders GROUP BY 1
""")
def filtered_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(F.avg(F.when(urgent, F.col("o_totalprice"))), 4).alias("urgent_avg"), F.count_if(urgent).alias("urgent"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("""
SELECT lower(regexp_extract(p_name, '([^ ]+)$', 1) || '-' || p_brand) AS last_word, count(*) AS n, count(DISTINCT p_type) AS types, min(p_name) AS sample FROM part GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200
""")
def surname_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names grouped by their last word, groups of bounded size only as the feature asks."""
    word = F.lower(F.element_at(F.split(F.trim(F.concat_ws("-", "p_name", "p_brand")), " "), -1))
    per = table(spark, sf_dir, "part").groupBy(word.alias("last_word")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_type").alias("types"), F.min("p_name").alias("sample"))
    return per.where("n between 2 and 200")


@query("""
SELECT l_suppkey, l_returnflag, l_linestatus, max(l_quantity) AS confidence, count(*) AS merged, first(l_orderkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS best_order FROM lineitem GROUP BY 1, 2, 3
""")
def claim_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.min_by("l_orderkey", F.struct(-F.col("l_quantity"), "l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.max("l_quantity").alias("confidence"), F.count(F.lit(1)).alias("merged"), best.alias("best_order"))


@query("""
WITH n AS (SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)
SELECT coalesce(n.user_id, c.c_custkey) AS c_custkey, coalesce(n.event_type, c.c_mktsegment) AS c_mktsegment, coalesce(n.value, c.c_acctbal) AS c_acctbal FROM customer c FULL JOIN n ON c.c_custkey = n.user_id
""")
def upsert_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the newest event of each user put in their place."""
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"), F.col("value").alias("c_acctbal"), "ts", "event_id")
    newest = keep_best(e, ["c_custkey"], [F.col("ts").desc(), F.col("event_id").desc()]).drop("ts", "event_id")
    return upsert(target, newest, ["c_custkey"])


@query("""
SELECT user_id, max(value) AS confidence, first(event_type ORDER BY value DESC, event_id DESC) AS evidence, last(CASE WHEN event_type <> 'view' THEN props END ORDER BY event_id) FILTER (WHERE event_type <> 'view') AS summary, count(*) AS arrivals FROM events GROUP BY 1
""")
def monotone_upsert_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("confidence"), F.col("event_type").alias("evidence"), F.when(F.col("event_type") != "view", F.col("props")).alias("summary"))
    return monotone_upsert(e, "user_id", "event_id")


@query("""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 ORDER BY o_orderpriority, o_totalprice DESC NULLS LAST, o_orderdate NULLS FIRST, o_orderkey LIMIT 50
""")
def priority_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_totalprice >= 100000")
    order = [F.col("o_orderpriority"), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderdate").asc_nulls_first(), F.col("o_orderkey")]
    return page(rows, order, 0, 50).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""
SELECT d.doc_id, coalesce(4 - quality, 4) AS tier, coalesce(toxic, 0)::DOUBLE AS score, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY 2, 3 DESC, 4 DESC, 1 LIMIT 30
""")
def quality_first_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.coalesce(4 - F.col("quality"), F.lit(4)).alias("tier"), F.coalesce(F.col("toxic"), F.lit(0)).cast("double").alias("score"), "n_chars")
    return page(rows, [F.col("tier"), F.col("score").desc(), F.col("n_chars").desc(), F.col("doc_id")], 0, 30)


@query("""
SELECT c_nationkey AS nation, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'customers only' FROM customer EXCEPT SELECT s_nationkey, 'customers only' FROM supplier)
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customers only")))


@query("""
SELECT coalesce(customer_region.n_regionkey, -1) AS n_regionkey, coalesce(customer_region.c_mktsegment, 'all') AS c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, grouping(customer_region.n_regionkey) + 2 * grouping(customer_region.c_mktsegment) AS level
FROM (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey) customer_region GROUP BY CUBE (customer_region.n_regionkey, customer_region.c_mktsegment)
""")
def cube_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels of two groupings; an extension."""
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    level = F.grouping("n_regionkey").cast("long") + 2 * F.grouping("c_mktsegment").cast("long")
    return met.cube("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), level.alias("level")).select(
        F.coalesce("n_regionkey", F.lit(-1)).alias("n_regionkey"), F.coalesce("c_mktsegment", F.lit("all")).alias("c_mktsegment"), "n", "balance", "level"
    )


@query("""
SELECT a.o_orderkey AS a, b.o_orderkey AS b, CASE WHEN a.o_orderdate < b.o_orderdate THEN 'before' WHEN a.o_orderdate > b.o_orderdate THEN 'after' ELSE 'simultaneous' END AS relation
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
""")
def temporal_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    a = rows.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("o_orderdate").alias("da"))
    b = rows.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("o_orderdate").alias("db"))
    relation = F.when(F.col("da") < F.col("db"), "before").when(F.col("da") > F.col("db"), "after").otherwise("simultaneous")
    return a.join(b, "o_custkey").where("a < b").select("a", "b", relation.alias("relation"))


@query("""
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INTEGER AS sequence FROM orders
""")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", number.alias("sequence"))
