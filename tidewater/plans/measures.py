"""Queries over single functions: gates, names, keywords, claims, dates and blended scores, each on the columns of a given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import dates, models, priorities, scores, search, text
from tidewater.operators import filters
from tidewater.plans.registry import query
from tidewater.sources.tables import table


@query("""
WITH d AS (SELECT doc_id, text AS t, CASE doc_id % 5 WHEN 0 THEN 'enriched' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' END AS s, CASE WHEN doc_id % 7 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id::INTEGER) END AS c FROM documents)
SELECT doc_id, t IS NOT NULL AND length(t) > 100 AND coalesce(s = 'enriched' OR (s IS NULL AND length(t) >= 1000 AND (c IS NULL OR c < TIMESTAMP '2024-01-15 00:00:00')), false) AS ml,
  t IS NOT NULL AND length(t) > 100 AND (coalesce(s IN ('enriched', 'failed', 'inaccessible'), false) OR length(t) >= 1000) AS context, t IS NOT NULL AND length(t) > 100 AND coalesce(s IN ('enriched', 'failed', 'inaccessible'), false) AS strict FROM d
""")
def eligibility_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are fit for models and for contexts, by length, status and time."""
    status = F.when(F.col("doc_id") % 5 == 0, "enriched").when(F.col("doc_id") % 5 == 1, "failed").when(F.col("doc_id") % 5 == 2, "pending")
    made = F.when(F.col("doc_id") % 7 > 0, F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 3600))
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", status.alias("s"), made.alias("c"))
    t, s = F.col("text"), F.col("s")
    return rows.select(
        "doc_id", filters.ml_ready(t, s, F.col("c"), 100, 1000, "2024-01-15 00:00:00").alias("ml"), filters.context_ready(t, s, 100, 1000).alias("context"), filters.context_ready(t, s, 100, 1000, strict=True).alias("strict")
    )


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 4 AS k, c_mktsegment AS m FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'Anna ' || m WHEN 1 THEN m || ' Works' WHEN 2 THEN 'Anna Maria ' || m ELSE m END AS name, CASE k WHEN 0 THEN m WHEN 1 THEN 'Works' WHEN 2 THEN m END AS last FROM c
""")
def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and legal forms cut from invented names, and last names."""
    m, k = F.col("c_mktsegment"), F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.lit(" Dr. Anna "), m)).when(k == 1, F.concat(m, F.lit("  Works, Inc."))).when(k == 2, F.concat(F.lit("Mrs Anna\tMaria "), m)).otherwise(m)
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.normalise_name(name, F.when(k == 1, "organization").otherwise("person")).alias("name"))
    return rows.select("c_custkey", "name", text.last_name(F.col("name")).alias("last"))


@query(f"""
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}'), lambda w: NOT list_contains({list(text.STOP_WORDS)}, w))[1:10], ' ') AS words,
  len(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{5,}}'), lambda w: NOT list_contains({list(text.STOP_WORDS)}, w))))::INTEGER AS long_words FROM documents
""")
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten keywords of every document, as the feature asks, and how many different long ones it has."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.keywords(t), " ").alias("words"), F.size(text.keywords(t, 5, None, True)).alias("long_words"))


@query("""
WITH n AS (SELECT n_nationkey, lower(n_name) AS n, n_nationkey % 3 AS k FROM nation)
SELECT n_nationkey, CASE k WHEN 0 THEN 'president of ' || n || '|of ' || n || '|' || n WHEN 1 THEN 'minister ' || n || '|' || n ELSE n || '|the place' END AS forms FROM n WHERE NOT contains(n, ' ')
""")
def subject_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms under which a claim's subject may be known, for subjects made from nations."""
    n, k = F.col("n_name"), F.col("n_nationkey") % 3
    rows = table(spark, sf_dir, "nation").where(~F.contains("n_name", F.lit(" ")))
    names = [r.n_name.lower() for r in rows.where("n_nationkey % 3 = 2").select("n_name").collect()]  # some of 25 nations
    subject = F.when(k == 0, F.concat(F.lit("President  of "), n)).when(k == 1, F.concat(F.lit(" Minister "), n)).otherwise(n)
    return rows.select("n_nationkey", F.array_join(search.subject_variants(subject, dict.fromkeys(names, "the place"), ("president", "minister")), "|").alias("forms"))


@query("""
SELECT x.vec_id, round(list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1
""")
def neighbour_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the next one."""
    rows = table(spark, sf_dir, "embeddings")
    met = rows.select("vec_id", "embedding").join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return met.select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


@query("""
WITH p AS (SELECT p_partkey, p_name, p_type, p_brand FROM part), t AS (SELECT *, list_value(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type) AS w, lower(p_name || ' ' || 'small gear promo') AS r FROM p)
SELECT p_partkey, round(len(list_filter(w, lambda x: contains('small gear promo', lower(x)))) / 3.0, 6)::DOUBLE AS overlap FROM t
""")
def term_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a part's words stand in a reference text."""
    words = F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(search.lexical_overlap(words, F.lit("Small gear PROMO")), 6).alias("overlap"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_linenumber % 4 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k WHEN 0 THEN 0.9 WHEN 1 THEN 0.8 WHEN 2 THEN CASE WHEN abs(q - 30) / greatest(abs(q), 30) > 0.2 THEN 0.6 ELSE 0 END ELSE 0 END::DOUBLE AS contradiction FROM l
""")
def claim_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims made from lines against a fixed one: negated, opposite, of another number, or the same."""
    k, q = F.col("l_linenumber") % 4, F.col("l_quantity").cast("string")
    one = F.when(k == 0, "not said").when(k == 1, "supports").otherwise("counts")
    other = F.when(k == 1, "opposes").otherwise("counts")
    found = models.contradiction(one, F.when(k == 2, F.concat(q, F.lit(" units"))).otherwise("a thing"), other, F.when(k == 2, "30 units").otherwise("a thing"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.cast("double").alias("contradiction"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey % 5 AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN 'unknown' WHEN 1 THEN 'scheduled' ELSE 'occurred' END AS status, CAST(CAST(date_trunc('week', d) AS DATE) - 7 AS VARCHAR) AS monday, CAST(CAST(date_trunc('week', d) AS DATE) - 1 AS VARCHAR) AS sunday,
  CAST(greatest(d - k::INTEGER * 10, d - 14) AS VARCHAR) AS bounded, k > 2 AS stale, k * 86400.0::DOUBLE AS seconds FROM o
""")
def date_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, last whole week, bounded start, staleness and distance of dates made from orders."""
    d, k = F.to_date("o_orderdate"), F.col("o_custkey") % 5
    event = F.when(k > 0, F.when(k == 1, F.date_add(d, 1)).otherwise(F.date_sub(d, k.cast("int"))))
    start = F.date_sub(d, (k * 10).cast("int"))
    noon = F.timestamp_seconds(F.unix_date(d).cast("long") * 86400)
    earlier = F.timestamp_seconds((F.unix_date(d).cast("long") - k) * 86400)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.temporal_status(event, d).alias("status"), dates.last_completed_week(d)["monday"].cast("string").alias("monday"), dates.last_completed_week(d)["sunday"].cast("string").alias("sunday"),
        dates.bounded_start(start, d, 14).cast("string").alias("bounded"), dates.stale(earlier, noon, 48.0).alias("stale"), dates.seconds_between(earlier, noon).alias("seconds"),
    )


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_discount::DOUBLE AS d, l_tax::DOUBLE AS t, l_quantity::DOUBLE AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round(0.4 * d + 0.2 * t + CASE WHEN l_linenumber <= 1 THEN 0.1 ELSE 0.2 * greatest(1 - q / 30.0, 0.0) END + 0.1 * (q / 50) + 0.1 * d, 6) AS rerank, round(greatest(-1.0, least(1.0, 0.4 * (q / 10 - 2) + 0.6 * (t * 10))), 6) + 0.0 AS bias FROM l
""")
def blended_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking and bias blends of a line's numbers."""
    d, t, q = (F.col(c).cast("double") for c in ("l_discount", "l_tax", "l_quantity"))
    age = F.when(F.col("l_linenumber") > 1, q)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(scores.rerank_score(d, t, age, q / 50, d), 6).alias("rerank"), (F.round(priorities.bias_blend(q / 10 - 2, t * 10), 6) + F.lit(0.0)).alias("bias")
    )


@query("""
WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, CASE event_type WHEN 'view' THEN 'protest' WHEN 'click' THEN 'electoral' ELSE 'general' END AS kind, n FROM e
""")
def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of event that sentences made from events tell of."""
    said = F.when(F.col("event_type") == "view", "Thousands join a RALLY at night").when(F.col("event_type") == "click", "The ballot is over").otherwise("Nothing else is known")
    per = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", "event_type", models.event_type(said).alias("kind"), "n")
