"""Queries over search, extraction and clustering."""

from __future__ import annotations

import uuid

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import content, search, text
from tidewater.operators import ranking, retrieval
from tidewater.operators.graph import written
from tidewater.operators.work import shared_dir
from tidewater.plans.registry import query
from tidewater.sources.observations import latest_value
from tidewater.sources.tables import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(r"""
WITH d AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+(?:\x20[A-Z][a-z]+)*'), lambda x: lower(x)), lambda w: NOT list_contains(%s, w))) AS e FROM documents)
SELECT doc_id, len(e)::INTEGER AS n, array_to_string(list_sort(e)[1:3], '|') AS first_three FROM d
""" % str(list(text.STOP_WORDS)))
def capitalised_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", text.capitalised_runs(F.coalesce("text", F.lit(""))).alias("e"))
    return rows.select("doc_id", F.size("e").alias("n"), F.array_join(F.slice("e", 1, 3), "|").alias("first_three"))


@query("""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')) AS w FROM documents), m AS (SELECT doc_id, CASE WHEN list_contains(w, 'license') AND list_contains(w, 'work') AND list_contains(w, 'absent') THEN 3 WHEN list_contains(w, 'license') AND list_contains(w, 'work') THEN 2 WHEN list_contains(w, 'license') THEN 1 END AS tier FROM t)
SELECT doc_id, tier::INTEGER AS tier FROM m WHERE tier = (SELECT max(tier) FROM m)
""")
def tiered_fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of three terms, else of two, else one; the words of this search have no endings to cut."""
    return search.tiered_match(documents(spark, sf_dir).select("doc_id", "text"), "text", ["license", "work", "absent"]).select("doc_id", "tier")


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS t0, len(list_filter(w, lambda x: x = 'token')) AS t1 FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE t0 > 0) AS d0, count(*) FILTER (WHERE t1 > 0) AS d1 FROM c)
SELECT doc_id, round(sc, 6) AS score FROM (SELECT doc_id, ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)) AS sc FROM c, s) WHERE sc > 0
""")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.tf_idf_rank(documents(spark, sf_dir), "doc_id", "text", ["license", "token"]).withColumn("score", F.round("score", 6))


@query("""
WITH p AS (SELECT x.vec_id AS id, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS score FROM embeddings x, (SELECT embedding FROM embeddings WHERE vec_id = 1) y WHERE x.vec_id <> 1)
SELECT id, round(score, 6) AS score FROM p WHERE score >= greatest(0.15, 0.82 * (SELECT max(score) FROM p))
""")
def semantic_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors ranked by one of them, cut where the scores fall off."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    wanted = F.broadcast(v.where("id = 1").select(F.col("embedding").alias("q")))  # one row
    pool = v.where("id <> 1").crossJoin(wanted).select("id", text.cosine(F.col("embedding"), F.col("q")).alias("score"))
    return retrieval.adaptive_cutoff(pool, "score", 0.15).withColumn("score", F.round("score", 6))


@query("""
WITH k AS (SELECT o_orderkey, o_orderkey % 9 AS k, o_custkey % 150 AS n FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN '117:hr-' || n || ',117:s-7' WHEN 1 THEN '118:hjres-' || n WHEN 2 THEN '118:sjres-' || n WHEN 3 THEN '118:hconres-' || n WHEN 4 THEN '118:sconres-' || n WHEN 5 THEN '118:sres-' || n
  WHEN 6 THEN '118:hr-' || n ELSE '' END AS bills FROM k WHERE n > 0
""")
def bill_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills named in sentences that are made from orders, in every form of citation; short sentences name none."""
    n = (F.col("o_custkey") % 150).cast("string")
    forms = ("The 117th Congress passed H.R. # and also S. 7 then.", "A vote on H.J. R. # was held today.", "A vote on S.J.R. # was held today.", "A vote on H. Con. R. # was held today.", "A vote on S Con R # was held today.")
    forms += ("A vote on S. Res. # was held today.", "See HR #, H.R. # and h.r.# in the record.", "H.R. #", "No bill is named in this text.")
    made = F.element_at(F.array(*map(F.lit, forms)), (F.col("o_orderkey") % 9 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").where("o_custkey % 150 > 0").select("o_orderkey", content.bill_mentions(F.replace(made, F.lit("#"), n)).alias("b"))
    return rows.select("o_orderkey", F.array_join(F.transform("b", lambda b: F.concat(b["congress"].cast("string"), F.lit(":"), b["kind"], F.lit("-"), b["number"].cast("string"))), ",").alias("bills"))


@query("""
SELECT p_partkey, regexp_matches(lower(p_type), '(^|[^a-z0-9])(steel|tin)($|[^a-z0-9])') AS relevant FROM part
""")
def subject_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", search.relevant(F.col("p_type"), ["steel", "tin"], ["metal"]).alias("relevant"))


@query("""
WITH e AS (SELECT c_mktsegment, lower(c_mktsegment) AS w FROM customer GROUP BY 1) SELECT c_mktsegment, CASE WHEN w = 'building' THEN 'building,house,home,buildings' WHEN suffix(w, 's') THEN w || ',' || left(w, length(w) - 1) ELSE w || ',' || w || 's' END AS terms FROM e
""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    return rows.select("c_mktsegment", F.array_join(search.expand(F.array(F.lower("c_mktsegment")), {"building": ["house", "home", "tower"]}), ",").alias("terms"))


@query("""
SELECT user_id, last(value ORDER BY ts, event_id) FILTER (WHERE event_type <> 'view') AS latest, round(epoch(max(ts) - min(ts)), 3) AS seconds FROM events GROUP BY 1
""")
def latest_non_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value that isn't missing (views count as missing), and the span in seconds."""
    value = F.when(F.col("event_type") != "view", F.col("value"))
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    return table(spark, sf_dir, "events").groupBy("user_id").agg(latest_value(value, F.struct("ts", "event_id")).alias("latest"), F.round(span, 3).alias("seconds"))


@query("""
WITH a AS (SELECT doc_id AS id, n_chars AS size, 'long' AS origin FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5), b AS (SELECT page_id AS id, length(html) AS size, 'pages' AS origin FROM pages ORDER BY page_id LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b
""")
def evidence_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.length("html").cast("long").alias("size"))
    return search.evidence([("long", docs, [F.col("size").desc(), F.col("id")], 5), ("pages", pages, [F.col("id")], 5)])


@query("""
SELECT s_suppkey, coalesce(s_acctbal, 0) AS accuracy, count(l_orderkey) AS stories FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_quantity >= 45 GROUP BY 1, 2 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20
""")
def source_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stories = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("stories"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce("s_acctbal", F.lit(0.0)).alias("accuracy")).join(stories, "s_suppkey", "left")
    return rows.select("s_suppkey", "accuracy", F.coalesce("stories", F.lit(0)).cast("long").alias("stories")).orderBy(F.col("accuracy").desc(), F.col("stories").desc(), "s_suppkey").limit(20)


@query()
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of all vectors with a fixed seed; sizes of the clusters. Labels depend on the library, so no SQL states them."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=10, seed=42, maxIter=20).fit(rows)
    return model.transform(rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


@query()
def chosen_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of all vectors with the number of clusters, up to ten, that has the best silhouette; no SQL states it."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    k, found = retrieval.best_clusters(written(rows, "vectors"), "features")
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k))


@query(r"""
WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}') AS t FROM documents), s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
w AS (SELECT id, n, w, count(*) AS tf FROM (SELECT id, len(t) AS n, unnest(t) AS w FROM d) GROUP BY 1, 2, 3), f AS (SELECT w, count(*) AS df FROM w GROUP BY 1),
p AS (SELECT id, w, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS x FROM w JOIN f USING (w), s),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(left(text, 60)), '[a-z0-9]{2,}')) AS w FROM benchmark),
r AS (SELECT item_id, id, round(sum(x), 9) AS x FROM q JOIN p USING (w) GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, id AS doc_id, round(x, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY x DESC, id) AS rank FROM r) WHERE rank <= 10
""")
def indexed_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the beginning of every benchmark item, from an index with plain words."""
    index = ranking.build(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", stemmed=False)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.left("text", F.lit(60)).alias("text"))
    found = ranking.search(index, asked, 10)
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query()
def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for the beginning of every benchmark item by stems of words; tested against plain Python."""
    index = ranking.build(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.left("text", F.lit(60)).alias("text"))
    return ranking.search(index, asked, 5)
