"""Queries over chunks, phrase lists, versioned upserts and bulk loads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.chunking import chunks_at_breaks
from tidewater.operators import phrases
from tidewater.operators.versions import VersionedTable
from tidewater.operators.work import shared_dir
from tidewater.plans.registry import query
from tidewater.sources import dumps
from tidewater.sources.tables import table

_BLANK = r"[\x20\x09-\x0D]+"


@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^{_BLANK}|{_BLANK}$', '', 'g') AS t FROM documents),
r AS (SELECT doc_id, t, 0 AS s, 0 AS e, 0 AS n FROM d WHERE t <> '' UNION ALL SELECT doc_id, t, s, CASE WHEN s + 400 >= length(t) THEN length(t) WHEN p > 0 THEN s + p + 2 WHEN l > 0 THEN s + l + 1 WHEN f > 0 THEN s + f + 2 WHEN b > 0 THEN s + b + 1 ELSE s + 400 END, n + 1
  FROM (SELECT *, length(regexp_extract(w, '(?s)^(.+)\n\n', 1)) AS p, length(regexp_extract(w, '(?s)^(.+)\n', 1)) AS l, length(regexp_extract(w, '(?s)^(.+)[.] ', 1)) AS f, length(regexp_extract(w, '(?s)^(.+) ', 1)) AS b
    FROM (SELECT doc_id, t, n, CASE WHEN n = 0 THEN 0 WHEN e - 50 > s THEN e - 50 ELSE e END AS s, substr(t, CASE WHEN n = 0 THEN 0 WHEN e - 50 > s THEN e - 50 ELSE e END + 1, 401) AS w FROM r WHERE n = 0 OR e < length(t))))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS pos, md5(c) AS chunk_md5 FROM (SELECT doc_id, n, regexp_replace(substr(t, s + 1, e - s), '^{_BLANK}|{_BLANK}$', '', 'g') AS c FROM r WHERE n > 0) WHERE c <> ''
""")
def natural_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 400 characters at most that end at paragraphs, lines, sentences or words, 50 characters into each other."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks_at_breaks(F.col("text"), 400, 50)).alias("pos", "chunk"))
    return rows.select("doc_id", "pos", F.md5("chunk").alias("chunk_md5"))


@query(r"""
WITH d AS (SELECT doc_id, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents), g AS (SELECT DISTINCT doc_id, lang, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d),
i AS (SELECT item_id % 3 AS l, CASE WHEN item_id % 5 = 0 THEN 'en' END AS lang, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
p AS (SELECT DISTINCT l, lang, w[k] || ' ' || w[k + 1] AS g FROM (SELECT *, unnest(range(1, len(w))) AS k FROM i) UNION SELECT DISTINCT l, lang, w[len(w)] FROM i WHERE len(w) > 0),
h AS (SELECT doc_id, l, p.g FROM g JOIN p USING (g) WHERE p.lang = g.lang OR p.lang IS NULL AND NOT (coalesce(g.lang, '') = 'en' AND l IN (SELECT l FROM p WHERE lang = 'en')))
SELECT doc_id, 'list' || l AS list, count(*) AS phrases FROM h GROUP BY 1, 2
""")
def phrase_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists of all word pairs and last words of benchmark items, some for English alone, against all documents."""
    words = F.col("w")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    items = table(spark, sf_dir, "benchmark").select("item_id", phrases.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select(
        F.concat(F.lit("list"), (F.col("item_id") % 3).cast("string")).alias("list"), F.when(F.col("item_id") % 5 == 0, "en").alias("domain"),
        F.explode(F.concat(pairs, F.slice(words, -1, 1))).alias("phrase"), F.lit(1.0).alias("weight"),
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), "text")
    return phrases.phrase_hits(docs, items).select(F.col("id").alias("doc_id"), "list", "phrases")


@query("""
WITH m AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS total FROM orders WHERE o_orderkey % 4 <> 3 OR o_orderkey % 3 = 0)
SELECT o_custkey, count(*) AS n, round(sum(total), 2) AS total FROM m GROUP BY 1
""")
def versioned_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders committed to a versioned table, a second batch that changes some and adds some, and that batch once more."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("total"))
    kept = VersionedTable(spark, f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}", "o_orderkey long, o_custkey long, total double", ["o_orderkey"], 16)
    kept.commit(rows.where("o_orderkey % 4 <> 3"), "first")
    second = rows.where("o_orderkey % 3 = 0").withColumn("total", F.col("total") * 2)
    kept.commit(second, "second")
    kept.commit(second, "second")
    return kept.read().groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("SELECT c_mktsegment, count(*) AS n, min(c_custkey) AS least, max(c_custkey) AS most FROM customer GROUP BY 1")
def xml_bulk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as an XML dump, read back in parts and counted."""
    path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").write.format("xml").option("rowTag", "row").option("rootTag", "rows").save(path)
    rows, _ = dumps.xml_rows(spark, path, "row", "c_custkey long, c_mktsegment string")
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("least"), F.max("c_custkey").alias("most"))
