"""Queries over texts: cleaning, hashes, duplicate groups, similarity, tokens, scores, dates in texts, JSON and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import dates, scores, text
from tidewater.operators import counts
from tidewater.operators.windows import top_per_group
from tidewater.plans.registry import SQL, query
from tidewater.sources.tables import table

_NORMAL = r"""regexp_replace(trim(regexp_replace(replace(translate(regexp_replace(lower(coalesce(text, '')), '<[^>]*>', '', 'g'), '‘’“”–—', '''''""--'), '…', '...'), '[\x20\x09-\x0D\xA0]+', ' ', 'g')), '\x20+([.,;:!?])', '\1', 'g')"""
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_N = f"len({_WORDS})"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT sha256('|' || {_NORMAL}) AS content_hash, count(*) AS n, min(doc_id) AS first_doc, list_sort(list(doc_id)) AS docs FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose normalised texts agree."""
    keyed = documents(spark, sf_dir).select("doc_id", text.content_hash(F.lit(""), F.col("text")).alias("content_hash"))
    per = keyed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.sort_array(F.collect_list("doc_id")).alias("docs"))
    return per.where("n > 1")


@query("""
WITH p AS (SELECT page_id, lower(regexp_replace(url, '#.*$', '')) AS u FROM pages), q AS (SELECT page_id, string_split(u, '?')[1] AS base, CASE WHEN contains(u, '?') THEN substr(u, strpos(u, '?') + 1) ELSE '' END AS query FROM p),
k AS (SELECT page_id, base, list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, 'utm_|fbclid|gclid|ref')) AS kept FROM q)
SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM k
""")
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.normalise_url(F.col("url")).alias("url"))


@query("""
WITH p AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) SELECT host, count(*) AS n, min(page_id) AS first_page FROM p GROUP BY 1 HAVING count(*) > 1
""")
def url_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]*)", 1)
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  'https?://[^\x20\x09-\x0D]+|www\.[^\x20\x09-\x0D]+', ' ', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+', ' ', 'g'), '&[A-Za-z]+;|&#[0-9]+;', ' ', 'g') AS t FROM pages)
SELECT page_id, trim(regexp_replace(t, '[\x20\x09-\x0D\xA0]+', ' ', 'g')) AS clean FROM a
""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("clean"))


@query(f"""
SELECT doc_id, {_N} AS n_words, round(CASE WHEN coalesce(text, '') = '' THEN 0.0 WHEN {_N} < 50 THEN 0.1 WHEN {_N} < 200 THEN 0.3 + ({_N} - 50) / 150 * 0.4 WHEN {_N} <= 2000 THEN 0.7 + ({_N} - 200) / 1800 * 0.3
  WHEN {_N} <= 5000 THEN 1.0 - ({_N} - 2000) / 3000 * 0.2 ELSE 0.8 END, 6) AS early, round(CASE WHEN {_N} > 1000 THEN greatest(0.3, 1.0 - ({_N} - 1000) / 5000) WHEN {_N} >= 200 THEN 1.0 WHEN {_N} >= 100 THEN 0.7 WHEN {_N} >= 50 THEN 0.4 ELSE 0.1 END, 6) AS scorer FROM documents
""")
def length_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", text.word_count(t).cast("long").alias("n_words"), F.round(scores.length_score(t), 6).alias("early"), F.round(scores.scorer_length(t), 6).alias("scorer"))


_SYL = r"list_sum(list_transform({w}, lambda w: greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')) - CASE WHEN suffix(lower(w), 'e') AND len(regexp_extract_all(lower(w), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)))".format(w=_WORDS)
_SENT = r"len(list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: trim(regexp_replace(s, '[\x09-\x0D]', ' ', 'g')) <> ''))"


@query(f"""
WITH c AS (SELECT doc_id, {_N} AS n, {_SENT} AS s, {_SYL} AS y, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]')) AS l, len(list_filter({_WORDS}, lambda w: len(regexp_extract_all(lower(w), '[aeiouy]+')) >= 3)) AS h FROM documents),
f AS (SELECT *, 206.835::DOUBLE - 1.015::DOUBLE * (n / s) - 84.6::DOUBLE * (y / n) AS flesch, list_filter([0.39::DOUBLE * (n / s) + 11.8::DOUBLE * (y / n) - 15.59, 0.4::DOUBLE * (n / s + 100 * (h / n)), 1.043::DOUBLE * sqrt(h) + 3.1291,
  4.71::DOUBLE * (l / n) + 0.5::DOUBLE * (n / s) - 21.43, 0.0588::DOUBLE * (100 * (l / n)) - 0.296::DOUBLE * (100 * (s / n)) - 15.8], lambda g: g > 0) AS above FROM c WHERE n > 0 AND s > 0)
SELECT doc_id, round(CASE WHEN len(above) > 0 THEN list_sum(above) / len(above) ELSE 0 END, 6) AS mean_grade, round(flesch, 6) AS flesch, round(0.39::DOUBLE * (n / s) + 11.8::DOUBLE * (y / n) - 15.59, 6) AS flesch_kincaid, round(0.4::DOUBLE * (n / s + 100 * (h / n)), 6) AS fog, round(1.043::DOUBLE * sqrt(h) + 3.1291, 6) AS smog,
  round(4.71::DOUBLE * (l / n) + 0.5::DOUBLE * (n / s) - 21.43, 6) AS ari, round(0.0588::DOUBLE * (100 * (l / n)) - 0.296::DOUBLE * (100 * (s / n)) - 15.8, 6) AS coleman_liau,
  CASE WHEN flesch >= 80 THEN 1.0 WHEN flesch >= 60 THEN 0.9 WHEN flesch >= 40 THEN 0.8 WHEN flesch >= 20 THEN 0.6 ELSE 0.3 END::DOUBLE AS tier FROM f
""")
def readability_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = scores.readability_counts(documents(spark, sf_dir).select("doc_id", "text"), "text")
    f = scores.flesch_of(counts)
    out = counts.withColumn("f", f).where("f is not null")
    grades = {k: F.round(v, 6) for k, v in scores.grades_of(out).items()}
    return out.select("doc_id", F.round("f", 6).alias("flesch"), *(v.alias(k) for k, v in grades.items()), scores.tier(F.col("f"), scores.READABILITY_TIERS, 0.3).alias("tier"))


_COMMON = ", ".join(f"'{w}'" for w in scores.COMMON_WORDS)
_VALID = r"list_filter(string_split_regex(coalesce(text, ''), '[.!?]+'), lambda s: length(regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) > 10)"


@query(rf"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS text, list_transform({_VALID}, lambda s: len(regexp_extract_all(s, '[^\x20\x09-\x0D]+'))::DOUBLE) AS v,
  list_filter(regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+'), lambda w: length(w) > 2 AND NOT list_contains([{_COMMON}], w)) AS k, string_split(coalesce(text, ''), chr(10) || chr(10)) AS p,
  len(string_split_regex(coalesce(text, ''), '[.!?]+')) AS s, {_N} AS n FROM documents),
d AS (SELECT *, len(list_distinct(k)) / nullif(len(k), 0) AS share, list_sum(list_transform(v, lambda x: x * x)) / len(v) - (list_sum(v) / len(v)) * (list_sum(v) / len(v)) AS var FROM c)
SELECT doc_id, round(CASE WHEN len(p) > 1 THEN 0.3 ELSE 0 END + CASE WHEN len(v) >= 3 THEN 0.3 ELSE 0 END + CASE WHEN len(v) > 1 AND var > 10 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '[A-Z]') THEN 0.2 ELSE 0 END, 6)::DOUBLE AS structure,
  CASE WHEN len(k) = 0 THEN 0.0 WHEN share < 0.3 THEN 0.2 WHEN share < 0.5 THEN 0.5 WHEN share < 0.7 THEN 0.8 ELSE 1.0 END::DOUBLE AS uniqueness,
  round(0.2::DOUBLE + CASE WHEN length(p[1]) > 50 THEN 0.2 ELSE 0 END + CASE WHEN length(p[-1]) > 30 THEN 0.2 ELSE 0 END + CASE WHEN n > 100 THEN 0.2 ELSE 0 END + CASE WHEN s >= 5 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS completeness FROM d
""")
def structure_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select(
        "doc_id", F.round(scores.structure_score(t), 6).alias("structure"), scores.uniqueness_score(t).alias("uniqueness"), F.round(scores.completeness_score(t, F.lit("a title")), 6).alias("completeness")
    )


_LETTERS = r"regexp_replace(lower(coalesce(text, '')), '[^a-z\x20\x09-\x0D]', '', 'g')"


@query(rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all({_LETTERS}, '[a-z]+')) AS w, generate_subscripts(regexp_extract_all({_LETTERS}, '[a-z]+'), 1) AS i FROM documents),
c AS (SELECT doc_id, i, 1 + len(regexp_extract_all(w, '[^aeiouy][aeiouy]')) - suffix(w, 'e')::INT AS k FROM w),
s AS (SELECT doc_id, sum(CASE WHEN i = 1 THEN greatest(k, 1) ELSE k END) AS y FROM c GROUP BY 1)
SELECT doc_id, coalesce(y, 0)::BIGINT AS syllables FROM documents LEFT JOIN s USING (doc_id)
""")
def plain_syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", scores.plain_syllables(F.col("text")).cast("long").alias("syllables"))


_STEPS = " ".join(f"WHEN score >= {bound} THEN '{name}'" for bound, name in ((0.9, "A+"), (0.8, "A"), (0.7, "B+"), (0.6, "B"), (0.5, "C+"), (0.4, "C"), (0.3, "D")))


@query(rf"""
WITH q AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, string_split_regex(coalesce(text, ''), '[.!?]+') AS s FROM documents),
o AS (SELECT *, len(list_filter(w, lambda x: len(list_filter(range(1, length(x) - 1), lambda i: x[i] = x[i + 1] AND x[i] = x[i + 2])) > 0)) AS odd FROM q),
l AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '[.!?]') THEN 0.2 ELSE 0 END::DOUBLE + CASE WHEN regexp_matches(t, '[A-Z]') THEN 0.2 ELSE 0 END::DOUBLE
  + CASE WHEN len(w) = 0 THEN 0 WHEN odd = 0 THEN 0.2 WHEN odd <= len(w) * 0.01 THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN len(list_filter(s, lambda x: length(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) > 5)) >= 3 THEN 0.2 ELSE 0 END::DOUBLE
  + CASE WHEN len(list_distinct(list_filter(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+'), lambda x: length(x) > 3))) > 20 THEN 0.2 ELSE 0 END::DOUBLE AS language FROM o),
z AS (SELECT doc_id, CASE WHEN t = '' THEN 0::DOUBLE ELSE 0.15::DOUBLE * scorer + 0.2::DOUBLE * CASE WHEN flesch >= 80 THEN 1.0 WHEN flesch >= 60 THEN 0.8 WHEN flesch >= 40 THEN 0.6 WHEN flesch >= 20 THEN 0.4 WHEN flesch IS NULL THEN 0.0 ELSE 0.2 END::DOUBLE
  + 0.15::DOUBLE * structure + 0.15::DOUBLE * uniqueness + 0.15::DOUBLE * completeness + 0.2::DOUBLE * round(language, 6) END AS score
  FROM l JOIN ({SQL["length_scores"]}) a USING (doc_id) JOIN ({SQL["structure_scores"]}) b USING (doc_id) LEFT JOIN ({SQL["readability_suite"]}) c USING (doc_id))
SELECT doc_id, round(score, 3) AS score, CASE {_STEPS} ELSE 'F' END AS grade FROM (SELECT doc_id, round(score, 9) AS score FROM z)
""")
def content_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blended score of every document over six dimensions, and its grade; an empty text scores 0."""
    t = F.col("text")
    rows = counts.counted(documents(spark, sf_dir).select("doc_id", "text"), "text", "words", "sentences", "syllables", "telling", "distinct_telling", "distinct_long")
    n = F.col("words")
    rows = rows.withColumns({"ease": scores.ease(n, F.col("sentences"), F.col("syllables")), "share": F.when(F.col("telling") > 0, F.col("distinct_telling") / F.col("telling"))})
    readable = scores.readability_of(F.col("ease"), scores.SCORER_READABILITY_TIERS, 0.2)
    dimensions = (scores.scorer_length_of(n), readable, scores.structure_score(t), scores.uniqueness_of(F.col("share")), scores.completeness_score(t, F.lit("a title"), n), scores.language_quality(t, n, F.col("distinct_long")))
    score = F.when(F.coalesce(t, F.lit("")) == "", 0.0).otherwise(scores.content_score(*(F.round(c, 6) for c in dimensions)))
    rows = rows.select("doc_id", F.round(score, 9).alias("score"))
    return rows.select("doc_id", F.round("score", 3).alias("score"), scores.grade(F.col("score")).alias("grade"))


# letters outside ASCII as underscores, which are part of words for both engines
_SAFE = r"regexp_replace(coalesce(text, ''), '[^\x00-\x7F\P{L}]', '_', 'g')"


@query(rf"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS text, {_N} AS n, len(regexp_extract_all({_SAFE}, '\b[a-zA-Z]+\b')) AS e, len(regexp_extract_all({_SAFE}, '\b[A-Z][a-z]+\b')) AS p FROM documents),
t AS (SELECT doc_id, max(k) AS top FROM (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS w FROM c) WHERE length(w) > 3 GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, round(CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, 0.6::DOUBLE * (e / n) + 0.4::DOUBLE * (p / greatest(e, 1)) - least(coalesce(top, 0) / n, 0.5))) END, 6) AS language FROM c LEFT JOIN t USING (doc_id)
""")
def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.round(scores.language_score(F.col("text")), 6).alias("language"))


@query(rf"""
WITH c AS (SELECT doc_id, coalesce(text, '') AS t, {_N} AS n FROM documents),
s AS (SELECT *, len(list_filter(string_split(t, '.'), lambda x: regexp_matches(x, '(?is)^[^a-z]*[a-z].+\sSaid\s'))) + len(list_filter(string_split(t, '.'), lambda x: regexp_matches(x, '(?is)^[^a-z]*[a-z].+\sTold\s')))
  + len(regexp_extract_all(t, '(?i)according to [A-Za-z][^.,]+')) + len(regexp_extract_all(t, '(?i)per\s+[A-Za-z]')) + len(regexp_extract_all(t, '(?i)citing\s+[A-Za-z]')) + len(regexp_extract_all(t, '[0-9]{{1,4}}[-/][0-9]{{1,2}}[-/][0-9]{{2,4}}'))
  + len(regexp_extract_all(t, '\b[0-9]+(?:\.[0-9]+)?%')) + len(regexp_extract_all(t, '\b[0-9]{{2,}}\b')) + (length(t) - length(replace(t, '"', ''))) // 2 + (length(t) - length(replace(t, '''', ''))) // 2 AS k FROM c)
SELECT doc_id, CASE WHEN n > 0 THEN round(least(1.0, k / greatest(n / 80.0, 1.0) * 0.4), 4) ELSE 0.0 END::DOUBLE AS density FROM s
""")
def fact_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", scores.fact_density(F.col("text")).alias("density"))


@query(r"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')) AS word FROM documents), c AS (SELECT word, count(*) AS n FROM w WHERE word NOT IN (SELECT unnest(%s)) GROUP BY 1)
SELECT word, n, round(least(n / 15.0, 1.0), 6) AS relevance, least(10 * n, 100) AS size FROM c ORDER BY n DESC, word LIMIT 100
""" % str(list(text.STOP_WORDS)))
def word_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred commonest words, with relevance and the size in a word cloud."""
    found = documents(spark, sf_dir).select(F.explode(text.keywords(F.col("text"), 4, None)).alias("word"))
    top = found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(100)
    return top.select("word", "n", F.round(F.least(F.col("n") / 15.0, F.lit(1.0)), 6).alias("relevance"), F.least(10 * F.col("n"), F.lit(100)).alias("size"))


@query(r"""
WITH t AS (SELECT list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'), lambda w: NOT list_contains(%s, w)) AS w FROM documents),
g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM t WHERE len(w) > 1)
SELECT phrase, count(*) AS n FROM g WHERE length(phrase) > 8 GROUP BY 1 HAVING count(*) >= 20
""" % str(list(text.STOP_WORDS)))
def phrase_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word phrases over the words that remain without stop words, in at least twenty places."""
    grams = text.word_grams(F.col("w"), 2)
    rows = documents(spark, sf_dir).select(text.keywords(F.col("text"), 3, None).alias("w")).select(F.explode(grams).alias("phrase"))
    return rows.where(F.length("phrase") > 8).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query(r"""
WITH t AS (SELECT source, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}'))) AS term FROM documents),
c AS (SELECT source, term, count(*) AS n FROM t WHERE term NOT IN (SELECT unnest(%s)) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term)::INTEGER AS rank FROM c)
SELECT * FROM r WHERE rank <= 5
""" % str(list(text.STOP_WORDS)))
def narrative_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five terms that most documents of each source hold."""
    terms = documents(spark, sf_dir).select("source", F.explode(text.keywords(F.col("text"), 4, None, distinct=True)).alias("term"))
    return top_per_group(terms.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n")), ["source"], [F.col("n").desc(), F.col("term")], 5)


@query(r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark), p AS (SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(list_concat(x.w, y.w))) AS s FROM b x JOIN b y ON x.item_id < y.item_id)
SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.06
""")
def title_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of short texts whose word sets overlap by six in a hundred; candidates share a word of their rarer ones."""
    from tidewater.operators.dedup import jaccard_pairs

    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_distinct(text.words(F.lower("text"))).alias("tokens"))
    return jaccard_pairs(rows, 0.06).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(r"""
WITH g AS (SELECT p_partkey, list_sort(list_distinct(list_transform(range(1, length(p_name)), lambda i: substr(lower(p_name), i, 2)))) AS g FROM part), k AS (SELECT p_partkey, g, min(p_partkey) OVER (PARTITION BY g) AS rep FROM g WHERE len(g) > 0),
r AS (SELECT p_partkey, g FROM k WHERE p_partkey = rep), p AS (SELECT x.p_partkey AS a, y.p_partkey AS b, 2.0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) AS d FROM r x JOIN r y ON x.p_partkey < y.p_partkey)
SELECT a, b, round(d, 6) AS similarity FROM p WHERE d > 0.85 UNION ALL SELECT rep, p_partkey, 1.0 FROM k WHERE p_partkey <> rep
""")
def bigram_dice_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names whose character bigrams agree by more than 0.85 (Dice); names of equal bigrams are paired with the first of them alone."""
    from tidewater.operators.dedup import dice_classes

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.grams(F.lower("p_name"), 2).alias("tokens"))
    return dice_classes(rows, 0.85).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT c_custkey, regexp_replace(trim(regexp_replace(c_name, '[#0-9]+', ' ', 'g')), '\\s+', ' ', 'g') AS name, sha256(lower(c_mktsegment) || '::' || lower(c_name) || '|' || lower(c_mktsegment) || '::unknown::unknown') AS fingerprint FROM customer WHERE lower(c_name) < lower(c_mktsegment) OR lower(c_name) >= lower(c_mktsegment)".replace("lower(c_name) || '|' || lower(c_mktsegment)", "array_to_string(list_sort([lower(c_name), lower(c_mktsegment)]), '|')"))
def event_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.collapse(F.regexp_replace("c_name", "[#0-9]+", " "))
    mark = text.event_fingerprint(F.col("c_mktsegment"), F.array("c_name", "c_mktsegment"), F.lit(None).cast("string"), F.lit(None).cast("date"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), mark.alias("fingerprint"))


@query(r"""
WITH e(i, expr) AS (VALUES (0, 'yesterday'), (1, 'last week'), (2, 'last month'), (3, '3 days ago'), (4, 'two weeks ago'), (5, 'early 2024'), (6, 'q3 2023'), (7, '2022'), (8, 'last year'), (9, 'nothing'), (10, 'this month')),
a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, expr, i FROM orders JOIN e ON o_orderkey % 11 = i)
SELECT o_orderkey, expr, CAST(CASE i WHEN 0 THEN d - 1 WHEN 1 THEN d - 7 WHEN 2 THEN date_trunc('month', d) - INTERVAL 1 MONTH WHEN 3 THEN d - 3 WHEN 4 THEN d - 14 WHEN 5 THEN DATE '2024-01-01' WHEN 6 THEN DATE '2023-07-01' WHEN 7 THEN DATE '2022-01-01'
  WHEN 8 THEN make_date(year(d) - 1, 1, 1) WHEN 10 THEN date_trunc('month', d) END::DATE AS VARCHAR) AS resolved, ['exact', 'week', 'month', 'exact', 'week', 'quarter', 'quarter', 'year', 'year', 'unknown', 'month'][i + 1] AS precision FROM a
""")
def temporal_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative dates of each order's day, one of eleven expressions by its key."""
    exprs = F.array(*map(F.lit, ("yesterday", "last week", "last month", "3 days ago", "two weeks ago", "early 2024", "Q3 2023", "2022", "last year", "nothing", "this month")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.element_at(exprs, (F.col("o_orderkey") % 11 + 1).cast("int")).alias("expr"))
    rows = rows.withColumn("r", dates.resolve(F.col("expr"), F.col("d")))
    return rows.select("o_orderkey", F.lower("expr").alias("expr"), F.col("r.date").cast("string").alias("resolved"), "r.precision")


@query("""
WITH m AS (SELECT max(ts) AS as_of FROM events), a AS (SELECT event_id, epoch(as_of - ts) / 3600 AS h, ts FROM events, m)
SELECT event_id, CASE WHEN h <= 1 THEN 1.0 WHEN h <= 6 THEN 0.9 WHEN h <= 24 THEN 0.8 WHEN h <= 72 THEN 0.6 WHEN h <= 168 THEN 0.4 ELSE 0.2 END::DOUBLE AS freshness,
  CASE WHEN h <= 1 THEN 1.0 WHEN h <= 6 THEN 0.95 WHEN h <= 24 THEN 0.85 WHEN h <= 72 THEN 0.65 WHEN h <= 168 THEN 0.45 WHEN h <= 336 THEN 0.25 WHEN h <= 720 THEN 0.1 ELSE 0.0 END::DOUBLE AS proximity,
  CAST((date_trunc('week', ts) - INTERVAL 7 DAY)::DATE AS VARCHAR) AS week_start FROM a
""")
def freshness_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "ts")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("ts").alias("as_of"))))
    week = dates.last_completed_week(F.to_date("ts"))["monday"].cast("string")
    return rows.select("event_id", scores.freshness(F.col("ts"), F.col("as_of")).alias("freshness"), scores.proximity(F.col("ts"), F.col("as_of")).alias("proximity"), week.alias("week_start"))


@query("""
SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2
""")
def json_key_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return table(spark, sf_dir, "events").select(k.alias("k"), "event_type", "value").where("k is not null").groupBy("k", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("""
WITH u AS (SELECT user_id, '[' || string_agg(props, ',' ORDER BY event_id) || ']' AS doc FROM events GROUP BY 1), x AS (SELECT user_id, CAST(json_extract_string(e, '$.k') AS INTEGER) AS k FROM (SELECT user_id, unnest(CAST(doc AS JSON[])) AS e FROM u))
SELECT user_id, count(*) AS n, count(DISTINCT k) AS kinds, sum(k)::BIGINT AS total FROM x GROUP BY 1
""")
def json_array_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays taken apart again: explode of from_json, with a key test."""
    doc = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda s: s["props"]), ","), F.lit("]"))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(doc.alias("doc")).where(F.json_array_length("doc") > 0)
    rows = per.select("user_id", F.explode(F.from_json("doc", "array<struct<k:int>>")).alias("e")).where("e.k is not null")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("e.k").alias("kinds"), F.sum("e.k").alias("total"))


@query("""
WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS f FROM lineitem GROUP BY 1)
SELECT array_to_string(f, '') AS flags, count(*) AS n, count(*) FILTER (WHERE list_has_any(f, ['R', 'X'])) AS overlaps, count(*) FILTER (WHERE list_has_all(f, ['A', 'R'])) AS holds FROM s GROUP BY 1
""")
def array_overlap_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("f"))
    want = F.array(F.lit("A"), F.lit("R"))
    return s.groupBy(F.array_join("f", "").alias("flags")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.arrays_overlap("f", F.array(F.lit("R"), F.lit("X")))).alias("overlaps"), F.count_if(F.size(F.array_except(want, F.col("f"))) == 0).alias("holds")
    )


@query(r"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, round(CASE WHEN g + b = 0 THEN 0.0 ELSE (g - b) / (g + b) END, 6) AS sentiment FROM (
  SELECT doc_id, (length(t) - length(replace(t, 'the', ''))) / 3.0 AS g, (length(t) - length(replace(t, 'que', ''))) / 3.0 + (length(t) - length(replace(t, 'en', ''))) / 2.0 AS b FROM d)
""")
def lexicon_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.round(scores.lexicon_sentiment(F.col("text"), ["the"], ["que", "en"]), 6).alias("sentiment"))


@query(r"""
WITH k AS (SELECT unnest(['token', 'trash', 'license', 'idiot']) AS keyword), m AS (SELECT doc_id, keyword, ((length(t) - length(replace(t, keyword, ''))) / length(keyword))::INTEGER AS n FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), k)
SELECT doc_id, keyword, n AS occurrences, round(least(1.0, 0.5 + 0.1 * (n - 1)), 4)::DOUBLE AS significance FROM m WHERE n > 0
""")
def watch_pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched keywords in texts, with how often they stand there."""
    watched = F.explode(F.array(*map(F.lit, ("token", "trash", "license", "idiot"))))
    rows = documents(spark, sf_dir).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"), watched.alias("keyword"))
    rows = rows.select("doc_id", "keyword", text.occurrences(F.col("t"), F.col("keyword")).alias("occurrences")).where("occurrences > 0")
    return rows.withColumn("significance", F.round(F.least(F.lit(1.0), 0.5 + 0.1 * (F.col("occurrences") - 1)), 4))


@query(r"""
WITH m AS (SELECT doc_id, source, n_chars, (CASE WHEN contains(lower(text), 'with') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'that') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'entre') THEN 1 ELSE 0 END)::INTEGER AS hits FROM documents)
SELECT doc_id, hits FROM m WHERE hits > 0 ORDER BY hits DESC, n_chars DESC, doc_id LIMIT 25
""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewater.operators.retrieval import keyword_search as search

    return search(documents(spark, sf_dir), "text", ["with", "that", "entre"], [F.col("n_chars").desc(), F.col("doc_id")], 25).select("doc_id", "hits")


@query("""
SELECT source, count(*) AS docs, round(avg(n_chars), 4) AS avg_chars, round(coalesce(sum(toxic) FILTER (WHERE quality = 1), 0) / count(*)::DOUBLE, 6) AS diluted FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
""")
def bias_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An average over all requested rows, so that rows without a value dilute it."""
    rows = documents(spark, sf_dir).select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    total = F.coalesce(F.sum(F.when(F.col("quality") == 1, F.col("toxic"))), F.lit(0))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("n_chars"), 4).alias("avg_chars"), F.round(total / F.count(F.lit(1)), 6).alias("diluted"))


@query("""
SELECT conv_id, turn, role, coalesce(lag(role) OVER w, 'none') AS previous_role, length(text) AS chars, (sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
""")
def conversation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce(F.lag("role").over(over), F.lit("none")).alias("previous_role"), F.length("text").cast("long").alias("chars"), F.sum(F.length("text")).over(over).alias("so_far"))
