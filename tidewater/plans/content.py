"""Queries over content scores, fuzzy names, event deduplication and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.functions import adverts, content, priorities, scores, text
from tidewater.operators import counts, dedup, events
from tidewater.operators.windows import top_per_group
from tidewater.plans.registry import query
from tidewater.sources.tables import table

_TITLES = ("You won't believe this", "Filing: you won't believe this", "10 things you need to know", "Quarterly report", "A market going viral", "Official statement going viral")


@query("""
WITH t AS (SELECT o_orderkey, ['You won''t believe this', 'Filing: you won''t believe this', '10 things you need to know', 'Quarterly report', 'A market going viral', 'Official statement going viral'][o_orderkey % 6 + 1] AS title FROM orders)
SELECT title, count(*) AS n, title IN ('You won''t believe this', '10 things you need to know', 'A market going viral') AS clickbait FROM t GROUP BY 1
""")
def clickbait_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(title.alias("title"))
    return rows.groupBy("title", content.is_clickbait(F.col("title")).alias("clickbait")).agg(F.count(F.lit(1)).alias("n")).select("title", "n", "clickbait")


_Q = lambda term: term.replace("'", "''")
_BAIT = " OR ".join(f"regexp_matches(low, '{_Q(p)}')" for p in (x.replace("\\'", "'") for x in content.CLICKBAIT))
_OFFICIAL = " OR ".join(f"contains(low, '{_Q(t)}')" for t in content.OFFICIAL)
_MARKS = lambda patterns: " + ".join(f"regexp_matches(title, '(?i){_Q(p)}')::INT" for p in patterns)
_FELT = " + ".join(f"contains(lower(text), '{w}')::INT" for w in content.EMOTIONAL)


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, split_part(coalesce(text, ''), '.', 1) AS title FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n, {_FELT} AS felt, lower(title) AS low, {_MARKS(content.HEADLINE_TRIGGERS)} AS heads, {_MARKS(content.VAGUE_TITLES)} AS vague FROM d)
SELECT doc_id, round(least(1.0::DOUBLE, CASE WHEN ({_BAIT}) AND NOT ({_OFFICIAL}) THEN 0.4 ELSE 0 END::DOUBLE + 0.15::DOUBLE * heads + 0.12::DOUBLE * vague
  + CASE WHEN n > 0 THEN least(0.25::DOUBLE, felt / greatest(n / 100.0::DOUBLE, 1.0::DOUBLE) * 0.5::DOUBLE) ELSE 0 END + CASE WHEN n < 200 THEN 0.2 ELSE 0 END::DOUBLE), 6) AS clickbait FROM c
""")
def clickbait_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clickbait of every document, whose first sentence stands for a title."""
    title = F.substring_index("text", ".", 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(content.clickbait_score(title, F.col("text")), 6).alias("clickbait"))


_ANY = lambda at, terms: " OR ".join(f"contains({at}, '{_Q(t)}')" for t in terms)
_CARDS = " OR ".join(f"regexp_matches(title, '{_Q(p)}')" for p in adverts.CARD_TITLES)


@query(rf"""
WITH p AS (SELECT page_id, regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1) AS title, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages),
c AS (SELECT *, lower(title || ' ' || html || ' ' || url) AS t, lower(url) AS u FROM p)
SELECT page_id, NOT ({_ANY("t", adverts.OFFICIAL)}) AND ((length(trim(title)) >= 6 AND ({_CARDS}) AND NOT regexp_matches(lower(title), '{adverts.CARD_NEWS}'))
  OR {_ANY("t", adverts.PLAIN + adverts.FINANCE + adverts.LEGAL + adverts.MEDICINE + adverts.CHATBOTS)} OR {_ANY("u", adverts.SHOP_URLS + adverts.CARD_URLS + adverts.AD_URLS)}) AS advertisement FROM c
""")
def advertisement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page is an advertisement, by its title, markup and address."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", adverts.is_advertisement(title, F.col("html"), F.col("url")).alias("advertisement"))


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, split_part(coalesce(text, ''), '.', 1) AS title FROM documents), c AS (SELECT *, lower(title || ' ' || text || ' ') AS t FROM d)
SELECT doc_id, NOT ({_ANY("t", adverts.OFFICIAL)}) AND ((length(trim(title)) >= 6 AND ({_CARDS}) AND NOT regexp_matches(lower(title), '{adverts.CARD_NEWS}'))
  OR {_ANY("t", adverts.PLAIN + adverts.FINANCE + adverts.LEGAL + adverts.MEDICINE + adverts.CHATBOTS)}) AS advertisement FROM c
""")
def advertisement_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for documents, whose first sentence stands for a title and which have no address."""
    advertisement = adverts.is_advertisement(F.substring_index("text", ".", 1), F.col("text"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", advertisement.alias("advertisement"))


_COUNT = lambda at, terms: " + ".join(f"contains({at}, '{t}')::INT" for t in terms)
_GROUPS = " + ".join(f"CASE WHEN {_ANY('t', terms)} THEN {v} ELSE 0 END::DOUBLE" for terms, v in priorities.IMPORTANT)
_TIERS = " ".join(f"WHEN {_ANY('s', terms)} OR {' OR '.join(f'contains({chr(39)}{t}{chr(39)}, s)' for t in terms)} THEN '{name}'" for name, _, terms in priorities.RELIABLE)


@query(rf"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
d AS (SELECT doc_id, lower(coalesce(d.source, '') || ' ' || coalesce(text, '')) AS w, lower(coalesce(text, '')) AS t, trim(lower(coalesce(d.source, ''))) AS s, coalesce(n, 0) AS n, CASE WHEN regexp_matches(coalesce(text, ''), '[0-9]{{4}}') THEN 1.0 ELSE 0.5 END::DOUBLE AS sure FROM documents d LEFT JOIN n ON n.source = d.source)
SELECT doc_id, round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * ({_COUNT("w", priorities.HIGH)}) + 0.05::DOUBLE * ({_COUNT("w", priorities.MEDIUM)}) + least(n / 50.0::DOUBLE, 0.3::DOUBLE)), 6) AS significance,
  round(least(1.0::DOUBLE, 0.5::DOUBLE + 0.2::DOUBLE * sure + {_GROUPS}), 6) AS importance, CASE WHEN s = '' THEN 'unknown' {_TIERS} ELSE 'tier_4' END AS tier FROM d
""")
def editorial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significance of every document beside others of its source, importance of what it tells, and the tier of its source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = rows.join(rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left")
    sure = F.when(F.coalesce("text", F.lit("")).rlike("[0-9]{4}"), 1.0).otherwise(0.5)
    return rows.select(
        "doc_id", F.round(priorities.significance(F.col("source"), F.col("text"), F.col("n")), 6).alias("significance"),
        F.round(priorities.event_importance(F.col("text"), sure), 6).alias("importance"), priorities.source_reliability(F.col("source"))["tier"].alias("tier"),
    )


_RULES = (priorities.Rule("text", "market", "boost", 75, 0.5), priorities.Rule("text", "error", "suppress", 25), priorities.Rule("category", "en", "track", 50, 0.4))
_COLLECTION = (priorities.Rule("text", "click here", "avoid"), priorities.Rule("category", "de", "boost", 75))


@query("""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(lang, '')) AS c FROM documents),
u AS (SELECT *, 50 + CASE WHEN contains(t, 'market') THEN 37.5 ELSE 0 END - CASE WHEN contains(t, 'error') THEN 25 ELSE 0 END + CASE WHEN contains(c, 'en') THEN 10 ELSE 0 END AS k FROM d),
s AS (SELECT doc_id, greatest(0, least(100, CASE WHEN contains(t, 'click here') THEN 0 ELSE k END + CASE WHEN contains(c, 'de') THEN 22.5 ELSE 0 END))::DOUBLE AS priority FROM u)
SELECT doc_id, priority, CASE WHEN priority >= 75 THEN 'high' WHEN priority >= 50 THEN 'medium' ELSE 'low' END AS level FROM s
""")
def article_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority of every document by rules on its words and language."""
    nothing = F.lit(None).cast("string")
    priority = priorities.article_priority(nothing, F.col("text"), F.col("source"), F.col("lang"), _RULES, _COLLECTION)
    return table(spark, sf_dir, "documents").select("doc_id", priority.alias("priority"), priorities.collection_level(priority).alias("level"))


_N = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


@query(rf"""
SELECT doc_id, round(CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE least(1.0, least(1.0, {_N} / 600.0) * 0.5 + least(0.3, len(list_filter(string_split(text, chr(10)), lambda p: trim(regexp_replace(p, '[\x09-\x0D]', ' ', 'g')) <> '')) * 0.02)
  + CASE WHEN regexp_matches(regexp_replace(lower(text), '[^\x00-\x7F\P{{L}}]', '_', 'g'), '\b(who|what|when|where|why|how)\b') THEN 0.2 ELSE 0.0 END) END, 6)::DOUBLE AS depth,
  round(least(1.0, CASE WHEN regexp_matches(text, '[0-9]+(?:\.[0-9]+)?%|\$[0-9]+|[0-9]+ (?:million|billion|thousand)') THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(text, '[A-Z][a-z]+ [A-Z][a-z]+') THEN 0.35 ELSE 0 END + CASE WHEN regexp_matches(text, '["'']') THEN 0.3 ELSE 0 END), 6)::DOUBLE AS specificity
FROM documents
""")
def depth_and_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(content.depth(F.col("text")), 6).alias("depth"), F.round(content.specificity(F.col("text")), 6).alias("specificity"))


_DESKS = ("Reuters World", "The Guardian", "daily wsj digest", "Local Herald", "CNN", None)


def desks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under six invented names of sources."""
    names = F.array(*(F.lit(d).cast("string") for d in _DESKS))
    return table(spark, sf_dir, "documents").select("doc_id", "text", F.element_at(names, (F.col("doc_id") % 6 + 1).cast("int")).alias("desk"))


@query("""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, CASE WHEN doc_id % 6 IN (0, 2) THEN 0.9 WHEN doc_id % 6 IN (1, 4) THEN 0.75 ELSE 0.3 END AS base FROM documents)
SELECT doc_id, round(least(1.0, least(1.0, base + CASE WHEN regexp_matches(t, 'according to|said a|said the|spokesperson|official') THEN 0.1 ELSE 0 END) + CASE WHEN regexp_matches(t, 'department of|ministry of|university of|institute|bureau of') THEN 0.05 ELSE 0 END), 6)::DOUBLE AS quality FROM d
""")
def source_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desks(spark, sf_dir).select("doc_id", F.round(content.source_quality(F.col("desk"), F.col("text")), 6).alias("quality"))


@query()
def content_quality_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by tier of their content quality, with what each tier is good for; its parts are compared with SQL on their own."""
    t, title, low, n = F.col("text"), F.col("title"), F.col("low"), F.col("words")
    rows = desks(spark, sf_dir).select("doc_id", "desk", "text", F.substring_index("text", ".", 1).alias("title"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    # each measure is a column of its own, so it is worked out once however often a score asks for it
    measures = {
        "signals": scores.fact_signals(t, low), "source": content.source_quality_of(F.col("desk"), low), "lines": content.paragraphs(t), "asking": content.asks(low), "empty": low == "", "specific": content.specificity(t),
        "felt": content.emotional(low), "felt_all": content.emotional(F.concat_ws(" ", F.lower("title"), "low")), "n_title": text.word_count(title),
    }
    rows = counts.counted(rows.select("desk", "title", "text", *(c.alias(k) for k, c in measures.items())), "text", "words").drop("text")
    parts = {
        "bait": content.bait_of(title, n, F.col("felt")), "emotion": content.emotion_of(n + F.col("n_title"), F.col("felt_all")), "density": scores.density_of(n, F.col("signals")),
        "deep": content.depth_of(n, F.col("lines"), F.col("asking"), F.col("empty")),
    }
    bait, felt, density, deep, source, specific = map(F.col, (*parts, "source", "specific"))
    rows = rows.withColumns(parts)
    flags = content.quality_flags(bait, felt, density, source, deep)
    rows = rows.select(content.content_quality_of(density, source, deep, specific, bait, felt).alias("q"), F.size(flags).alias("flags"))
    per = rows.groupBy("q.tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("q.score"), 4).alias("score"), F.sum("flags").alias("flags"))
    return per.withColumn("recommendation", content.recommendation(F.col("tier")))


@query()
def early_quality_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blended early quality of every document and the bounds it fails; its parts are compared with SQL on their own."""
    t, none = F.col("text"), F.lit(None).cast("string")
    latin, proper = scores.latin_words(t)
    # counts and conditions are columns of their own, so each is worked out once however often a score asks for it
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", (F.coalesce(t, F.lit("")) == "").alias("empty"), latin.alias("latin"), proper.alias("proper"))
    rows = counts.counted(rows, "text", "words", "sentences", "plain_syllables", "top")
    n, top = F.col("words"), F.col("top")
    rows = rows.withColumn("ease", scores.ease(n, F.col("sentences"), F.col("plain_syllables")))
    readable = scores.readability_of(F.col("ease"), scores.READABILITY_TIERS, 0.3)
    parts = {"length": scores.length_of(n, F.col("empty")), "source": F.lit(0.5), "readability": readable, "freshness": F.lit(0.5), "language": scores.language_of(n, F.col("latin"), F.col("proper"), top), "spam": scores.spam_score(none, t, none, n, top)}
    rows = rows.select("doc_id", *(c.alias(k) for k, c in parts.items()))
    cols = [F.col(k) for k in parts]
    rows = rows.withColumn("overall", scores.early_quality(*cols))
    return rows.select("doc_id", F.round("overall", 6).alias("overall"), scores.rejection_reasons(F.col("overall"), *cols).alias("reasons"), scores.grade(F.col("overall")).alias("grade"))


@query(r"""
WITH n AS (SELECT s_suppkey AS id, lower(s_name) AS name FROM supplier), w AS (SELECT id, unnest(regexp_extract_all(name, '[a-z0-9]+')) AS w FROM n), g AS (SELECT DISTINCT id, substr('  ' || w || ' ', i, 3) AS g FROM (SELECT id, w, unnest(range(1, length(w) + 2)) AS i FROM w)),
c AS (SELECT id, count(*) AS c, list(g ORDER BY g) AS k FROM g GROUP BY 1), m AS (SELECT id, c, min(id) OVER (PARTITION BY k) AS rep FROM c), r AS (SELECT * FROM g WHERE id IN (SELECT rep FROM m)), p AS (SELECT x.id AS a, y.id AS b, count(*) AS s FROM r x JOIN r y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, round(s::DOUBLE / (ca.c + cb.c - s), 6) AS similarity FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE s::DOUBLE / (ca.c + cb.c - s) >= 0.75 UNION ALL SELECT rep, id, 1.0 FROM m WHERE id <> rep
""")
def trigram_fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names by shared padded trigrams; names of equal trigrams are paired with the first of them alone."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.trigrams(F.col("s_name")).alias("tokens"))
    return dedup.jaccard_classes(rows, 0.75).withColumn("similarity", F.round("similarity", 6))


@query("""
WITH e AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, md5(o_custkey || '-' || CAST(o_orderdate AS DATE) || '-' || o_orderstatus) AS f FROM orders), w AS (SELECT id, first_value(id) OVER (PARTITION BY f ORDER BY day, id) AS canonical FROM e)
SELECT id, canonical FROM w WHERE id <> canonical
""")
def fingerprint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer, day and status, matched to the first."""
    at = F.to_date("o_orderdate")
    mark = F.md5(F.concat_ws("-", F.col("o_custkey").cast("string"), at.cast("string"), "o_orderstatus"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), at.alias("at"), mark.alias("fingerprint"))
    return events.same_fingerprint(rows)


@query("""
WITH e AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, list_distinct(['s' || (l_suppkey % 7), 'p' || (l_partkey % 11), 'c' || o_custkey]) AS ent FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1),
x AS (SELECT id, day, unnest(ent) AS k FROM e), p AS (SELECT a.id, b.id AS other, min(b.day) AS other_at, count(*) AS n FROM x a JOIN x b ON a.k = b.k AND abs(a.day - b.day) <= 30 AND (b.day < a.day OR b.day = a.day AND b.id < a.id) GROUP BY 1, 2 HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, other_at, other) AS r FROM p) SELECT id, other AS canonical FROM r WHERE r = 1
""")
def entity_overlap_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the earlier one, within thirty days, that shares all three of its marks."""
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey", "l_partkey")
    marks = F.array(F.concat(F.lit("s"), (F.col("l_suppkey") % 7).cast("string")), F.concat(F.lit("p"), (F.col("l_partkey") % 11).cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    rows = table(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("at"), marks.alias("entities"))
    return events.same_entities(rows, 3, 30)


@query("""
WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), a AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.user_id = e.user_id AND a.ts >= e.ts - INTERVAL 24 HOUR AND a.ts <= e.ts)
""")
def reactivation_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors without a purchase of the user in the day before: a time-bounded anti join."""
    rows = table(spark, sf_dir, "events")
    return events.not_alerted(rows.where("event_type = 'error'"), rows.where("event_type = 'purchase'"), "user_id", "ts", "ts").select("event_id")


@query("""
SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, round(0.3 * least(count(*) / 10.0, 1.0) + 0.3 * coalesce(avg(quality), 0.5) + 0.2 * least(count(DISTINCT lang) / 5.0, 1.0) + CASE WHEN bool_or(lang = 'de') THEN 0.2 ELSE 0.0 END, 6) AS significance
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1
""")
def alert_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs"), F.coalesce(F.avg("quality"), F.lit(0.5)).alias("q"), F.bool_or(F.col("lang") == "de").alias("de"))
    return per.select("source", "n", "langs", F.round(content.alert_significance(F.col("n"), F.col("q"), F.col("langs"), F.col("de")), 6).alias("significance"))


@query("""
WITH s AS (SELECT user_id, count(*) AS n, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1), v AS (SELECT user_id, n, n / greatest(epoch(b - a) / 3600, 1.0) AS v, date_diff('day', CAST(a AS DATE), CAST(b AS DATE)) AS d FROM s)
SELECT user_id, n, round(v, 6) AS velocity, CASE WHEN v >= 0.1 THEN 'fast' WHEN v >= 0.05 THEN 'steady' ELSE 'slow' END AS tier, d AS span_days FROM v
""")
def impact_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    v = content.velocity(F.col("a"), F.col("b"), F.col("n"))
    return per.select("user_id", "n", F.round(v, 6).alias("velocity"), F.when(v >= 0.1, "fast").when(v >= 0.05, "steady").otherwise("slow").alias("tier"), F.date_diff(F.to_date("b"), F.to_date("a")).cast("long").alias("span_days"))


@query(r"""
WITH t AS (SELECT doc_id, lower(trim(regexp_extract(coalesce(text, ''), '^([^.!?\n]*)', 1))) AS title FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY doc_id) AS n FROM t) SELECT doc_id, title FROM r WHERE n = 1
""")
def title_prededupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each title, live marks cut off."""
    title = events.title_key(F.regexp_extract(F.coalesce("text", F.lit("")), "^([^.!?\\n]*)", 1))
    return top_per_group(table(spark, sf_dir, "documents").select("doc_id", title.alias("title")), ["title"], [F.col("doc_id")], 1).select("doc_id", "title")


@query("""
WITH t AS (SELECT p_brand, p_name, min(p_partkey) AS id, count(*) AS n, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]{2,}')) AS w FROM part GROUP BY ALL), p AS (SELECT x.id AS a, y.id AS b, x.n AS n_a, y.n AS n_b, x.w AS wa, y.w AS wb FROM t x JOIN t y ON x.p_brand = y.p_brand AND x.id < y.id),
q AS (SELECT *, len(list_intersect(wa, wb)) AS s, len(list_distinct(list_concat(wa, wb))) AS u, len(list_intersect(list_transform(range(1, len(wa)), lambda i: wa[i] || ' ' || wa[i + 1]), list_transform(range(1, len(wb)), lambda i: wb[i] || ' ' || wb[i + 1]))) AS c FROM p)
SELECT a, b, n_a, n_b, round(least(1.0, s / u * (1 + greatest(CASE WHEN c > 0 THEN 0.4 ELSE 0.0 END, CASE WHEN s / least(len(wa), len(wb)) >= 0.5 THEN 0.3 ELSE 0.0 END)) + least(1.0, c * 0.5)), 6)::DOUBLE AS similarity FROM q WHERE s > 0
""")
def topic_merge_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar names within a brand, each name once by its smallest key and with its number; candidates share a word, so nothing is paired with all."""
    names = table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("id"), F.count(F.lit(1)).alias("n"))
    posted = names.select("*", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z0-9]{2,}"), F.lit(0)))).alias("word"))
    other = posted.select(F.col("id").alias("b"), "p_brand", F.col("p_name").alias("other"), "word", F.col("n").alias("n_b"))
    pairs = posted.join(other, ["p_brand", "word"]).where("id < b").select(F.col("id").alias("a"), "b", F.col("n").alias("n_a"), "n_b", "p_name", "other").distinct()
    return pairs.select("a", "b", "n_a", "n_b", F.round(content.topic_similarity(F.col("p_name"), F.col("other")), 6).alias("similarity"))


@query("""
WITH b AS (SELECT 'events' AS phase, count(*) FILTER (WHERE event_type = 'error') AS backlog FROM events UNION ALL SELECT 'orders', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders UNION ALL SELECT 'documents', (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)))
SELECT phase, backlog FROM b
""")
def backlog_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each phase still has to do, one row each."""
    t = lambda n: table(spark, sf_dir, n)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("backlog")).select(F.lit(name).alias("phase"), "backlog")
    open_docs = t("documents").select("doc_id").join(t("labels").select("doc_id"), "doc_id", "left_anti")
    return count(t("events").where("event_type = 'error'"), "events").unionByName(count(t("orders").where("o_orderstatus = 'O'"), "orders")).unionByName(count(open_docs, "documents"))


@query("""
WITH m AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), c AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier)
SELECT c_custkey, o_orderkey AS best_order, s_suppkey AS best_supplier FROM customer JOIN m ON m.o_custkey = c_custkey AND m.r = 1 JOIN c ON c.s_nationkey = c_nationkey AND c.r = 1
""")
def best_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with its largest order and the richest supplier of its nation, ties by key."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best_order"))
    supplier = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("best_supplier"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(orders, "c_custkey").join(supplier, "c_nationkey").select("c_custkey", "best_order", "best_supplier")


@query("""
SELECT user_id, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct, dense_rank() OVER (ORDER BY count(*) DESC)::INTEGER AS place FROM events GROUP BY 1
""")
def share_and_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's share of all events and its dense place, from counts by user."""
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    # places are those of distinct counts, of which there are few
    places = per.select("n").distinct().withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc())))
    return per.join(places, "n").crossJoin(F.broadcast(total)).select("user_id", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share_pct"), "place")
