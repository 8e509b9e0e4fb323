"""Edge rows of the operators: empty tables, nulls, ties, thresholds met exactly."""

import datetime as dt
import json
import re

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewater.functions import adverts, content, dates, models, priorities, scores, text
from tidewater.operators import dedup, entities, filters, graph, joins, retrieval, upsert, vectors, windows
from tidewater.sources import explorer, feeds, logs, observations
from tidewater.sources import registry as sources
from tidewater.streaming import windows as streams


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("expression", "wanted", "precision"),
    [
        ("2024-02-29", "2024-02-29", "exact"), ("5 January 2024", "2024-01-05", "exact"), ("Jan 5, 2024", "2024-01-05", "exact"), ("March 2023", "2023-03-01", "month"),
        ("yesterday", "2024-03-30", "exact"), ("last week", "2024-03-24", "week"), ("last month", "2024-02-01", "month"), ("last sunday", "2024-03-24", "exact"),
        ("three months ago", "2023-12-01", "month"), ("a year ago", "2023-01-01", "year"), ("late 2022", "2022-10-01", "quarter"), ("Q2 2021", "2021-04-01", "quarter"),
        ("in 2020", "2020-01-01", "year"), ("2023-02-30", None, "unknown"), ("some day", None, "unknown"), (None, None, "unknown"), ("the day before yesterday", "2024-03-29", "exact"),
    ],
)
def test_resolve(spark, expression, wanted, precision):
    got = one(spark, dates.resolve(F.lit(expression).cast("string"), F.lit("2024-03-31").cast("date")))
    assert (str(got["date"]) if got["date"] else None, got["precision"]) == (wanted, precision)


def test_expressions_and_status(spark):
    found = one(spark, dates.expressions(F.lit("He said yesterday, not last Tuesday or 2 weeks ago, on June 5, 2024.")))
    assert [x.lower() for x in found] == ["yesterday", "last tuesday", "2 weeks ago", "june 5, 2024"]
    day = lambda d: F.lit(d).cast("date")
    assert one(spark, dates.temporal_status(day("2024-01-02"), day("2024-01-01"))) == "scheduled"
    assert one(spark, dates.temporal_status(day(None), day("2024-01-01"))) == "unknown"
    assert one(spark, dates.stale(day("2025-03-21"), F.lit("2025-03-21 12:00:00").cast("timestamp"), 24)) is False
    assert one(spark, dates.stale(day("2025-03-21"), F.lit("2025-03-22 15:00:00").cast("timestamp"), 24)) is True
    assert str(one(spark, dates.bounded_start(day("2020-01-01"), day("2025-03-21"), 14))) == "2025-03-07"


def test_text_functions(spark):
    assert one(spark, text.normalise_url(F.lit("HTTP://A.com/x?utm_source=1&b=2&ref=z#top"))) == "http://a.com/x?b=2"
    assert one(spark, text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert one(spark, text.dice(text.grams(F.lit("night"), 2), text.grams(F.lit("nacht"), 2))) == pytest.approx(0.25)
    assert one(spark, text.grams(F.lit("a"), 2)) == []
    assert sorted(one(spark, text.trigrams(F.lit("cat")))) == sorted(["  c", " ca", "cat", "at "])
    assert one(spark, text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    same = one(spark, text.content_hash(F.lit("A  Title"), F.lit("<b>Body</b> text .")))
    assert same == one(spark, text.content_hash(F.lit("a title"), F.lit("body text.")))
    assert one(spark, text.last_name(F.lit("Jane van Dyke"))) == "Dyke" and one(spark, text.last_name(F.lit("Cher"))) is None
    assert one(spark, text.last_name(F.lit("White House officials"))) is None
    assert one(spark, text.whole_word(F.lit("Crude oil up"), "oil")) and not one(spark, text.whole_word(F.lit("foiled"), "oil"))
    assert one(spark, text.occurrences(F.lit("aaa b aaa"), F.lit("aa"))) == 2


def test_scores(spark):
    assert one(spark, scores.length_score(F.lit(""))) == 0 and one(spark, scores.length_score(F.lit(None).cast("string"))) == 0
    assert one(spark, scores.length_score(F.lit("w " * 200))) == pytest.approx(0.7)
    assert one(spark, scores.syllables(F.lit("the table are"))) == 1 + 1 + 1
    assert one(spark, scores.spam_score(F.lit("WIN THE FREE PRIZES NOW!!!"), F.lit("fine"), F.lit("http://a.tk"))) == pytest.approx(1 - 4 / 3)
    assert one(spark, scores.fact_density(F.lit(None).cast("string"))) == 0
    assert one(spark, scores.grade(F.lit(0.9))) == "A+" and one(spark, scores.grade(F.lit(0.1))) == "F"
    assert one(spark, scores.freshness(F.lit(None).cast("timestamp"), F.lit("2024-01-01").cast("timestamp"))) == 0.5
    assert one(spark, scores.rejection_reasons(*[F.lit(x) for x in (0.9, 0.1, 0.9, 0.9, 0.9, 0.9, 0.4)])) == ["length", "spam"]
    assert one(spark, scores.top_term(F.lit("alpha beta alpha"), 3)) == 2


def test_filters(spark):
    rows = spark.createDataFrame([(1, "50% off", None), (2, "Other", 4), (3, None, 2)], "id int, t string, tier int")
    assert [r.id for r in filters.apply_filters(rows, terms={"t": "%OFF_"}).collect()] == [1]
    assert sorted(r.id for r in filters.apply_filters(rows, terms={"t": ""}).collect()) == [1, 2]
    assert sorted(r.id for r in filters.apply_filters(rows, equal={"tier": 4}, defaults={"tier": 4}).collect()) == [1, 2]
    linked = spark.createDataFrame([(1,), (None,)], "id int")
    assert sorted(r.id for r in filters.apply_filters(rows, unlinked=(linked, "id")).collect()) == [2, 3]
    gate = lambda t, c, u: one(spark, filters.ingest_reject_reason(F.lit(t), F.lit(c), F.lit(u)))
    assert gate("Title", "x" * 30, "http://a") is None and gate("", "x" * 30, "http://a") == "empty_title"
    assert gate("T", "x", "") == "missing_url" and gate("T", "x", "u") == "thin_item"


def test_windows_and_upserts(spark):
    rows = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 5.0), ("a", 3, 6.0), ("b", 1, None)], "k string, t int, v double")
    assert [(r.k, r.t) for r in windows.keep_best(rows.where("v is not null"), ["k"], [F.col("v").desc(), F.col("t")]).collect()] == [("a", 3)]
    changes = {r.k: r.change_pct for r in windows.change_percent(rows, "k", "t", "t", "v").collect()}
    assert changes == {"a": pytest.approx(20.0)}
    zero = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 5.0)], "k string, t int, v double")
    assert windows.change_percent(zero, "k", "t", "t", "v").first().change_pct is None
    runs = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 2, 3, 2, 1, 1, 2])], "k string, t int, v int")
    assert [(r.direction, r.start, r.end, r.points) for r in windows.monotone_runs(runs, "k", "t", "v").orderBy("start").collect()] == [("rising", 0, 2, 3), ("falling", 2, 4, 3)]
    old = spark.createDataFrame([(1, 100.0), (2, 7.0)], "k int, v double")
    new = spark.createDataFrame([(1, 150.0, 1), (1, 200.0, 2), (None, 1.0, 1)], "k int, v double, n int")
    merged = upsert.upsert(old, new.drop("n").where("v <> 150"), ["k"])
    assert sorted((r.k or 0, r.v) for r in merged.collect()) == [(0, 1.0), (1, 200.0), (2, 7.0)]
    arrivals = spark.createDataFrame([("x", 1, 0.5, "e1", "s1"), ("x", 2, 0.5, "e2", None), ("x", 3, 0.1, "e3", "s3")], "key string, seq int, confidence double, evidence string, summary string")
    got = upsert.monotone_upsert(arrivals, "key", "seq").first()
    assert (got.confidence, got.evidence, got.summary) == (0.5, "e2", "s3")


def test_joins_and_graphs(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (None, 3)], "c int, m int")
    assert [tuple(r) for r in joins.co_occurrence(rows, "c", "m", 2).collect()] == [(1, 2, 2)]
    left = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (2, dt.date(2024, 2, 1))], "a int, d date")
    right = spark.createDataFrame([(7, dt.date(2024, 1, 8)), (8, dt.date(2024, 1, 9))], "b int, e date")
    assert [(r.a, r.b) for r in joins.band_join(left, right, "d", "e", 7).collect()] == [(1, 7)]
    trades = spark.createDataFrame([("s", 5), ("s", 1), ("z", 9)], "k string, t int")
    quotes = spark.createDataFrame([("s", 2, 20), ("s", 5, 50)], "k string, t int, q int")
    assert sorted((r.k, r.t, r.q or 0) for r in joins.as_of_join(trades, quotes, "k", "t", "t", ["q"]).collect()) == [("s", 1, 0), ("s", 5, 50), ("z", 9, 0)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 6), (None, 1)], "a int, b int")
    assert sorted(tuple(r) for r in graph.components(edges).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    start = spark.createDataFrame([(1,)], "node int")
    assert sorted(tuple(r) for r in graph.reach(edges.where("a is not null"), start, 2).collect()) == [(1, 0), (2, 1), (3, 2)]
    empty = edges.limit(0)
    assert graph.components(empty).count() == 0
    nodes = [int(x) for x in np.random.default_rng(8).permutation(1000)]
    path = spark.createDataFrame([*zip(nodes, nodes[1:]), (2000, 2001)], "a int, b int")
    assert {r.node: r.component for r in graph.components(path).collect()} == {n: 0 for n in nodes} | {2000: 2000, 2001: 2000}


def test_similarity_join_against_brute_force(spark):
    rng = np.random.default_rng(3)
    sets = [(i, sorted({f"t{x}" for x in rng.zipf(1.5, 12) if x < 40})) for i in range(60)]
    rows = spark.createDataFrame(sets, "id int, tokens array<string>")
    for threshold in (0.3, 0.5, 0.8):
        got = {(r.a, r.b) for r in dedup.jaccard_pairs(rows, threshold).collect()}
        wanted = {(a, b) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold}
        assert got == wanted
    tiers = dedup.duplicate_tiers(spark.createDataFrame([(1, "h", "s"), (2, "h", "t"), (3, "h", "s"), (4, None, "s")], "id int, h string, s string"), "id", [("both", [F.col("h"), F.col("s")]), ("text", [F.col("h")])])
    assert sorted(tuple(r) for r in tiers.collect()) == [(2, "text", 1), (3, "both", 1)]


def test_entities(spark):
    known = spark.createDataFrame([(1, "Dr. Ann Lee", "person", ["Annie"]), (2, "Acme Inc", "organization", None), (3, "Bob Lee", "person", None), (4, "Carl Poe", "person", None)], "id int, name string, type string, aliases array<string>")
    asked = spark.createDataFrame([(1, "ann lee", "person"), (2, "ANNIE", "person"), (3, "Acme", "organization"), (4, "Lee", "person"), (5, "Mr. Poe", "person"), (6, "Poe", "person"), (7, None, "person")], "mention_id int, name string, type string")
    got = {r.mention_id: (r.id, r.rule) for r in entities.resolve(asked, known).collect()}
    assert got == {1: (1, 3), 2: (1, 2), 3: (2, 3), 5: (4, 4), 6: (4, 4)}
    mentions = spark.createDataFrame([(1, "A. Lee"), (1, "a. lee"), (1, "Annie"), (1, "Annie"), (2, "Acme")], "id int, name string")
    assert [(r.id, r.aliases) for r in entities.new_aliases(mentions, known).collect()] == [(1, ["A. Lee"])]
    pairs = {(r.a, r.b): r.reason for r in entities.merge_candidates(spark.createDataFrame([(1, "Gov. Jo Day", "person", None), (2, "Jo Day", "person", None), (3, "Mo Day", "person", None)], "id int, name string, type string, aliases array<string>")).collect()}
    assert pairs == {(1, 2): "bare name", (1, 3): "last name", (2, 3): "last name"}


def test_retrieval(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<double>")
    ranked = vectors.nearest(v.where("id = 1"), v, 2)
    assert [r.vec_id for r in ranked.orderBy("rank").collect()] == [2, 3]
    assert retrieval.with_margin(ranked, 0.85, 0.95, 0.1).first().accepted
    keyword = spark.createDataFrame([(1, 1), (2, 2)], "id int, rank int")
    semantic = spark.createDataFrame([(2, 0.9), (3, 0.5)], "id int, score double")
    assert [r.id for r in retrieval.hybrid_merge(keyword, semantic, 0.6, 3).collect()] == [2, 1, 3]
    assert retrieval.adaptive_cutoff(semantic, "score", 0.6).count() == 1


def test_sources(spark, tmp_path):
    lines = tmp_path / "log.jsonl"
    lines.write_text('{"level": "ERROR", "timestamp": "2024-01-01 10:00:00"}\nnot json\n[1]\n{"level": "info"}\n')
    entries = sources.read(spark, "log_archive", str(lines), "app")
    assert entries.count() == 2
    logs.write_archive(entries, str(tmp_path / "archive"))
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 2
    body = tmp_path / "o.json"
    body.write_text(json.dumps({"observations": [{"date": "2024-01-01", "value": "100.5"}, {"date": "2024-01-02", "value": "101.0"}, {"date": "2024-01-03", "value": "."}]}))
    assert sources.read(spark, "observations", str(body)).count() == 2
    assert observations.request_windows(spark, "2024-01-01", "2024-03-05").count() == 3
    feed = tmp_path / "feed.json"
    feed.write_text(json.dumps({"feed_id": "f", "title": "T", "link": "u", "summary": "short", "content": [{"value": "<p>a longer body</p>"}]}) + "\n")
    assert sources.read(spark, "feed_dump", str(feed)).select(feeds.entry_body().alias("b")).first().b == "a longer body"
    at = dt.datetime(2024, 1, 10)
    entry = lambda rows: spark.createDataFrame(rows, "url string, title string, at timestamp")
    fresh = feeds.new_entries(entry([("http://a/1", "New", at), ("http://a/1?utm_x=1", "Again", at), ("http://a/2", "OLD  title", at), ("http://a/3", "Stale", at)]), entry([("http://b", "old title", dt.datetime(2024, 1, 5)), ("http://c", "stale", dt.datetime(2023, 1, 1))]))
    assert sorted(r.title for r in fresh.collect()) == ["Again", "Stale"] or sorted(r.title for r in fresh.collect()) == ["New", "Stale"]
    with pytest.raises(ValueError):
        explorer.check("select 1; drop table x")
    with pytest.raises(ValueError):
        explorer.check("delete from x")
    got, more = explorer.explore(spark, "select * from range(5)", 3)
    assert got.count() == 3 and more
    items = one(spark, observations.filing_items(F.lit("Item 1. Business we sell. Item 1A. Risks. Item 7. Discussion here. Item 7A. Market.")))
    assert items == {"item_1": "Business we sell. ", "item_7": "Discussion here. "}


def test_models(spark):
    assert one(spark, models.chunks(F.lit("a b c d e"), 3, 1)) == ["a b c", "c d e"]
    assert one(spark, models.chunks(F.lit(None).cast("string"))) == []
    assert one(spark, models.event_type(F.lit("They announced a vote"))) == "announcement"
    vector = one(spark, models.hash_embedding(64)(F.lit("some words")))
    assert sum(x * x for x in vector) == pytest.approx(1.0)
    claims = models.rule_claims(spark.createDataFrame([(1, "Acme Corp holds shares. nothing here.")], "id int, t string"), "id", "t").collect()
    assert [(c.subject, c.predicate, c.fact_type) for c in claims] == [("Acme Corp", "holds", "POSITION")]
    assert one(spark, models.contradiction(F.lit("supports"), F.lit("x"), F.lit("opposes"), F.lit("x"))) == 0.8
    assert one(spark, models.contradiction(F.lit("is"), F.lit("not ready"), F.lit("is"), F.lit("ready"))) == 0.9


def test_change_log(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "id int, at timestamp")
    step = streams.change_log(str(tmp_path / "t"), str(tmp_path / "l"), "at")
    step(rows, 0)
    step(rows, 0)  # a repeated batch changes nothing
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and spark.read.parquet(str(tmp_path / "l")).count() == 1


@pytest.mark.parametrize(
    "predicate", [w for w, _ in models.FACT_TYPES] + ["said he was", "went", "has voted", ""]
)
def test_fact_types(spark, predicate):
    groups = {
        "STATEMENT": "stated said announced declared claimed argued", "ACTION": "voted signed launched approved rejected imposed appointed resigned arrested",
        "POSITION": "holds supports opposes", "RELATIONSHIP": "leads allied", "ATTRIBUTE": "is was has",
    }
    first = next((k for k, words in groups.items() for w in words.split() if w in predicate), "STATEMENT")
    assert one(spark, models.fact_type(F.col("p")), p=predicate) == first


def test_number_words(spark):
    for expression, wanted in (("several weeks ago", "2024-03-10"), ("twenty days ago", "2024-03-11"), ("few days ago", "2024-03-28"), ("fifteen days ago", "2024-03-16")):
        assert str(one(spark, dates.resolve(F.lit(expression), F.lit("2024-03-31").cast("date")))["date"]) == wanted


def test_expressions_by_kind(spark):
    text = "On Sept 5, 2021 and yesterday; 3 days ago, last Friday, Q2 2020, 2021-01-02, 5 March 2020, earlier this year, this month"
    assert one(spark, dates.expressions(F.lit(text))) == ["yesterday", "last Friday", "this year", "this month", "3 days ago", "Q2 2020", "Sept 5, 2021", "5 March 2020", "March 2020", "2021-01-02", "earlier this year"]


def test_explorer_refuses_all_that_writes(spark):
    spark.range(3).createOrReplaceTempView("numbers")
    rows, more = explorer.explore(spark, "select id, '--;' as s from numbers -- a comment; here", 2)
    assert rows.count() == 2 and more and rows.first().s == "--;"
    assert explorer.explore(spark, "with x as (select 1 as a) select a from x")[0].first().a == 1 and explorer.explore(spark, "table numbers;")[0].count() == 3
    assert explorer.explore(spark, "explain select * from numbers")[0].count() == 1
    for bad in ("with x as (select 1 as a) insert into t select a from x", "insert into t values (1)", "select 1; select 2", "explain insert into t values (1)", "drop table t", ";", "/* x */"):
        with pytest.raises(ValueError):
            explorer.explore(spark, bad)


def test_similar_sets_with_copies_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    sets = {i: {f"t{x}" for x in rng.integers(0, 30 if i % 2 else 12, rng.integers(1, 14))} for i in range(120)}
    for i in range(0, 40):
        sets[200 + i] = sets[i]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(999, [])], "id long, tokens array<string>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    for t in (0.5, 0.8):
        jac = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        dic = {(a, b) for a, b in pairs if 2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])) > t}
        assert {(r.a, r.b) for r in dedup.jaccard_pairs(rows, t).collect()} == jac
        assert {(r.a, r.b) for r in dedup.dice_pairs(rows, t).collect()} == dic
    found = {r.node: r.component for r in graph.components(dedup.jaccard_links(rows, 0.8)).collect()}
    wanted = {r.node: r.component for r in graph.components(dedup.jaccard_pairs(rows, 0.8).select("a", "b")).collect()}
    assert found == wanted


@pytest.mark.parametrize(
    ("words", "wanted"),
    [("the", 1), ("eye", 1), ("eye ye e", 1), ("table eye", 2), ("banana", 4), ("Idea, OK!", 3), ("été", 1), ("1 2 ...", 0), ("", 0), (None, 0)],
)
def test_plain_syllables(spark, words, wanted):
    assert one(spark, scores.plain_syllables(F.lit(words).cast("string"))) == wanted


def test_clickbait_score(spark):
    score = lambda title, body: one(spark, content.clickbait_score(F.lit(title).cast("string"), F.lit(body).cast("string")))
    long = "plain words of a report " * 50
    assert score("Quarterly results", long) == 0.0
    assert score("Quarterly results", None) == score(None, "") == pytest.approx(0.2)
    assert score("BREAKING: a market is going viral", long) == pytest.approx(0.4 + 0.15 + 0.15)
    assert score("This One Thing", long) == pytest.approx(0.4 + 0.15 + 0.12)
    assert score("Quarterly results", "panic and chaos") == pytest.approx(0.2 + 0.25)
    assert score("BREAKING: EXCLUSIVE: you won't believe, doctors hate one weird trick, going viral", "chaos, panic") == 1.0


def test_language_quality_and_content_score(spark):
    quality = lambda t: one(spark, scores.language_quality(F.lit(t).cast("string")))
    assert quality(None) == quality("") == 0.0
    assert quality("plain") == pytest.approx(0.2)
    assert quality("Goood.") == pytest.approx(0.4)  # all of its words have a letter three times in a row
    assert quality("word " * 99 + "zzz") == pytest.approx(0.1)
    assert quality("One two three. Four five six. Seven eight nine.") == pytest.approx(0.8)
    assert one(spark, scores.content_score(*(F.lit(1.0) for _ in range(6)))) == pytest.approx(1.0)
    assert one(spark, scores.content_score(F.lit(1.0), *(F.lit(0.0) for _ in range(5)))) == pytest.approx(0.15)


@pytest.mark.parametrize(
    ("title", "body", "url", "wanted"),
    [
        ("Rewards", "Apply. Subject to credit approval. Member FDIC.", "https://example.com/x", True), ("Cards", "See rates and fees. Variable APR applies.", "", True),
        ("Product Spotlight: a tool", "Streamline drafting.", "https://example.com/news", True), ("An edge", "Start your Westlaw Edge free trial today.", "", True),
        ("An option", "Pay as little as $10 with savings card.", None, True), ("Support", "Deploy our no-code AI chatbot.", None, True),
        ("Study finds modest benefit in older adults", "Researchers told of outcomes in a randomized trial.", "https://example.com/doi", False),
        ("Compare the best credit cards for dining rewards", "", "https://example.com/a", True), ("Top 6 credit cards for travel in 2026", None, None, True),
        ("Senate panel holds hearing on credit card fee cap bill", "Lawmakers spoke of interchange fees.", "https://example.com/1", False),
        ("News", "Words.", "https://www.nerdwallet.com/article", True), ("News", "Words.", "https://example.com/ads/7", True), ("News", "Words.", "https://example.com/7", False),
        ("Press release", "Member FDIC.", "https://example.com/ads/7", False), (None, None, None, False), ("", "", "", False),
    ],
)
def test_is_advertisement(spark, title, body, url, wanted):
    assert one(spark, adverts.is_advertisement(*(F.lit(v).cast("string") for v in (title, body, url)))) is wanted


@pytest.mark.parametrize("part", [adverts.PLAIN, adverts.FINANCE, adverts.LEGAL, adverts.MEDICINE, adverts.CHATBOTS])
def test_every_phrase_marks_an_advertisement(spark, part):
    rows = spark.createDataFrame([(f"words {p.upper()} words",) for p in part], "t string")
    assert rows.where(~adverts.is_advertisement(F.lit("Title"), F.col("t"), F.lit(""))).count() == 0


def test_significance_importance_and_bias(spark):
    word = lambda v: F.lit(v).cast("string")
    significance = lambda t, d, n: one(spark, priorities.significance(word(t), word(d), F.lit(n).cast("long")))
    assert significance(None, None, None) == significance("", "", 0) == 0.5
    assert significance("Market CRISIS", "a new policy", 5) == pytest.approx(0.5 + 0.1 + 0.05 * 2 + 0.1)
    assert significance("crisis emergency breaking major", "war", 500) == 1.0
    importance = lambda t, c: one(spark, priorities.event_importance(word(t), F.lit(c).cast("double")))
    assert importance(None, None) == 0.5
    assert importance("The Senate met", 0.5) == pytest.approx(0.7)
    assert importance("A major and significant vote", 0.0) == pytest.approx(0.7)
    assert importance("An urgent, historic, key shutdown", 1.0) == 1.0
    assert one(spark, priorities.bias_blend(F.lit(1.0), F.lit(-1.0))) == pytest.approx(-0.2)
    assert one(spark, priorities.bias_blend(F.lit(-2.0), F.lit(-1.0))) == -1.0


@pytest.mark.parametrize(
    ("source", "wanted"),
    [("Reuters", ("tier_1", 0.95)), ("BBC News", ("tier_1", 0.95)), ("Bloomberg.com", ("tier_2", 0.85)), ("times", ("tier_2", 0.85)), ("usa", ("tier_3", 0.7)), ("A Blog", ("tier_4", 0.5)), (" ", ("unknown", 0.3)), (None, ("unknown", 0.3))],
)
def test_source_reliability(spark, source, wanted):
    assert tuple(one(spark, priorities.source_reliability(F.lit(source).cast("string")))) == wanted


def test_article_priority(spark):
    rule, word = priorities.Rule, lambda v: F.lit(v).cast("string")
    score = lambda rules, collection=(), title="Quantum Computing", body=None: one(spark, priorities.article_priority(word(title), word(body), word("Tech Daily"), word("Technology"), rules, collection))
    assert score([]) == score([rule("text", "absent", "boost")]) == 50.0
    assert score([rule("text", "QUANTUM", "boost", 40, 0.5)]) == 70.0
    assert score([rule("source", "daily", "suppress", 40, 0.5)]) == 30.0
    assert score([rule("category", "tech", "track", 40, 0.5)]) == 60.0
    assert score([rule("text", "quantum", "boost", 100)]) == 100.0
    assert score([rule("text", "quantum", "suppress", 100)]) == 0.0
    assert score([], [rule("text", "quantum", "boost", 50)]) == 65.0
    assert score([rule("text", "quantum", "boost", 40)], [rule("text", "computing", "avoid"), rule("source", "tech", "boost", 50)]) == 15.0
    assert score([rule("text", "quantum", "boost")], title=None) == 50.0
    levels = [one(spark, priorities.collection_level(F.lit(float(x)))) for x in (75, 74, 50, 49)]
    assert levels == ["high", "medium", "medium", "low"]


def test_best_clusters(spark):
    shape = "id int, v array<double>"
    vectors = lambda rows: spark.createDataFrame(rows, shape).select("id", array_to_vector("v").alias("v"))
    near = [(i, [10.0 * (i % 3) + 0.01 * i, 5.0 * (i % 3 == 1) - 0.01 * i]) for i in range(30)]
    k, found = retrieval.best_clusters(vectors(near), "v", most=6)
    assert k == 3
    groups = {frozenset(r["ids"]) for r in found.groupBy("cluster").agg(F.collect_list("id").alias("ids")).collect()}
    assert groups == {frozenset(range(start, 30, 3)) for start in range(3)}
    for few in ([], near[:1], near[:3]):
        k, found = retrieval.best_clusters(vectors(few), "v")
        assert (k, found.count(), found.where("cluster <> 0").count()) == (1, len(few), 0)
    k, found = retrieval.best_clusters(vectors([(i, [1.0, 1.0]) for i in range(8)]), "v")
    assert (k, found.count()) == (2, 8)


def test_bill_mentions(spark):
    from tidewater.functions import content

    text = "H.J. R. 5, (S.J.R. 6); H.Con.R. 7 [S. Con. R. 8 and HR Res 9, S. Res. 10, H.R. 0011, H.R. 11, H.R. 0, H.R. 1000001, H.R. 99999999999999999999, S. 12 XS. 13 in the 101st Congress"
    got = one(spark, content.bill_mentions(F.lit(text)))
    assert [(b.congress, b.kind, b.number) for b in got] == [(101, k, n) for k, n in (("hjres", 5), ("sjres", 6), ("hconres", 7), ("sconres", 8), ("hres", 9), ("sres", 10), ("hr", 11), ("s", 12))]
    assert one(spark, content.bill_mentions(F.lit("  H.R. 11 short    "))) == [] and one(spark, content.bill_mentions(F.lit(None).cast("string"))) == []
    assert one(spark, content.bill_mentions(F.lit("see H.R. 11 in that record")))[0].congress == 118


def test_fact_density_attributions(spark):
    from tidewater.functions import scores

    assert one(spark, scores.fact_density(F.lit("The mayor said that. The aide told reporters."))) == 0.8
    assert one(spark, scores.fact_density(F.lit("A said nothing. said so. He said and said again"))) == 0.4


def test_upsert_without_order_refuses_repeats(spark):
    from pyspark.errors import PySparkException

    old, new = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string")
    with pytest.raises(PySparkException, match="give an order"):
        upsert.upsert(old, new, ["k"]).collect()


@pytest.mark.parametrize("sql", ["select reflect('java.lang.System', 'currentTimeMillis')", "select id, java_method('java.lang.Math', 'abs', -1) from range(2)", "with x as (select try_reflect('java.lang.Math', 'random') as c) select * from x"])
def test_explorer_refuses_java_calls(spark, sql):
    with pytest.raises(ValueError, match="not allowed"):
        explorer.explore(spark, sql)


def test_places_without_a_window_over_whole_keys(spark):
    rows = [(i % 3 if i % 7 else None, (i * 37) % 101, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t int, i int")
    got = {r.i: (r.place, r.of) for r in windows.placed(df, "k", ["t", "i"]).collect()}
    for k in (None, 0, 1, 2):
        own = sorted((t, i) for kk, t, i in rows if kk == k)
        assert [got[i] for _, i in own] == [(n + 1, len(own)) for n in range(len(own))]
    assert windows.placed(df.limit(0), "k", ["t", "i"]).count() == 0


def test_components_without_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_source_quality_and_flags(spark):
    score = lambda source, body: round(one(spark, content.source_quality(F.lit(source).cast("string"), F.lit(body).cast("string"))), 6)
    assert score("Reuters", "") == 0.9 and score("The Guardian", None) == 0.75 and score(None, "") == 0.3 and score("Map Blog", "") == 0.9
    assert score("x", "Officials said the Ministry of Truth") == 0.45 and score("BBC", "according to the Institute") == 1.0
    flags = lambda *v: one(spark, content.quality_flags(*map(F.lit, v)))
    assert flags(0.5, 0.3, 0.1, 0.4, 0.1) == ["clickbait_risk", "high_emotion", "low_fact_density", "low_source_quality", "shallow"] and flags(0.4, 0.2, 0.2, 0.5, 0.2) == []
    assert [one(spark, content.recommendation(F.lit(n))) for n in (1, 2, 3, 4)] == ["intelligence_grade", "standard_reporting", "aggregated_commentary", "low_value_demote"]


def test_content_quality_tiers_count_every_document(spark, sf_dir):
    from tidewater.plans import content as plan

    rows = plan.content_quality_tiers(spark, sf_dir).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and len({r.tier for r in rows}) == len(rows) > 1
    assert all(r.recommendation == {1: "intelligence_grade", 2: "standard_reporting", 3: "aggregated_commentary", 4: "low_value_demote"}[r.tier] for r in rows)


def test_as_of_join_over_ranges_of_one_key(spark):
    asked = [(k, t, i) for i, (k, t) in enumerate((i % 2 * 5, i * 3) for i in range(120))] + [(9, 4, 120), (None, 4, 121), (0, None, 122)]
    known = [(0, t * 7, f"v{t}") for t in range(60)] + [(5, 100, "x"), (5, 100, "y"), (5, 50, None)]
    left, right = spark.createDataFrame(asked, "k int, t int, i int"), spark.createDataFrame(known, "k int, at int, v string")
    got = {r.i: r.v for r in joins.as_of_join(left, right, "k", "t", "at", ["v"]).collect()}
    for k, t, i in asked:
        hits = [(at, v is not None, v or "") for kk, at, v in known if k is not None and t is not None and kk == k and at <= t]
        assert got[i] == ((max(hits)[2] or None) if hits else None), (k, t)


def test_chunks_of_one_long_text_are_cut_in_time_that_grows_with_it(spark):
    from tidewater.functions.chunking import chunks_at_breaks

    whole = "".join(f"w{i} " for i in range(400_000))  # 2.7 million characters
    df = spark.createDataFrame([(whole,), (None,), (" \n",), ("a\n\nb" * 3,)], "text string")
    long, *rest = (r.c for r in df.select(chunks_at_breaks(F.col("text"), 400, 50).alias("c")).collect())
    assert len(long) > 7000 and all(len(c) <= 401 for c in long) and long[-1].endswith("w399999") and " ".join(long).count("w200000") >= 1
    assert rest == [[], [], ["a\n\nba\n\nba\n\nb"]]


def test_sentences_and_words_of_scores_are_taken_once(spark):
    rows = [("",), (None,), ("One two. " * 30,), ("A short one! \n\n" + "word " * 40 + "? It has " + "many more " * 9,), ("xx   \n   yy. " * 3,), ("tiny. abcdefghijk. abcdefghij. \x0b abcde fghijk \t.",)]
    df = spark.createDataFrame(rows, "t string").select("t", scores.structure_score(F.col("t")).alias("s"), scores.uniqueness_score(F.col("t")).alias("u"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("array_distinct(") == 1
    for t, s, u in df.collect():
        t = t or ""
        sizes = [len(x.split()) for x in re.split("[.!?]+", t) if len(x.strip(" \t\n\x0b\x0c\r")) > 10]
        mean = sum(sizes) / max(len(sizes), 1)
        spread = sum(x * x for x in sizes) / max(len(sizes), 1) - mean * mean
        assert s == pytest.approx(0.3 * ("\n\n" in t) + 0.3 * (len(sizes) >= 3) + 0.2 * (len(sizes) > 1 and spread > 10) + 0.2 * bool(re.search("[A-Z]", t)))
        kept = [w for w in t.lower().split() if len(w) > 2 and w not in scores.COMMON_WORDS]
        share = len(set(kept)) / max(len(kept), 1)
        assert u == (0.0 if not kept else 0.2 if share < 0.3 else 0.5 if share < 0.5 else 0.8 if share < 0.7 else 1.0)
