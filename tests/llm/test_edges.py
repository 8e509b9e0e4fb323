"""Every operator and every pipeline stage on odd tables: nulls, empty and very long texts, ties, repeats, clashing columns, no rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import chat, classify, decontaminate, mixing, near_dedup, pii, secrets, topk, url_filter

random.seed(5)
WORDS = [f"w{i}" for i in range(500)]
LONG = " ".join(random.choices(WORDS, k=60_000))
BASE = " ".join(random.choices(WORDS, k=120))
ITEM = " ".join(random.choices(WORDS, k=4) + ["".join(random.choices("abcdefghij", k=7)) for _ in range(25)])
TOKEN = 'token = "0123456789abcdefXYZq+/"'
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (2, BASE, "en", "a", 1), (3, BASE + " tail", "en", None, 1), (4, None, None, None, None), (5, "", "en", "b", 0),
    (6, " \t\n", "en", "b", 3), (None, "no id at all here", "de", "b", 3), (None, "no id at all here", "de", "b", 3), (7, LONG, "en", "a", 9), (8, "one two", "en", "c", 7),
    (9, "ONE  two", "fr", "c", 8), (10, f"say {ITEM} again", "en", "a", 5), (11, f"my {TOKEN} here, a@b.cd and 10.0.0.1", "en", "b", 5), (12, "you stupid idiot, you moron", "en", "b", 5), (13, "ñandú 🦆 " + TOKEN, "es", "é", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "key node sig copies taken rank size target o y fold x live_spans live_key part n h1 h2 word u worth whole bucket score s a b base added cands owner hash kept component_id start end".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, int(i in (12,))) for i in range(1, 14)] + [(1, 1, 0), (None, 1, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (None, "short"), (3, "")], "item_id long, text string")


def clashing(docs):
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


OPERATORS = {
    "near_duplicates": lambda d, lab, ben: near_dedup.near_duplicates(d),
    "find_leaks": lambda d, lab, ben: decontaminate.find_leaks(d, ben),
    "score_quality": lambda d, lab, ben: classify.score_quality(d, lab),
    "score_toxicity": lambda d, lab, ben: classify.score_toxicity(d, lab),
    "scan_secrets": lambda d, lab, ben: secrets.scan_secrets(d),
    "mix": lambda d, lab, ben: mixing.mix(d),
    "find_personal_data": lambda d, lab, ben: pii.find_personal_data(d),
}
ONE_ROW_EACH = set(OPERATORS) - {"find_leaks"}


def seen(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(docs, labels, benchmark, name):
    plain = seen(OPERATORS[name](docs, labels, benchmark))
    assert plain == seen(OPERATORS[name](clashing(docs), labels, benchmark))
    assert name not in ONE_ROW_EACH or len(plain) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, benchmark, name):
    none = docs.limit(0)
    assert OPERATORS[name](none, labels.limit(0), benchmark.limit(0)).count() == 0
    few = OPERATORS[name](docs.where("doc_id < 4"), labels.limit(0), benchmark.limit(0))
    assert few.count() == (4 if name in ONE_ROW_EACH else 0)


def test_defined_results(docs, labels, benchmark):
    kept = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect() if r.doc_id is not None}
    assert kept[2][1:] == (1, False) and kept[3][1:] == (1, False) and kept[4] == (0, 4, True) and kept[6] == (0, 6, True)
    assert kept[8][0] == 1 and kept[9][1:] == (8, False)
    leaks = [tuple(r) for r in decontaminate.find_leaks(docs, benchmark).collect()]
    assert [(r[0], r[1]) for r in leaks] == [(10, 1)] and ROWS[12][1][leaks[0][2] : leaks[0][3]] == ITEM
    scores = {r.doc_id: r.score for r in classify.score_toxicity(docs, labels).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    found = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert [(s.start, s.end, s.kind) for s in found[11].base] == [(3, 3 + len(TOKEN) - 1, 1), (12, 28, 3)]
    assert found[13].base[0].start == 8 and found[4].base == []
    personal = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.find_personal_data(docs).collect()}
    text = ROWS[13][1]
    assert [(k, text[s:e]) for k, s, e in personal[11]] == [(1, "a@b.cd"), (2, "10.0.0.1")]
    mixed = mixing.mix(docs).collect()
    assert all(r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in mixed) and any(r.source is None for r in mixed)


def stage_rows(spark, tmp_path, docs, labels, benchmark):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_pipeline_stages(spark, tmp_path, docs, labels, benchmark):
    sf_dir = stage_rows(spark, tmp_path, docs, labels, benchmark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secret_scan", "mixing"]
    stages = dict(corpus_pipeline.STAGES)
    for name in names:
        none = stages[name](spark, docs.limit(0), sf_dir)
        assert none.count() == 0
        if name != "mixing":
            assert none.columns == docs.columns
            wide = stages[name](spark, clashing(docs), sf_dir)
            assert wide.columns == clashing(docs).columns
            assert seen(wide.select(*docs.columns)) == seen(stages[name](spark, docs, sf_dir))
    left = stages["near_dedup"](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 8, 10, 11, 12, 13] and left.where("doc_id is null").count() == 2
    assert sorted(r.doc_id or 0 for r in stages["decontamination"](spark, docs, sf_dir).collect()) == sorted((r[0] or 0) for r in ROWS if r[0] != 10)
    hidden = {r.doc_id: r for r in stages["secret_scan"](spark, docs, sf_dir).collect()}
    assert hidden[11].text == 'my token = "[SECRET]" here, a@b.cd and 10.0.0.1' and hidden[11].n_chars == len(hidden[11].text) and hidden[1].text == BASE
    out = corpus_pipeline.run(spark, sf_dir)
    assert "taken" in out.columns and out.where("doc_id = 10").count() == 0


def test_redaction_lets_ownership_decide(spark):
    live = ["kT9x2LmQ4vZ8", "kT9x2LmQ4vZ8abc", "kT9x2LmQ4vZ8abcd", "correcthorsebattery", "482915730264", "9071352846119035"]
    kept = ["xxxxxxxxxxxx", "EXAMPLEKEY123456", "changeme12345", "sharedByThree123"]
    rows = [(i, f'password = "{v}" and {v} alone', "a") for i, v in enumerate(live + kept)] + [(90, "see correcthorsebattery and kT9x2LmQ4vZ8", "b"), (91, "an understanding", "b")]
    rows += [(92 + i, "token: sharedByThree123", s) for i, s in enumerate("bc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    wanted = {i: text for i, text, _ in rows} | {i: 'password = "[SECRET]" and [SECRET] alone' for i in range(len(live))} | {90: "see [SECRET] and [SECRET]"}
    assert got == wanted


def test_common_words_are_no_secrets(spark):
    """A word that many owners use bare stays, also where a name stands before it; a value of one owner goes everywhere."""
    rows = [(1, "the secret: understanding of it", "s1"), (2, "token = kT9x2LmQ4vZ8", "s1"), (3, "again kT9x2LmQ4vZ8", "s1")]
    rows += [(10 + i, "a deep understanding", f"s{i % 10}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in secrets.redact_secrets(docs).collect()}
    assert got == {i: text for i, text, _ in rows} | {2: "token = [SECRET]", 3: "again [SECRET]"}
    scanned = {r.doc_id: r for r in secrets.scan_secrets(docs).collect()}
    assert (scanned[1].n_live, scanned[1].n_copied, scanned[1].owners) == (0, 1, 10) and scanned[10].added == []
    assert scanned[2].n_live == 1 and [(s.start, s.end) for s in scanned[3].added] == [(6, 18)]


def test_rows_that_share_an_id(spark):
    """Rows of one doc_id are one document for the operator; the stage judges each by its own text."""
    other = " ".join(random.choices(WORDS, k=90))
    rows = [(3, BASE), (5, other), (5, BASE + " tail"), (6, other + " more"), (7, LONG), (7, LONG), (7, "lone words of its own here"), (None, BASE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(3, 3, True), (5, 3, False), (5, 3, False), (6, 3, False), (7, 7, True), (7, 7, True), (7, 7, True), (None, None, True)]))
    left = [(r.doc_id, r.text) for r in near_dedup.without_near_duplicates(docs).collect()]
    assert sorted(map(repr, left)) == sorted(map(repr, [(3, BASE), (5, other), (7, LONG), (7, "lone words of its own here"), (None, BASE)]))


def test_very_long_hosts_and_paths(spark):
    import time

    hosts = [".".join(["a"] * 50_000) + ".example.com", "b" * 100_000 + ".org", ".".join(["com"] * 30_000)]
    rows = [(i, f"http://{h}/en/7{'/x' * 20_000}") for i, h in enumerate(hosts)]
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("c.b.a.org", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame(rows, "page_id long, url string")
    url_filter.filter_urls(pages.limit(1), rules).collect()
    began = time.time()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: (None, "allow"), 2: ("com/en/", "block")} and time.time() - began < 10
    assert url_filter.filter_urls(pages, rules.limit(0)).where("rule is null").count() == 3


def test_urls(spark):
    rows = [
        (1, "http://A.Example.COM/en/725?x", 1), (2, "https://example.net/de/8", 1), (3, "nothing", 1), (4, None, 1), (None, "ftp://org/es/", 1), (6, "x://notexample.com/en/7", 1),
        (6, "x://notexample.com/en/7", 1), (7, "://", 1), (8, "a://com/en", 1), (9, "http://example.com" + "/en/7" * 50_000, 1), (10, "http://x.com?/en/", 1),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule int").select("*", F.lit(1).alias("host"), F.lit(1).alias("key"), F.lit(1).alias("part"))
    rules = spark.createDataFrame(url_filter.RULES + ((None, "/", "block"), ("", "/", "block"), ("org", None, "allow"), ("org", None, "block"), ("b.net", "/", None)), "host string, path string, verdict string")
    got = {(r.page_id, r.host): (r.path[:6], r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert url_filter.filter_urls(pages, rules).count() == len(rows)
    assert got[(1, "a.example.com")] == ("/en/72", "example.com/en/7", "allow") and got[(2, "example.net")] == ("/de/8", "example.net/de/8", "block")
    assert got[(3, "")] == ("", None, "allow") and got[(4, "")] == ("", None, "allow") and got[(None, "org")] == ("/es/", "org/es/", "block")
    assert got[(6, "notexample.com")] == ("/en/7", "com/en/", "block") and got[(8, "com")] == ("/en", None, "allow") and got[(10, "x.com")] == ("", None, "allow")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0 and url_filter.filter_urls(pages, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_rules_keep_host_and_path_apart(spark):
    pages = spark.createDataFrame([(1, "http://comx/a"), (2, "http://a.com/x"), (3, "http://com"), (4, "http://com/x/y.com")], "page_id long, url string")
    rules = spark.createDataFrame([("com", "x", "block"), ("com", "/x", "block"), ("com", "/x/y", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: (None, "allow"), 2: ("com/x", "block"), 3: (None, "allow"), 4: ("com/x/y", "allow")}


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "x"), (2, 2, "user", "x"), (3, 0, "user", "hi"), (4, 5, "user", "hi"), (4, 7, "assistant", None),
        (5, 0, None, "hi"), (None, 0, "user", "lost"), (6, 0, "user", "z" * 200_000), (7, 0, "user", "hi"), (7, 1, "assistant", "yo"), (7, 2, "user", "x"), (8, None, "user", ""),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit(1).alias(c) for c in ("part", "pos", "h1", "a", "c", "n")))
    got = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert sorted(k or 0 for k in got) == [0, 2, 4, 5, 6, 8]
    assert got[2].n_turns == 3 and got[2].copies == 2
    assert got[2].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\nx<|im_end|>"
    assert got[5].text == "<|im_start|>user\nhi<|im_end|>" and len(got[6].text) > 200_000
    assert chat.format_chats(turns.limit(0)).count() == 0
    one = spark.range(500).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    parts = chat.format_chats(one).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(8)) and "\n".join(p.text for p in parts).count("<|im_start|>") == 500


def test_top_k(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [nan, 0.0], 1), (4, [inf, 0.0], 1), (5, None, 1), (6, [None, 1.0], 1), (7, [-1.0], 1), (None, [1.0, 1.0], 1), (1, [1.0, 0.0], 1), (8, [], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").select("*", F.lit(1).alias("v"), F.lit(2).alias("shard"), F.lit(2).alias("group"))
    fine = topk.usable(vectors, "vec_id", "embedding")
    got = [tuple(r) for r in topk.top_k(fine, fine.where("id % 20 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 4096), (0, 2, 2, 4096), (0, 3, 20, 2048), (20, 1, 0, 2048), (20, 2, 1, 2048), (20, 3, 2, 2048)]
    assert topk.top_k(fine.limit(0), fine.limit(0)).count() == 0 and topk.top_k(fine, fine.limit(0)).count() == 0
    large = spark.createDataFrame([(0, [3e7, 1.0]), (1, [3e7, 1.0])], "id long, v array<double>")
    assert topk.top_k(large, large).first().score == (64 * 30_000_000) ** 2 + 64 * 64
