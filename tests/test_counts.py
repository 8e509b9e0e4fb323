"""Counts over batches against patterns and plain Python, and how often scores take them."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tidewater.functions import content, scores, text
from tidewater.operators import counts
from tidewater.plans import content as plan

BLANK = " \t\n\x0b\x0c\r"


def odd_texts():
    rng = random.Random(3)
    signs = "aeiouybcde  \n.!?é ſ9'\"-%/E\x0bsaid told"
    return [None, "", " ", "e", "ee e", "\n", ".", "..a", "yea! 'e e' xe x", "the the THE then then", "éééé éééé", "İstanbul İstanbul", "abab ab ab", "Said he. X said so. told. x told y"] + ["".join(rng.choices(signs, k=rng.randint(1, 80))) for _ in range(150)]


def test_counts_are_those_of_patterns_and_words(spark):
    df = spark.createDataFrame(list(enumerate(odd_texts())), "i int, t string")
    t = F.col("t")
    stated = {"words": text.word_count(t), "sentences": scores.sentence_count(t), "syllables": scores.syllables(t), "plain_syllables": scores.plain_syllables(t), "top": scores.top_term(t, 3)}
    found = counts.counted(df.withColumns({f"_{k}": c for k, c in stated.items()}), "t", *counts.COUNTS).collect()
    for r in found:
        assert {k: r[k] for k in stated} == {k: r[f"_{k}"] for k in stated}, r.t
        low = (r.t or "").lower()
        words = [w for w in re.split(f"[{BLANK}]+", low) if w]
        groups = [len(re.findall("[aeiouy]+", w)) for w in words]
        assert r.words == len(words) and r.syllables == sum(max(1, n - (w.endswith("e") and n > 1)) for w, n in zip(words, groups)), r.t
        assert r.sentences == sum(bool(s.strip(BLANK)) for s in re.split("[.!?]+", r.t or "")), r.t
        assert r.top == max(Counter(w for w in words if len(w) > 3).values(), default=0), r.t
        kept = [w for w in words if len(w) > 2 and w not in scores.COMMON_WORDS]
        assert (r.telling, r.distinct_telling, r.distinct_long) == (len(kept), len(set(kept)), len({w for w in words if len(w) > 3})), r.t
    assert counts.counted(df.limit(0), "t", "words").count() == 0


def test_early_quality_takes_each_count_once(spark, sf_dir):
    logical = plan.early_quality_decisions(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("regexp_extract_all(") == 2 and "aggregate(" not in logical
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t, none = F.col("text"), F.lit(None).cast("string")
    parts = [scores.length_score(t), F.lit(0.5), scores.readability_score(t), F.lit(0.5), scores.language_score(t), scores.spam_score(none, t, none)]
    wanted = {r[0]: r[1] for r in rows.select("doc_id", F.round(scores.early_quality(*parts), 6)).collect()}
    assert {r.doc_id: r.overall for r in plan.early_quality_decisions(spark, sf_dir).collect()} == wanted


def test_content_quality_takes_each_measure_once(spark, sf_dir):
    logical = plan.content_quality_tiers(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count("citing") == 2 and logical.count("obliterates") == 2 and "split(" not in logical
    df = spark.createDataFrame(list(enumerate(odd_texts())), "i int, t string").select("i", "t", scores.fact_density(F.col("t")).alias("d"), content.paragraphs(F.col("t")).alias("p"))
    for r in df.collect():
        t, n = r.t or "", len([w for w in re.split(f"[{BLANK}]+", r.t or "") if w])
        clauses = sum(bool(re.search(rf"(?is)^[^a-z]*[a-z].+\s{verb}\s", s, re.ASCII)) for s in t.split(".") for verb in ("said", "told"))
        found = (r"(?i)according to [A-Za-z][^.,]+", r"(?i)per\s+[A-Za-z]", r"(?i)citing\s+[A-Za-z]", "[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{2,4}", r"\b[0-9]+(?:\.[0-9]+)?%", r"\b[0-9]{2,}\b")
        signals = clauses + sum(len(re.findall(p, t)) for p in found) + t.count('"') // 2 + t.count("'") // 2
        assert abs(r.d - (round(min(1.0, signals / max(n / 80, 1.0) * 0.4), 4) if n else 0.0)) < 1e-9, t
        assert r.p == sum(bool(line.strip(BLANK)) for line in t.split("\n")), t


def test_content_grades_take_words_from_counts(spark, sf_dir):
    from tidewater.plans import texts

    logical = texts.content_grades(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(" not in logical and "[aeiouy]+" not in logical and "distinct_telling" in logical
