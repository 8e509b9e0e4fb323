"""Places for model calls: batch functions with an exchangeable backend and deterministic fallbacks that need none."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import keywords, words

SLICE_ROWS = 256
Backend = Callable[[pd.Series], pd.Series]


def text_model(backend: Backend, returns: str = "string") -> Callable[[Column], Column]:
    """A column function over Arrow batches for any backend that maps a series of texts to a series of results."""

    @F.pandas_udf(returns)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            # results may be far larger than texts, so no more than SLICE_ROWS of them are held at once
            for at in range(0, len(batch), SLICE_ROWS):
                yield backend(batch.iloc[at : at + SLICE_ROWS])

    return call


def lead_summary(text: Column, n: int = 2) -> Column:
    """Fallback summary: the first sentences."""
    return F.array_join(F.slice(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), 1, n), "")


def key_points(text: Column, n: int = 5) -> Column:
    return keywords(text, 4, n, distinct=True)


# fixed values: types of facts by words of the predicate, the first that fits counts
FACT_TYPES = (
    ("stated", "STATEMENT"), ("said", "STATEMENT"), ("announced", "STATEMENT"), ("declared", "STATEMENT"), ("claimed", "STATEMENT"), ("argued", "STATEMENT"),
    ("voted", "ACTION"), ("signed", "ACTION"), ("launched", "ACTION"), ("approved", "ACTION"), ("rejected", "ACTION"),
    ("imposed", "ACTION"), ("appointed", "ACTION"), ("resigned", "ACTION"), ("arrested", "ACTION"),
    ("holds", "POSITION"), ("supports", "POSITION"), ("opposes", "POSITION"),
    ("leads", "RELATIONSHIP"), ("allied with", "RELATIONSHIP"), ("is", "ATTRIBUTE"), ("was", "ATTRIBUTE"), ("has", "ATTRIBUTE"),
)


def fact_type(predicate: Column) -> Column:
    low = F.lower(F.trim(predicate))
    out = F.when(F.contains(low, F.lit(FACT_TYPES[0][0])), FACT_TYPES[0][1])
    for word, kind in FACT_TYPES[1:]:
        out = out.when(F.contains(low, F.lit(word)), kind)
    return out.otherwise("STATEMENT")


# fixed values: kinds of events by words of the sentence, the first that fits counts
EVENT_TYPES = (
    ("government_action", "shutdown|shut down|closure|closed"), ("announcement", "announced|declared|revealed|disclosed"),
    ("legislative", "passed|approved|enacted|legislation"), ("diplomatic", "meeting|talks|negotiations|discussions"),
    ("protest", "protest|demonstration|rally|march"), ("electoral", "election|vote|voting|ballot"),
)


def event_type(sentence: Column) -> Column:
    low = F.lower(sentence)
    out = F.when(low.rlike(EVENT_TYPES[0][1]), EVENT_TYPES[0][0])
    for kind, pattern in EVENT_TYPES[1:]:
        out = out.when(low.rlike(pattern), kind)
    return out.otherwise("general")


def rule_claims(contexts: DataFrame, key: str, text: str) -> DataFrame:
    """Fallback claim extraction: (key, subject, predicate, object, fact_type) of sentences with a capitalised subject."""
    sentence = F.explode(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+", -1)).alias("s")
    pattern = r"^\x20*([A-Z][a-z]+(?:\x20[A-Z][a-z]+)*)\x20([a-z]+)\x20(.+)$"
    rows = contexts.select(key, sentence).where(F.col("s").rlike(pattern))
    part = lambda n: F.regexp_extract("s", pattern, n)
    return rows.select(key, part(1).alias("subject"), part(2).alias("predicate"), part(3).alias("object")).withColumn("fact_type", fact_type(F.col("predicate")))


def hash_embedding(size: int = 768, most_words: int = 200) -> Callable[[Column], Column]:
    """Feature-hashed unit vectors: each word by the first eight bytes of its SHA-256, weights falling with its place, word pairs at half weight.

    The first most_words words are the model's own window, as for any encoder.
    """

    def vector(text: str | None) -> np.ndarray:
        out = np.zeros(size)
        tokens = (text or "").lower().split(None, most_words)[:most_words]
        for kind, items in ((1.0, tokens), (0.5, [f"{a}_{b}" for a, b in zip(tokens, tokens[1:], strict=False)])):
            for i, token in enumerate(items):
                out[int.from_bytes(hashlib.sha256(token.encode()).digest()[:8], "big") % size] += kind * np.exp(-0.01 * i)
        length = np.linalg.norm(out)
        return out / length if length else out

    return text_model(lambda batch: batch.map(vector), "array<double>")


def chunks(text: Column, size: int = 200, overlap: int = 20) -> Column:
    """Overlapping pieces of so many words; the last may be shorter. The step is at least one word, so it always ends."""
    tokens = words(text)
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - overlap, F.lit(1)), F.lit(step))
    made = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.when(F.size(tokens) > 0, made).otherwise(F.array().cast("array<string>"))


def contradiction(pred_a: Column, obj_a: Column, pred_b: Column, obj_b: Column) -> Column:
    """How likely two claims of one subject contradict each other: negation .9, opposite predicates .8, numbers a fifth apart .6."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    negated = lambda c: F.contains(low(c), F.lit("not "))
    number = lambda c: F.expr("null") if c is None else F.nullif(F.regexp_extract(low(c), r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    a, b = number(obj_a), number(obj_b)
    apart = F.coalesce(F.abs(a - b) / F.nullif(F.greatest(F.abs(a), F.abs(b)), F.lit(0.0)) > 0.2, F.lit(False))
    opposite = (low(pred_a).rlike("support|increase|rise|approve") & low(pred_b).rlike("oppose|decrease|fall|reject")) | (low(pred_b).rlike("support|increase|rise|approve") & low(pred_a).rlike("oppose|decrease|fall|reject"))
    return F.when((negated(pred_a) != negated(pred_b)) | (negated(obj_a) != negated(obj_b)), 0.9).when(opposite, 0.8).when(apart, 0.6).otherwise(0.0)


