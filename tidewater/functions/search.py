"""Search terms as columns and DataFrames: expansion, tiers of full-text matching, relevance to subjects, variants of names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import STOP_WORDS, whole_word


def expand(terms: Column, synonyms: Mapping[str, Sequence[str]]) -> Column:
    """The terms, up to two synonyms of each, and their other number, distinct and in that order."""
    more = F.array().cast("array<string>")
    if synonyms:
        known = F.create_map(*(c for k, v in synonyms.items() for c in (F.lit(k), F.array(*map(F.lit, list(v)[:2])))))
        more = F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>"))))
    number = F.transform(terms, lambda t: F.when(t.endswith("s"), F.substr(t, F.lit(1), F.length(t) - 1)).otherwise(F.concat(t, F.lit("s"))))
    return F.array_distinct(F.concat(terms, more, number))


def stem(word: Column) -> Column:
    """A plain English stem: plural, -ing, -ed and -ly endings cut from words that stay three letters long."""
    return F.regexp_replace(F.lower(word), "(?<=[a-z]{3})(ing|edly|ed|ies|es|ly|s)$", "")


def stems(text: Column) -> Column:
    stops = F.array(*map(F.lit, STOP_WORDS))
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda w: ~F.array_contains(stops, w)), stem))


def tiered_match(df: DataFrame, text: str, terms: Sequence[str], tiers: Sequence[int] = (3, 2, 1)) -> DataFrame:
    """Rows that hold all of the first three terms, or else of the first two, or else the first: the strictest tier with hits.

    One pass marks every row with its tier; the tier that counts comes from a one-row aggregate.
    """
    words = stems(F.col(text))
    wanted = [stem(F.lit(t)) for t in terms]
    level = F.lit(None).cast("int")
    for n in sorted({min(t, len(wanted)) for t in tiers}):
        fits = F.array_contains(words, wanted[0])
        for w in wanted[1:n]:
            fits = fits & F.array_contains(words, w)
        level = F.when(fits, n).otherwise(level)
    rows = df.withColumn("tier", level).where("tier is not null")
    best = rows.agg(F.max("tier").alias("_best"))
    return rows.crossJoin(F.broadcast(best)).where("tier = _best").drop("_best")


def tf_idf_rank(df: DataFrame, key: str, text: str, terms: Sequence[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): BM25 of the terms; counts of terms and lengths are taken in one scan, statistics from one aggregate."""
    low = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    rows = df.select(key, F.size(low).alias("n"), *(_times(low, term).alias(f"t{i}") for i, term in enumerate(terms)))
    stats = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
    met = rows.crossJoin(F.broadcast(stats))
    idf = lambda i: F.log(1 + (F.col("docs") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
    weight = lambda i: F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    score = sum((idf(i) * weight(i) for i in range(len(terms))), F.lit(0.0))
    return met.select(key, score.alias("score")).where("score > 0")


def _times(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda w: w == term))


def relevant(text: Column, anchors: Sequence[str], keywords: Sequence[str]) -> Column:
    """Any anchor as a whole word decides; without anchors any keyword; without both everything is relevant."""
    terms = anchors or keywords
    if not terms:
        return F.lit(True)
    out = F.lit(False)
    for t in terms:
        out = out | whole_word(text, t)
    return F.coalesce(out, F.lit(False))


def subject_variants(subject: Column, places: Mapping[str, str], roles: Sequence[str]) -> Column:
    """Lower-case forms under which a claim's subject may be known: itself, its place, without a role, last two words, last word."""
    base = F.lower(F.trim(F.regexp_replace(subject, r"[\x20\x09-\x0D]+", " ")))
    known = F.create_map(*(F.lit(x) for kv in places.items() for x in kv))
    role = "^(" + "|".join(f"\\Q{r}\\E" for r in sorted(roles, key=len, reverse=True)) + r")\x20+"
    words = F.split(base, " ")
    forms = F.array(
        base, F.try_element_at(known, base), F.regexp_replace(base, role, ""), F.regexp_replace(F.regexp_replace(base, role, ""), role, ""),
        F.when(F.size(words) >= 3, F.array_join(F.slice(words, -2, 2), " ")), F.when(F.size(words) >= 2, F.element_at(words, -1)),
    )
    return F.array_distinct(F.filter(F.array_compact(forms), lambda f: F.length(f) >= 2))


def lexical_overlap(terms: Column, reference: Column) -> Column:
    """Share of the terms that stand somewhere in the reference; 0 without terms."""
    low = F.lower(F.coalesce(reference, F.lit("")))
    hits = F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t))))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(0.0)


def evidence(parts: Sequence[tuple[str, DataFrame, Sequence[Column], int]]) -> DataFrame:
    """Rows of several sources under one schema, each with its name and at most so many rows, its first by its order."""
    out = None
    for name, df, order, most in parts:
        part = df.orderBy(*order).limit(most).withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
