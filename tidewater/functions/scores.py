"""Scores of texts between 0 and 1: length, readability, structure, uniqueness, completeness, language, spam, facts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import ratio, word_count, words


def clip(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def length_score(text: Column) -> Column:
    """Rises to 200 words steeply and to 2,000 slowly, falls to 5,000, then stays."""
    return length_of(word_count(text), F.coalesce(text, F.lit("")) == "")


def length_of(n: Column, empty: Column) -> Column:
    """The same of a text of n words."""
    return (
        F.when(n == 0, F.when(empty, 0.0).otherwise(0.1)).when(n < 50, 0.1)
        .when(n < 200, 0.3 + (n - 50) / 150 * 0.4).when(n <= 2000, 0.7 + (n - 200) / 1800 * 0.3)
        .when(n <= 5000, 1.0 - (n - 2000) / 3000 * 0.2).otherwise(0.8)
    )


def scorer_length(text: Column) -> Column:
    """1 between 200 and 1,000 words, steps below, a slope above."""
    return scorer_length_of(word_count(text))


def scorer_length_of(n: Column) -> Column:
    return F.when(n > 1000, F.greatest(F.lit(0.3), 1.0 - (n - 1000) / 5000)).when(n >= 200, 1.0).when(n >= 100, 0.7).when(n >= 50, 0.4).otherwise(0.1)


def syllables(text: Column) -> Column:
    """Vowel groups of each word less one for a final e, at least one a word, summed.

    Counted by patterns over the whole text: groups, words without any, and words of several groups that end in e.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    count = lambda p: F.regexp_count(low, F.lit(rf"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0Daeiouy]{p}"))
    return F.regexp_count(low, F.lit("[aeiouy]+")) + count(r"++(?![^\x20\x09-\x0D])") - count(r"*+[aeiouy]++[^\x20\x09-\x0Daeiouy][^\x20\x09-\x0D]*+(?<=e)")


def plain_syllables(text: Column) -> Column:
    """The rule of the early gate, over letters a-z alone: one a word, one more for each vowel after a consonant, less one for a final e.

    Words that come to nothing add nothing, but one at the start of a text counts as one. Counted by patterns over the
    whole text, without an array of its words.
    """
    letters = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\x20\x09-\x0D]", "")
    count = lambda p: F.regexp_count(letters, F.lit(p))
    starts_empty = letters.rlike(r"^[\x20\x09-\x0D]*[aeiouy]*e(?:[^a-z]|$)").cast("int")
    return count("[a-z]+") + count("[bcdfghjklmnpqrstvwxz][aeiouy]") - count("e(?:[^a-z]|$)") + starts_empty


def sentences(text: Column) -> Column:
    """Pieces between runs of full stops, exclamation and question marks."""
    return F.split(F.coalesce(text, F.lit("")), "[.!?]+", -1)


def sentence_count(text: Column) -> Column:
    """How many of these pieces hold more than white space, counted from their first other character on."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\x20\x09-\x0D][^.!?]*+"))


def flesch(text: Column, count: Callable[[Column], Column] = syllables) -> Column:
    """Flesch reading ease with a rule that counts syllables; null without words or sentences."""
    return ease(word_count(text), sentence_count(text), count(text))


def ease(n: Column, s: Column, y: Column) -> Column:
    """Flesch reading ease of n words in s sentences with y syllables."""
    return F.when((n > 0) & (s > 0), 206.835 - 1.015 * (n / s) - 84.6 * (y / n))


def tier(score: Column, steps: Sequence[tuple[float, float]], rest: float) -> Column:
    """The value of the first bound that the score reaches."""
    out = F.when(score >= steps[0][0], steps[0][1])
    for bound, value in steps[1:]:
        out = out.when(score >= bound, value)
    return out.otherwise(rest)


# fixed values: values by bounds of the Flesch score
READABILITY_TIERS = ((80, 1.0), (60, 0.9), (40, 0.8), (20, 0.6))
SCORER_READABILITY_TIERS = ((80, 1.0), (60, 0.8), (40, 0.6), (20, 0.4))


def readability_of(found: Column, steps: Sequence[tuple[float, float]], rest: float) -> Column:
    """The tier of a Flesch score; 0 where it is null."""
    return F.when(found.isNull(), 0.0).otherwise(tier(found, steps, rest))


def _tier_of(text: Column, count: Callable[[Column], Column], steps: Sequence[tuple[float, float]], rest: float) -> Column:
    """The tier of a text, whose words, sentences and syllables are counted once here."""
    counts = F.struct(word_count(text).alias("n"), sentence_count(text).alias("s"), count(text).alias("y"))
    return _once(_once(counts, lambda c: ease(c["n"], c["s"], c["y"])), lambda x: readability_of(x, steps, rest))


def readability_score(text: Column) -> Column:
    """Readability at the early gate, with its plainer rule of syllables."""
    return _tier_of(text, plain_syllables, READABILITY_TIERS, 0.3)


def scorer_readability(text: Column) -> Column:
    """Readability as one of the dimensions of content_score."""
    return _tier_of(text, syllables, SCORER_READABILITY_TIERS, 0.2)


def readability_counts(df: DataFrame, text: str) -> DataFrame:
    """df without text, with the counts that readability is made of: n words, s sentences, y syllables, letters and hard words.

    The words of each row are put in rows of their own and summed again, before anything is shuffled, by compiled code.
    """
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    others = [c for c in df.columns if c != text]
    letters = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]"))
    # counted below the explode, which repeats what stands beside it for every word
    counted = keyed.select("_row", *others, sentence_count(F.col(text)).alias("s"), letters.alias("letters"), words(F.lower(text)).alias("_words"))
    each = counted.select("_row", *others, "s", "letters", F.explode("_words").alias("_word"))
    each = each.withColumn("_vowels", F.regexp_count("_word", F.lit("[aeiouy]+")))
    silent = (F.endswith("_word", F.lit("e")) & (F.col("_vowels") > 1)).cast("int")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.greatest(F.lit(1), F.col("_vowels") - silent)).alias("y"), F.sum((F.col("_vowels") >= 3).cast("int")).alias("hard")]
    return each.groupBy("_row", *others, "s", "letters").agg(*sums).drop("_row")


def flesch_of(counts: DataFrame) -> Column:
    """Flesch reading ease over readability_counts; null without words or sentences."""
    return ease(*(counts[c] for c in ("n", "s", "y")))


def grades_of(counts: DataFrame) -> dict[str, Column]:
    """Flesch-Kincaid, Fog, SMOG, ARI and Coleman-Liau grades, and the mean of those above 0, over readability_counts with sentences."""
    n, s, y, letters, hard = (counts[c] for c in ("n", "s", "y", "letters", "hard"))
    grades = {
        "flesch_kincaid": 0.39 * (n / s) + 11.8 * (y / n) - 15.59,
        "fog": 0.4 * (n / s + 100 * (hard / n)),
        "smog": 1.043 * F.sqrt(hard.cast("double")) + 3.1291,
        "ari": 4.71 * (letters / n) + 0.5 * (n / s) - 21.43,
        "coleman_liau": 0.0588 * (100 * (letters / n)) - 0.296 * (100 * (s / n)) - 15.8,
    }
    total = sum((F.when(g > 0, g).otherwise(0.0) for g in grades.values()), F.lit(0.0))
    above = sum(((g > 0).cast("int") for g in grades.values()), F.lit(0))
    return grades | {"mean_grade": ratio(total, above)}


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value) with a costly value that is evaluated once here, however often it stands in the result."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def structure_score(text: Column) -> Column:
    """Paragraphs .3, three real sentences .3, varied sentence lengths .2, a capital letter .2."""
    # more than ten characters without the blanks around them
    valid = F.filter(sentences(text), lambda s: s.rlike(r"(?s)[^\x20\x09-\x0D].{9,}[^\x20\x09-\x0D]"))
    point = lambda cond, v: F.when(cond, v).otherwise(0.0)

    def varied(sizes: Column) -> Column:
        n = F.size(sizes)
        total = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x)
        squares = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x * x)
        variance = F.when(n > 1, squares / n - (total / n) * (total / n)).otherwise(0.0)
        return F.struct(point(n >= 3, 0.3).alias("enough"), point(variance > 10, 0.2).alias("varied"))

    found = lambda s: point(F.contains(whole, F.lit("\n\n")), 0.3) + s["enough"] + s["varied"] + point(whole.rlike("[A-Z]"), 0.2)
    whole = F.coalesce(text, F.lit(""))
    return _once(_once(F.transform(valid, lambda s: word_count(s).cast("double")), varied), found)


# fixed values: words too common to tell texts apart
COMMON_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those", "i", "you",
    "he", "she", "it", "we", "they",
)


def uniqueness_score(text: Column) -> Column:
    """Distinct over all words that are longer than two characters and not common, in steps; 0 without such words."""
    kept = F.filter(words(F.lower(text)), lambda w: (F.length(w) > 2) & ~w.isin(*COMMON_WORDS))  # looked up in a set
    share = _once(kept, lambda k: F.when(F.size(k) > 0, F.size(F.array_distinct(k)).cast("double") / F.size(k)))
    return _once(share, uniqueness_of)


def uniqueness_of(s: Column) -> Column:
    """The same of the share of distinct words, null without words."""
    return F.when(s.isNull(), 0.0).when(s < 0.3, 0.2).when(s < 0.5, 0.5).when(s < 0.7, 0.8).otherwise(1.0)


def completeness_score(text: Column, title: Column, n: Column | None = None) -> Column:
    """A fifth each for a title, a first and a last paragraph of some length, 100 words, five sentences."""
    whole = F.coalesce(text, F.lit(""))
    paragraphs = F.split(whole, "\n\n", -1)
    point = lambda cond: F.when(cond, 0.2).otherwise(0.0)
    return (
        point(F.length(F.trim(F.coalesce(title, F.lit("")))) > 5) + point(F.length(F.element_at(paragraphs, 1)) > 50)
        + point(F.length(F.element_at(paragraphs, -1)) > 30) + point((word_count(text) if n is None else n) > 100) + point(F.size(sentences(text)) >= 5)
    )


def top_term(text: Column, least: int) -> Column:
    """The most often that a lower-case word longer than least characters is repeated."""
    low, word = F.lower(F.coalesce(text, F.lit(""))), rf"[^\x20\x09-\x0D]{{{least + 1},}}"
    # in a sorted text equal words are neighbours, and a run's length tells how many it holds
    kept = F.array_join(F.sort_array(F.regexp_extract_all(low, F.lit(word), F.lit(0))), " ")
    runs = F.regexp_extract_all(kept, F.lit(r"(?<![^\x20])([^\x20]++)(?:\x20\1(?![^\x20]))++"), F.lit(0))
    held = F.transform(runs, lambda r: ((F.length(r) + 1) / (F.length(F.substring_index(r, " ", 1)) + 1)).cast("int"))
    return F.coalesce(F.array_max(held), low.rlike(word).cast("int"))


def language_score(text: Column) -> Column:
    """Share of Latin words and of capitalised ones, less the share of the commonest word."""
    return language_of(word_count(text), *latin_words(text), top_term(text, 3))


def latin_words(text: Column) -> tuple[Column, Column]:
    """How many words of Latin letters, and how many capitalised ones."""
    count = lambda p: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p))
    return count(r"\b[a-zA-Z]+\b"), count(r"\b[A-Z][a-z]+\b")


def language_of(n: Column, latin: Column, proper: Column, top: Column) -> Column:
    """The same of a text of n words, of which the commonest stands top times."""
    penalty = F.least(top / n, F.lit(0.5))
    return F.when(n > 0, clip(0.6 * (latin / n) + 0.4 * (proper / F.greatest(latin, F.lit(1))) - penalty)).otherwise(0.0)


def language_quality(text: Column, n: Column | None = None, distinct: Column | None = None) -> Column:
    """A fifth each for a sentence mark, a capital, no word with a letter three times in a row, three sentences, 20 long words.

    Up to a hundredth of words with such a letter give a tenth.
    """
    whole = F.coalesce(text, F.lit(""))
    n, odd = word_count(text) if n is None else n, F.regexp_count(whole, F.lit(r"([^\x20\x09-\x0D])\1{2}[^\x20\x09-\x0D]*"))
    real = F.filter(sentences(text), lambda s: F.length(F.regexp_replace(s, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")) > 5)
    distinct = F.size(F.array_distinct(F.filter(words(F.lower(text)), lambda w: F.length(w) > 3))) if distinct is None else distinct
    point = lambda cond, v=0.2: F.when(cond, v).otherwise(0.0)
    typed = F.when(n == 0, 0.0).when(odd == 0, 0.2).when(odd <= n * 0.01, 0.1).otherwise(0.0)
    return point(whole.rlike("[.!?]")) + point(whole.rlike("[A-Z]")) + typed + point(F.size(real) >= 3) + point(distinct > 20)


def content_score(length: Column, readability: Column, structure: Column, uniqueness: Column, completeness: Column, language: Column) -> Column:
    return weighted([(0.15, length), (0.20, readability), (0.15, structure), (0.15, uniqueness), (0.15, completeness), (0.20, language)])


# fixed values: marks of spam
SPAM_TITLE = ("click here", "free", "win", "prize", "urgent", "act now", "limited time")
SPAM_TEXT = ("make money", "work from home", "get rich", "lose weight", "viagra", "casino")
SPAM_HOSTS = (".tk", ".ml", ".ga", ".cf", "bit.ly", "tinyurl")


def spam_score(title: Column, text: Column, url: Column, n: Column | None = None, top: Column | None = None) -> Column:
    """1 less indicators over checks; below 0 when a check gives several. An empty part isn't checked.

    n and top are the text's word_count and top_term where they are known already.
    """
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    one = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")
    any_of = lambda c, terms: _once(F.lower(c), lambda low: reduce(or_, (F.contains(low, F.lit(t)) for t in terms)))
    n, top = word_count(text) if n is None else n, top_term(text, 3) if top is None else top
    hits = one((F.length(title) > 10) & (F.regexp_count(title, F.lit("[A-Z]")) / F.length(title) > 0.7)) + one(any_of(title, SPAM_TITLE))
    hits = hits + one((F.regexp_count(title, F.lit("!")) > 2) | (F.regexp_count(title, F.lit("\\?")) > 2))
    hits = hits + one((n > 100) & (top > n * 0.1)) + one(any_of(text, SPAM_TEXT))
    hits = hits + one(any_of(url, SPAM_HOSTS)) + one(F.length(F.get(F.split(url, "\\?", -1), 1)) > 100 if url is not None else F.lit(False))
    checks = has(title).cast("int") + has(text).cast("int") + has(url).cast("int")
    return F.when(checks > 0, 1.0 - hits / checks).otherwise(0.0)


def fact_density(text: Column) -> Column:
    """Numbers, dates, percentages, attributions and quotes by length, at most 1, to four places.

    "X said" and "X told" count once between two full stops, however often they stand there, since their pattern reaches
    from the first letter to the last such word.
    """
    return density_of(word_count(text), fact_signals(text, F.lower(text)))


def fact_signals(text: Column, low: Column) -> Column:
    """How many of these signs stand in a text; low is the text in lower case, in which the patterns' fixed words are sought first."""
    whole = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(whole, F.lit(p))
    having = lambda word, p: F.when(F.contains(low, F.lit(word)), count(p)).otherwise(0)
    pairs = lambda c: F.floor((F.length(whole) - F.length(F.replace(whole, F.lit(c), F.lit("")))) / 2)
    clauses = lambda verb: having(verb, rf"(?is)(?<![^.])[^a-z.]*+[a-z][^.]+\s{verb}\s")
    signals = clauses("said") + clauses("told") + having("according to ", r"(?i)according to [A-Za-z][^.,]+") + having("per", r"(?i)per\s+[A-Za-z]") + having("citing", r"(?i)citing\s+[A-Za-z]")
    return signals + count(r"[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{2,4}") + having("%", r"\b[0-9]+(?:\.[0-9]+)?%") + count(r"\b[0-9]{2,}\b") + pairs('"') + pairs("'")


def density_of(n: Column, signals: Column) -> Column:
    """The same of a text of n words."""
    return F.when(n > 0, F.round(F.least(F.lit(1.0), signals / F.greatest(n / 80.0, F.lit(1.0)) * 0.4), 4)).otherwise(0.0)


def lexicon_sentiment(text: Column, good: Sequence[str], bad: Sequence[str]) -> Column:
    """(good - bad) / (good + bad) over substring counts; 0 without any."""
    whole = F.lower(F.coalesce(text, F.lit("")))
    count = lambda terms: sum(((F.length(whole) - F.length(F.replace(whole, F.lit(t), F.lit("")))) / len(t) for t in terms), F.lit(0.0))
    return ratio(count(good) - count(bad), count(good) + count(bad))


def weighted(parts: Sequence[tuple[float, Column]]) -> Column:
    return sum((w * c for w, c in parts), F.lit(0.0))


def early_quality(length: Column, source: Column, readability: Column, freshness: Column, language: Column, spam: Column) -> Column:
    return clip(weighted([(0.20, length), (0.25, source), (0.15, readability), (0.15, freshness), (0.10, language), (0.15, spam)]))


def rejection_reasons(overall: Column, length: Column, source: Column, readability: Column, freshness: Column, language: Column, spam: Column, least: float = 0.4) -> Column:
    """Names of the bounds that a text fails; empty when it passes."""
    bounds = ((overall, least, "overall"), (length, 0.2, "length"), (source, 0.3, "source"), (readability, 0.3, "readability"), (freshness, 0.2, "freshness"), (language, 0.4, "language"), (spam, 0.5, "spam"))
    return F.array_compact(F.array(*(F.when(c < bound, name) for c, bound, name in bounds)))


def grade(score: Column) -> Column:
    steps = ((0.9, "A+"), (0.8, "A"), (0.7, "B+"), (0.6, "B"), (0.5, "C+"), (0.4, "C"), (0.3, "D"))
    return tier(score, steps, "F")


def age_tier(hours: Column, steps: Sequence[tuple[float, float]], rest: float, unknown: float | None = None) -> Column:
    """The value of the first bound that an age does not exceed."""
    out = F.when(hours.isNull(), unknown)
    for bound, value in steps:
        out = out.when(hours <= bound, value)
    return out.otherwise(rest)


# fixed values: freshness and proximity by age in hours
FRESHNESS = ((1, 1.0), (6, 0.9), (24, 0.8), (72, 0.6), (168, 0.4))
PROXIMITY = ((1, 1.0), (6, 0.95), (24, 0.85), (72, 0.65), (168, 0.45), (336, 0.25), (720, 0.10))


def freshness(published: Column, as_of: Column) -> Column:
    return age_tier((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / 3.6e9, FRESHNESS, 0.2, 0.5)


def proximity(a: Column, b: Column) -> Column:
    return age_tier(F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 3.6e9, PROXIMITY, 0.0)


def rerank_score(relevance: Column, quality: Column, age_days: Column, title_match: Column, credibility: Column) -> Column:
    recency = F.when(age_days.isNull(), 0.1).otherwise(0.2 * F.greatest(1 - age_days / 30.0, F.lit(0.0)))
    return 0.4 * relevance + 0.2 * quality + recency + 0.1 * title_match + 0.1 * credibility
