"""How much an item matters: significance, importance of events, reliability of sources, bias, and priority by rules."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.scores import clip, tier

# fixed values: words of high and of medium significance
HIGH = ("crisis", "emergency", "breaking", "major", "critical", "war", "death", "scandal")
MEDIUM = ("announce", "policy", "government", "election", "market", "economic")
# fixed values: groups of words that make an event important, and what each group adds
IMPORTANT = (
    (("major", "significant", "important", "critical", "key"), 0.2), (("crisis", "emergency", "urgent", "breaking"), 0.3),
    (("first", "only", "unprecedented", "historic"), 0.2), (("shutdown", "government", "congress", "senate", "house"), 0.1),
)
# fixed values: tiers of sources by their names, with a score; all others are of the last tier, and no name is unknown
RELIABLE = (
    ("tier_1", 0.95, ("reuters", "associated press", "ap news", "bbc", "npr", "pbs", "c-span")),
    ("tier_2", 0.85, ("new york times", "washington post", "wall street journal", "financial times", "the economist", "bloomberg", "the guardian", "politico")),
    ("tier_3", 0.70, ("cnn", "abc news", "cbs news", "nbc news", "fox news", "usa today", "los angeles times")),
)
OTHER_SOURCE, NO_SOURCE = ("tier_4", 0.50), ("unknown", 0.3)


class Rule(NamedTuple):
    """What a match of value does to a priority. field is text (title or content), source or category.

    Actions: boost and suppress by score times weight, track by half of that, avoid to zero.
    """

    field: str
    value: str
    action: str
    score: float = 50.0
    weight: float = 1.0


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _any(low: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | F.contains(low, F.lit(term))
    return out


def significance(title: Column, description: Column, articles: Column) -> Column:
    """.5, .1 for each high and .05 for each medium word present, and a fiftieth for each article up to .3; 1 at most."""
    whole = F.concat_ws(" ", _lower(title), _lower(description))
    found = lambda terms: sum((F.contains(whole, F.lit(t)).cast("int") for t in terms), F.lit(0))
    return F.least(F.lit(1.0), 0.5 + 0.1 * found(HIGH) + 0.05 * found(MEDIUM) + F.least(F.coalesce(articles, F.lit(0)) / 50.0, F.lit(0.3)))


def event_importance(sentence: Column, confidence: Column) -> Column:
    """.5, a fifth of the confidence of its time, and what its groups of words add; 1 at most."""
    score = 0.5 + 0.2 * F.coalesce(confidence, F.lit(0.0))
    for terms, value in IMPORTANT:
        score = score + F.when(_any(_lower(sentence), terms), value).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def source_reliability(source: Column) -> Column:
    """(tier, score) of a source: the first tier with a name that holds the source's or is held by it."""
    low = F.trim(_lower(source))
    level = lambda name, score: F.struct(F.lit(name).alias("tier"), F.lit(score).alias("score"))
    out = F.when(low == "", level(*NO_SOURCE))
    for name, score, terms in RELIABLE:
        held = F.lit(False)
        for term in terms:
            held = held | F.contains(F.lit(term), low)
        out = out.when(_any(low, terms) | held, level(name, score))
    return out.otherwise(level(*OTHER_SOURCE))


def bias_blend(source: Column, content: Column) -> Column:
    return clip(0.4 * source + 0.6 * content, -1.0, 1.0)


def article_priority(title: Column, content: Column, source: Column, category: Column, rules: Sequence[Rule], collection: Sequence[Rule] = ()) -> Column:
    """0 to 100: 50 moved by the rules that match, in their order, and then by those of a collection, whose boosts count .3.

    Null fields are empty. A rule after an avoid moves the zero that it left; values are compared in lower case.
    """
    fields = {"text": (_lower(title), _lower(content)), "source": (_lower(source),), "category": (_lower(category),)}
    shares = {"boost": 1.0, "suppress": -1.0, "track": 0.5}
    score = F.lit(50.0)
    for rule, share in [(r, r.weight) for r in rules] + [(r, 0.3) for r in collection]:
        fits = F.lit(False)
        for field in fields[rule.field]:
            fits = fits | F.contains(field, F.lit(rule.value.lower()))
        if rule.action == "avoid":
            score = F.when(fits, 0.0).otherwise(score)
        else:
            score = score + F.when(fits, rule.score * share * shares[rule.action]).otherwise(0.0)
    return clip(score, 0.0, 100.0)


def collection_level(priority: Column) -> Column:
    return tier(priority, ((75, "high"), (50, "medium")), "low")
