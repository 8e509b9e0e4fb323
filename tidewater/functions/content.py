"""Quality of news-like content as columns: clickbait, depth, specificity, tiers, entities, citations, priorities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.scores import clip, fact_density, tier, weighted
from tidewater.functions.text import word_count

# fixed values: marks of official documents, and patterns of clickbait titles
OFFICIAL = (
    "press release", "press release:", "for immediate release", "official statement", "official announcement", "filing", "filed", "sec filing",
    "sec form", "regulatory filing", "news brief", "brief:", "announcement:", "statement:", "report:",
)
CLICKBAIT = (
    r"you won\'t believe", r"shocking.*will.*blow.*mind", r"amazing trick", r"one weird trick", r"doctors hate", r"this one thing",
    r"number one reason", r"secret.*will.*blow.*mind", r"\d+.*things.*need.*know", r"before.*die", r"changed.*life.*forever",
    r"everyone.*talking.*about", r"going.*viral", r"trending.*now", r"you.*never.*guess", r"what.*happens.*next.*shock",
)
# fixed values: words of emotion
EMOTIONAL = (
    "slams", "blasts", "destroys", "obliterates", "furious", "outrage", "panic", "chaos", "devastating", "shocking", "explosive", "bombshell",
    "nightmare", "horror",
)


def is_clickbait(title: Column) -> Column:
    """Whether a title reads like clickbait and like no official document."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return ~low.rlike("|".join(f"\\Q{t}\\E" for t in OFFICIAL)) & low.rlike("|".join(CLICKBAIT))


def _present(text: Column, words: Sequence[str]) -> Column:
    """How many of the words stand in the text."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


# fixed values: marks of bait in headlines, and of vague ones
HEADLINE_TRIGGERS = (
    r"BREAKING:", r"SHOCKING:", r"EXCLUSIVE:", r"You Won't Believe", r"This One.*Thing", r"Doctors Hate", r"With This.*Trick", r"One Weird Trick",
    r"Number \d+ Will", r"Changed Everything", r"Game Changer", r"Going Viral", r"Trending Now",
)
VAGUE_TITLES = (
    r"What.*Happened Next", r"The.*Reason Why", r"Everyone Is.*Talking About", r"They Don't Want You to Know", r"This One (Thing|Trick|Secret)",
)


def clickbait_score(title: Column, content: Column, short: int = 200) -> Column:
    """0 to 1: a title of bait .4, each headline mark .15, each vague one .12, emotion by length up to .25, under short words .2."""
    return bait_of(title, word_count(content), emotional(F.lower(F.coalesce(content, F.lit("")))), short)


def bait_of(title: Column, n: Column, felt: Column, short: int = 200) -> Column:
    """The same of a title and a text of n words that holds felt words of emotion."""
    head = F.coalesce(title, F.lit(""))
    marks = lambda patterns: sum((head.rlike(f"(?i){p}").cast("int") for p in patterns), F.lit(0))
    felt = F.least(F.lit(0.25), felt / F.greatest(n / 100.0, F.lit(1.0)) * 0.5)
    titled = F.when(is_clickbait(title), 0.4).otherwise(0.0) + 0.15 * marks(HEADLINE_TRIGGERS) + 0.12 * marks(VAGUE_TITLES)
    return F.least(F.lit(1.0), titled + F.when(n > 0, felt).otherwise(0.0) + F.when(n < short, 0.2).otherwise(0.0))


def emotional(low: Column) -> Column:
    """How many words of emotion stand in a lower-case text."""
    return _present(low, EMOTIONAL)


def emotion(title: Column, content: Column) -> Column:
    whole = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    return emotion_of(word_count(whole), emotional(F.lower(whole)))


def emotion_of(n: Column, felt: Column) -> Column:
    """The same of n words of title and text that hold felt words of emotion."""
    return F.when(n > 0, F.least(F.lit(1.0), felt / F.greatest(n / 150.0, F.lit(1.0)) * 0.5)).otherwise(0.0)


def depth(content: Column) -> Column:
    """Length up to 600 words, paragraphs, and a question word."""
    whole = F.coalesce(content, F.lit(""))
    return depth_of(word_count(content), paragraphs(content), asks(F.lower(whole)), whole == "")


def paragraphs(content: Column) -> Column:
    """Lines that hold more than white space, counted from their first other character on."""
    return F.regexp_count(F.coalesce(content, F.lit("")), F.lit(r"[^\x20\x09-\x0D][^\n]*+"))


def asks(low: Column) -> Column:
    """Whether a lower-case text holds a question word."""
    return low.rlike(r"\b(who|what|when|where|why|how)\b")


def depth_of(n: Column, lines: Column, asking: Column, empty: Column) -> Column:
    """The same of a text of n words and so many paragraphs."""
    score = F.least(F.lit(1.0), n / 600.0) * 0.5 + F.least(F.lit(0.3), lines * 0.02) + F.when(asking, 0.2).otherwise(0.0)
    return F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), score))


def specificity(content: Column) -> Column:
    """Amounts .35, double names .35, quotes .3."""
    whole = F.coalesce(content, F.lit(""))
    point = lambda cond, v: F.when(cond, v).otherwise(0.0)
    amounts = whole.rlike(r"[0-9]+(?:\.[0-9]+)?%|\$[0-9]+|[0-9]+ (?:million|billion|thousand)")
    return F.least(F.lit(1.0), point(amounts, 0.35) + point(whole.rlike("[A-Z][a-z]+ [A-Z][a-z]+"), 0.35) + point(whole.rlike("[\"']"), 0.3))


# fixed values: known outlets in two tiers, and words that name a source or an institution
OUTLETS = (
    (0.9, ("reuters", "ap news", "associated press", "bbc", "bloomberg", "financial times", "wall street journal", "wsj", "economist", "new york times", "washington post", "npr", "ap", "afp")),
    (0.75, ("guardian", "cnn", "fox news", "nbc", "abc", "cbs", "pbs", "marketwatch", "cnbc", "forbes", "fortune", "politico", "axios")),
)
NAMED_SOURCES = ("according to", "said a", "said the", "spokesperson", "official")
INSTITUTIONS = ("department of", "ministry of", "university of", "institute", "bureau of")


def source_quality(source: Column, content: Column) -> Column:
    """Reliability from 0 to 1: .3, or that of the first tier with an outlet in the source's name, more for sources and institutions that the text names."""
    return source_quality_of(source, F.lower(F.coalesce(content, F.lit(""))))


def source_quality_of(source: Column, low: Column) -> Column:
    """The same of a text in lower case."""
    name = F.lower(F.coalesce(source, F.lit("")))
    held = lambda names: name.rlike("|".join(names))  # noqa: E731  the names hold no signs of a pattern
    base = F.when(held(OUTLETS[0][1]), OUTLETS[0][0]).when(held(OUTLETS[1][1]), OUTLETS[1][0]).otherwise(0.3)
    named = F.least(F.lit(1.0), base + F.when(_present(low, NAMED_SOURCES) > 0, 0.1).otherwise(0.0))
    return F.least(F.lit(1.0), named + F.when(_present(low, INSTITUTIONS) > 0, 0.05).otherwise(0.0))


def quality_flags(clickbait: Column, felt: Column, density: Column, source: Column, deep: Column) -> Column:
    """What is doubtful about an article, by its scores."""
    flag = lambda cond, name: F.when(cond, F.lit(name))
    flags = (flag(clickbait >= 0.5, "clickbait_risk"), flag(felt >= 0.3, "high_emotion"), flag(density < 0.2, "low_fact_density"), flag(source < 0.5, "low_source_quality"), flag(deep < 0.2, "shallow"))
    return F.array_compact(F.array(*flags))


def recommendation(level: Column) -> Column:
    """What an article of a tier is good for."""
    return F.when(level == 1, "intelligence_grade").when(level == 2, "standard_reporting").when(level == 3, "aggregated_commentary").otherwise("low_value_demote")


def content_quality(title: Column, content: Column, source_quality: Column, clickbait: Column) -> Column:
    """(score, tier) of an article; a clickbait score of .8 puts it into the last tier."""
    return content_quality_of(fact_density(content), source_quality, depth(content), specificity(content), clickbait, emotion(title, content))


def content_quality_of(density: Column, source_quality: Column, deep: Column, specific: Column, clickbait: Column, felt: Column) -> Column:
    """The same by its parts."""
    parts = [(0.30, density), (0.25, source_quality), (0.20, deep), (0.15, specific), (0.05, 1.0 - clickbait), (0.05, 1.0 - felt)]
    score = clip(weighted(parts))
    level = F.when(clickbait >= 0.8, 4).otherwise(tier(score, ((0.8, 1), (0.6, 2), (0.4, 3)), 4))
    return F.struct(F.round(score, 4).alias("score"), level.cast("int").alias("tier"))


# fixed values: forms of citation of bills, in the order in which a text's bills are listed
BILLS = (
    (r"(?i)\bH\.?\s*J\.?\s*R\.?\s*[ .]*(\d+)\b", "hjres"),
    (r"(?i)(?:^|[\s\(\[,;])S\.?\s*J\.?\s*R\.?\s*[ .]*(\d+)\b", "sjres"),
    (r"(?i)\bH\.?\s*Con\.?\s*R\.?\s*[ .]*(\d+)\b", "hconres"),
    (r"(?i)(?:^|[\s\(\[,;])S\.?\s*Con\.?\s*R\.?\s*[ .]*(\d+)\b", "sconres"),
    (r"(?i)\bH\.?\s*R\.?\s*Res\.?\s*[ .]*(\d+)\b", "hres"),
    (r"(?i)(?:^|[\s\(\[,;])S\.?\s*Res\.?\s*[ .]*(\d+)\b", "sres"),
    (r"(?i)\bH\.?\s*R\.?\s*[ .]*(\d+)\b", "hr"),
    (r"(?i)(?:^|[\s\(\[,;])S\.\s*(\d+)\b", "s"),
)
LEAST_BILL_TEXT, LARGEST_BILL, CONGRESS = 20, 1_000_000, 118


def bill_mentions(text: Column, congress: int = CONGRESS) -> Column:
    """Distinct (congress, kind, number) of bills that a text names, form by form; the congress is the first one named, or the given one.

    Texts of fewer than 20 characters without the blanks around them, and numbers outside 1 to a million, name nothing.
    """
    whole = F.coalesce(text, F.lit(""))
    named = F.regexp_extract(whole, r"(?i)(\d{1,3})(?:st|nd|rd|th)\s+Congress", 1)
    # congress 0 counts as none
    of = F.coalesce(F.when((named != "") & (F.when(named != "", named).cast("int") > 0), F.when(named != "", named).cast("int")), F.lit(congress))

    def found(pattern: str, kind: str) -> Column:
        fits = F.filter(F.regexp_extract_all(whole, F.lit(pattern), F.lit(1)), lambda n: F.ltrim(n, F.lit("0")).rlike("^[0-9]{1,7}$"))
        numbers = F.transform(fits, lambda n: n.cast("decimal(38,0)").cast("int"))
        return F.transform(F.filter(numbers, lambda n: n.between(1, LARGEST_BILL)), lambda n: F.struct(of.alias("congress"), F.lit(kind).alias("kind"), n.alias("number")))

    every = F.array_distinct(F.concat(*(found(*form) for form in BILLS)))
    return F.when(F.length(F.trim(whole)) >= LEAST_BILL_TEXT, every).otherwise(F.filter(every, lambda _: F.lit(False)))


def topic_similarity(a: Column, b: Column) -> Column:
    """Names of topics: shared words, more for a shared word pair or containment."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0)))
    pairs = lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))
    wa, wb = words(a), words(b)
    shared = F.size(F.array_intersect(wa, wb))
    both = F.size(F.array_union(wa, wb))
    common = F.size(F.array_intersect(pairs(wa), pairs(wb)))
    inside = F.when((F.least(F.size(wa), F.size(wb)) > 0) & (shared / F.greatest(F.least(F.size(wa), F.size(wb)), F.lit(1)) >= 0.5), 0.3).otherwise(0.0)
    bonus = F.greatest(F.when(common > 0, 0.4).otherwise(0.0), inside)
    word = F.when(both > 0, shared / both).otherwise(0.0)
    return F.least(F.lit(1.0), word * (1 + bonus) + F.least(F.lit(1.0), common * 0.5))


def velocity(first: Column, last: Column, count: Column) -> Column:
    """Articles an hour between two times; at least an hour."""
    hours = F.greatest((F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / 3.6e9, F.lit(1.0))
    return count / hours


def alert_significance(count: Column, quality: Column, sources: Column, matched: Column) -> Column:
    part = lambda c, n: F.least(c / float(n), F.lit(1.0))
    return 0.3 * part(count, 10) + 0.3 * quality + 0.2 * part(sources, 5) + F.when(matched, 0.2).otherwise(0.0)


def storyline_similarity(semantic: Column, entity: Column, article: Column, title: Column) -> Column:
    """With vectors .50 .25 .15 .10, without .50 entities, .20 articles, .30 titles."""
    return F.when(semantic.isNotNull(), 0.50 * semantic + 0.25 * entity + 0.15 * article + 0.10 * title).otherwise(0.50 * entity + 0.20 * article + 0.30 * title)


def hybrid_similarity(cosine: Column, entity: Column, temporal: Column) -> Column:
    return clip(0.85 * (cosine + 1) / 2 + 0.10 * entity + 0.05 * temporal)
