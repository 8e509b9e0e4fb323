"""Text as columns: cleaning, hashes, tokens, n-grams and similarities. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D ]+"


def words(text: Column) -> Column:
    """White-space separated words; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalise_for_hash(text: Column) -> Column:
    """Lower case, tags out, white space collapsed, quotes, dashes and ellipses made plain, no space before marks."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "<[^>]*>", "")
    plain = F.translate(plain, "‘’“”–—", "''\"\"--")
    plain = F.regexp_replace(plain, "…", "...")
    return F.regexp_replace(collapse(plain), r"\x20+([.,;:!?])", "$1")


def content_hash(title: Column, content: Column) -> Column:
    """SHA-256 of the normalised title and content, joined by a bar."""
    return F.sha2(F.concat_ws("|", normalise_for_hash(title), normalise_for_hash(content)), 256)


def normalise_url(url: Column, tracking: Sequence[str] = ("utm_", "fbclid", "gclid", "ref")) -> Column:
    """The URL in lower case, without fragment and without parameters whose text holds a tracking mark."""
    bare = F.regexp_replace(F.lower(url), "#.*$", "")
    parts = F.split(bare, "\\?", 2)
    query = F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("|".join(tracking)))
    return F.concat(F.element_at(parts, 1), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def strip_html(html: Column) -> Column:
    """Visible text of HTML: scripts and styles, tags, entities, addresses and mails left out, white space collapsed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    out = F.regexp_replace(out, r"https?://[^\x20\x09-\x0D]+|www\.[^\x20\x09-\x0D]+", " ")
    out = F.regexp_replace(out, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", " ")
    return collapse(F.regexp_replace(out, r"&[A-Za-z]+;|&#[0-9]+;", " "))


def clean_text(text: Column) -> Column:
    """Tags out, runs of three or more blanks to one, no-break spaces and curly apostrophes made plain, trimmed."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    out = F.regexp_replace(out, r"[\x20\x09-\x0D]{3,}", " ")
    return F.trim(F.translate(out, " ’", " '"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, zero where b is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 when both are empty."""
    return ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    """Twice the shared over the summed distinct elements."""
    shared = F.size(F.array_intersect(a, b))
    return ratio(2.0 * shared, F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def grams(text: Column, n: int) -> Column:
    """Distinct character n-grams; shorter texts have none."""
    last = F.length(text) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-case words, each with two blanks before and one after."""
    word = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(word, lambda w: grams(F.concat(F.lit("  "), w, F.lit(" ")), 3))))


def word_grams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by blanks, repeats kept."""
    last = F.size(tokens) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


# fixed values: words that carry no topic
STOP_WORDS = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "been", "but", "by", "can", "could", "did", "do", "does",
    "for", "from", "had", "has", "have", "he", "her", "his", "how", "i", "if", "in", "into", "is", "it", "its", "may", "more", "most", "not",
    "of", "on", "or", "other", "our", "out", "over", "said", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them",
    "then", "there", "these", "they", "this", "those", "to", "up", "was", "we", "were", "what", "when", "where", "which", "who", "will", "with",
    "would", "you", "your",
)


def keywords(text: Column, least: int = 3, most: int | None = 10, distinct: bool = False) -> Column:
    """Lower-case runs of Latin letters of some length that are no stop words, in order; the first few only if asked."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0))
    kept = F.filter(found, lambda w: ~w.isin(*STOP_WORDS))  # looked up in a set
    kept = F.array_distinct(kept) if distinct else kept
    return kept if most is None else F.slice(kept, 1, most)


def capitalised_runs(text: Column) -> Column:
    """Runs of capitalised words as lower-case names, distinct and sorted; the first word of a sentence counts too."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?:\x20[A-Z][a-z]+)*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.lower), lambda w: ~w.isin(*STOP_WORDS))))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, by what its removal leaves."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def whole_word(text: Column, term: str) -> Column:
    """Whether a term stands between characters that are no letters or digits."""
    return F.lower(text).rlike(rf"(?<![a-z0-9])\Q{term.lower()}\E(?![a-z0-9])")


# fixed values: titles before and legal forms after a name
TITLES = r"(?i)^(mr|mrs|ms|dr|prof|president|senator|sen|rep|gov|governor|judge|justice|minister|general|gen|sir)\.?\x20+"
LEGAL_FORMS = r"(?i),?\x20+(inc|corp|corporation|ltd|llc|plc|co|company|group|holdings)\.?$"


def normalise_name(name: Column, kind: Column) -> Column:
    """Titles cut from persons and legal forms from organisations, white space collapsed."""
    plain = F.trim(name)
    plain = F.when(kind == "person", F.regexp_replace(plain, TITLES, "")).when(kind == "organization", F.regexp_replace(plain, LEGAL_FORMS, "")).otherwise(plain)
    return collapse(plain)


def last_name(name: Column, roles: Sequence[str] = ("officials", "spokesman", "minister", "president", "police", "agency")) -> Column:
    """The last of at least two words, unless it is a role; null otherwise."""
    parts = words(F.trim(name))
    last = F.element_at(parts, -1)
    bare = F.regexp_replace(F.lower(last), "['s]+$", "")
    return F.when((F.size(parts) >= 2) & ~bare.isin(*[r.rstrip("s") for r in roles]), last)


def event_fingerprint(kind: Column, actors: Column, place: Column, date: Column) -> Column:
    """SHA-256 of type, sorted actors, place and date, missing ones as unknown."""
    names = F.array_join(F.array_sort(F.transform(actors, lambda a: F.lower(F.trim(a)))), "|")
    return F.sha2(F.concat_ws("::", F.lower(kind), names, F.coalesce(F.lower(place), F.lit("unknown")), F.coalesce(date.cast("string"), F.lit("unknown"))), 256)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when one has no length."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
