"""Predicates and pages: composable columns for eligibility, gates and search, and stable paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_term(text: Column, term: str) -> Column:
    """Case-blind substring test; wildcards in the term are dropped, and a blank term fits every non-null text."""
    plain = term.replace("%", "").replace("_", "").replace("\\", "").strip().lower()
    return F.contains(F.lower(text), F.lit(plain))


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any of the terms stands in the text, in one pass of an alternation."""
    low = F.lower(text)
    return F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(low, t)) if terms else F.lit(False)


def apply_filters(
    df: DataFrame,
    *,
    terms: dict[str, str] | None = None,
    equal: dict[str, object] | None = None,
    at_least: dict[str, object] | None = None,
    at_most: dict[str, object] | None = None,
    search: tuple[Sequence[str], str] | None = None,
    unlinked: tuple[DataFrame, str] | None = None,
    defaults: dict[str, object] | None = None,
) -> DataFrame:
    """The shared filter builder: every given condition narrows the rows.

    defaults fills nulls of a column before it is compared. unlinked keeps rows whose column isn't in the other table;
    nulls of that table are left out first, so it is a plain anti join.
    """
    value = lambda name: F.coalesce(F.col(name), F.lit(defaults[name])) if name in (defaults or {}) else F.col(name)
    for name, term in (terms or {}).items():
        df = df.where(contains_term(F.col(name), term))
    for name, v in (equal or {}).items():
        df = df.where(value(name) == F.lit(v))
    for name, v in (at_least or {}).items():
        df = df.where(value(name) >= F.lit(v))
    for name, v in (at_most or {}).items():
        df = df.where(value(name) <= F.lit(v))
    if search:
        cond = F.lit(False)
        for name in search[0]:
            cond = cond | F.coalesce(contains_term(F.col(name), search[1]), F.lit(False))
        df = df.where(cond)
    if unlinked:
        other, name = unlinked
        df = df.join(other.where(F.col(name).isNotNull()).select(name).distinct(), name, "left_anti")
    return df


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page. The order must end in a unique key; Spark then keeps offset + limit rows for each task only."""
    return df.orderBy(*order).offset(offset).limit(limit)


def ml_ready(content: Column, status: Column, created_at: Column, least: int, substantial: int, cutoff: str | None = None) -> Column:
    """Rows fit for model phases: long enough, and enriched, or of no status yet before the cutoff and substantial."""
    length = F.length(content)
    early = F.lit(True) if cutoff is None else (created_at.isNull() | (created_at < F.lit(cutoff).cast("timestamp")))
    return content.isNotNull() & (length > least) & F.coalesce((status == "enriched") | (early & status.isNull() & (length >= substantial)), F.lit(False))


def context_ready(content: Column, status: Column, least: int, substantial: int, strict: bool = False) -> Column:
    """Rows fit to become contexts: long enough and of a final status, or substantial when not strict."""
    length = F.length(content)
    final = F.coalesce(status.isin("enriched", "failed", "inaccessible"), F.lit(False))
    return content.isNotNull() & (length > least) & (final if strict else final | (length >= substantial))


def ingest_reject_reason(title: Column, content: Column, url: Column) -> Column:
    """Why a feed item is refused, or null: empty_title, then missing_url, then thin_item."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    thin = (F.length(blank(content)) < 20) & (F.length(blank(title)) < 10)
    return F.when(blank(title) == "", "empty_title").when(blank(url) == "", "missing_url").when(thin, "thin_item")


def quality_reject_reason(tier: Column, clickbait: Column, density: Column, most_tier: int = 3, most_clickbait: float = 0.8, least_density: float = 0.1) -> Column:
    """Why a row fails the quality gates, or null; a null value passes its gate."""
    fails = lambda c: F.coalesce(c, F.lit(False))
    return F.when(fails(tier > most_tier), "tier").when(fails(clickbait > most_clickbait), "clickbait").when(fails(density < least_density), "fact_density")


def final_score(relevance: Column, quality: Column) -> Column:
    return 0.7 * F.coalesce(relevance, F.lit(0.6)) + 0.3 * F.coalesce(quality, F.lit(0.5))


def not_flagged(metadata: Column, path: str, value: str = "true") -> Column:
    """JSON flag IS DISTINCT FROM value: a missing flag or document passes."""
    return ~F.get_json_object(metadata, path).eqNullSafe(F.lit(value))
