"""Filters (F1-F8, F11-F13, F17, F18) compiled to one predicate; a null length or year fails its range."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.functions.scalars import length_of, year_of


@dataclass(frozen=True)
class Filters:
    status: str | None = None
    categories: frozenset[str] = frozenset()
    min_chapters: int | None = None
    max_chapters: int | None = None
    year_from: int | None = None
    year_to: int | None = None
    exclude_authors: frozenset[str] = frozenset()
    require_tags: frozenset[str] = frozenset()

    def active(self) -> bool:
        """Whether any bound is set; 0 counts as unset here."""
        return any(bool(v) for v in vars(self).values())

    def predicate(self) -> Column:
        length, year = length_of(F.col("chapter_count"), F.col("page_count")), year_of(F.col("year_month"))
        terms = [
            (F.col("status") == self.status) if self.status else None,
            F.col("category").isin(*sorted(self.categories)) if self.categories else None,
            (length >= self.min_chapters) if self.min_chapters is not None else None,
            (length <= self.max_chapters) if self.max_chapters is not None else None,
            (year >= self.year_from) if self.year_from is not None else None,
            (year <= self.year_to) if self.year_to is not None else None,
            ~F.col("author").isin(*sorted(self.exclude_authors)) if self.exclude_authors else None,
            has_all_tags(self.require_tags) if self.require_tags else None,
        ]
        out = F.lit(True)
        for t in terms:
            out = out if t is None else out & t
        return out


def has_all_tags(tags) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, sorted(tags))), F.col("tags"))) == 0


def displayable() -> Column:
    return (F.col("synopsis") != "") & (F.size("tags") > 0)


def matches_text(query: str) -> Column:
    """Case-insensitive part of title, author or any tag."""
    q = F.lit(query.casefold())
    return F.contains(F.lower("title"), q) | F.contains(F.lower("author"), q) | F.exists("tags", lambda t: F.contains(F.lower(t), q))


def known_node(fetch_status: Column, has_meta: Column, in_store: Column, refresh: bool = False) -> Column:
    """Nodes that a crawl expands without fetching: dead ones, and live ones whose record is held."""
    return F.lit(False) if refresh else (fetch_status == "not_found") | ((fetch_status == "ok") & has_meta & in_store)


def parse_year_range(text: str) -> tuple[int | None, int | None]:
    """Y, Y.., ..Y or A..B."""
    low, dots, high = text.strip().partition("..")
    year = lambda s: int(s) if s.strip() else None
    return (year(low), year(high)) if dots else (year(low), year(low))


def parse_list(text: str | None) -> frozenset[str]:
    return frozenset(x for part in (text or "").split(",") if (x := part.strip()))


def parse_categories(args: list[str], known: list[str]) -> list[str]:
    """Comma lists flattened in order, `all` for every known one; unknown names are refused."""
    names = list(dict.fromkeys(x for a in args for part in a.split(",") if (x := part.strip())))
    if "all" in names:
        return list(known)
    if bad := [n for n in names if n not in known]:
        raise ValueError(f"unknown categories: {', '.join(bad)}")
    return names


def filters_from_args(status=None, category=None, min_chapters=None, max_chapters=None, year=None, exclude_author=None, tags=None) -> Filters:
    low, high = parse_year_range(year) if year else (None, None)
    return Filters(status, parse_list(category), min_chapters, max_chapters, low, high, parse_list(exclude_author), parse_list(tags))
