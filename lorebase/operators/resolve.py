"""Title resolution (V11, V12, O8, N10, N11): ranked tiers; the fuzzy tier compares only titles that can still win."""

from __future__ import annotations

import difflib
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Titles, by their bounds, whose ratios give the first limit.
FIRST = 64


def ratio_bound(title: Column, query: str) -> Column:
    """The most that difflib's ratio of title and query can be: both have so many characters in common, in whatever order."""
    left = lambda c: F.length(title) - F.length(F.replace(title, F.lit(c), F.lit("")))
    shared = sum((F.least(left(c), F.lit(n)) for c, n in Counter(query).items()), F.lit(0))
    whole = F.length(title) + len(query)
    return F.when(whole > 0, 2.0 * shared / whole).otherwise(1.0)


def close_ratio(query: str):
    """difflib's ratio of each title with the query."""

    @F.pandas_udf("double")
    def run(title: pd.Series) -> pd.Series:
        m = difflib.SequenceMatcher()
        m.set_seq2(query)

        def one(t: str) -> float:
            m.set_seq1(t)
            return m.ratio()

        return title.map(one)

    return run


def able(titles: DataFrame, query: str, n: int, cutoff: float) -> DataFrame:
    """titles(title, ...) that can be among the n closest, with their bounds.

    Of the FIRST titles by bound the n-th best ratio is a limit that no title below it by its bound can reach. Bounds are
    plain columns; ratios are computed for FIRST titles here.
    """
    bounded = titles.withColumn("title", F.coalesce("title", F.lit(""))).withColumn("bound", ratio_bound(F.col("title"), query)).where(F.col("bound") >= cutoff)
    first = bounded.orderBy(F.desc("bound"), F.desc("title")).limit(max(FIRST, 2 * n))
    best = first.select(close_ratio(query)("title").alias("ratio")).orderBy(F.desc("ratio")).limit(n).collect()  # n rows
    limit = max(cutoff, best[-1].ratio) if len(best) == n else cutoff
    return bounded.where(F.col("bound") >= limit - 1e-9)


def closest(titles: DataFrame, query: str, n: int, cutoff: float) -> DataFrame:
    """The n rows of titles(title, ...) of largest ratio, cutoff or more, ties by the later title; exactly."""
    return able(titles, query, n, cutoff).withColumn("ratio", close_ratio(query)("title")).where(F.col("ratio") >= cutoff).orderBy(F.desc("ratio"), F.desc("title")).limit(n).drop("bound")


def resolve_title(corpus: DataFrame, query: str) -> DataFrame:
    """At most one row: exact title, else the shortest that holds the query, else the closest (ratio 0.5 or more)."""
    q = query.strip().lower()
    low = F.lower("title")
    rows = corpus.where((low == q) | F.contains(low, F.lit(q)))
    best = rows.withColumn("tier", F.when(low == q, 0).otherwise(1)).orderBy("tier", F.when(F.col("tier") == 1, F.length("title")), "row_id").limit(1)
    if not best.isEmpty():
        return best.drop("tier")
    titles = closest(corpus.select("title").distinct(), query, 1, 0.5)
    return corpus.join(F.broadcast(titles.select("title")), "title", "left_semi").orderBy("row_id").limit(1)  # one title


def exact_titles(corpus: DataFrame, query: str) -> DataFrame:
    return corpus.where(F.lower("title") == query.strip().casefold())


def partial_titles(corpus: DataFrame, query: str, n: int = 20) -> DataFrame:
    """Candidates by (length, title, author)."""
    return corpus.where(F.contains(F.lower("title"), F.lit(query.strip().casefold()))).orderBy(F.length("title"), "title", "author", "row_id").limit(n)


def fuzzy_titles(corpus: DataFrame, query: str, n: int = 10, cutoff: float = 0.55) -> DataFrame:
    """Rows of the n closest titles, in row order."""
    titles = closest(corpus.select("title", "row_id"), query, n, cutoff)
    return corpus.join(F.broadcast(titles.select("title").distinct()), "title", "left_semi").orderBy("row_id")  # n titles


def resolve_target(corpus: DataFrame, target: str, is_landing=None, downloaded_only: bool = False) -> tuple[str | None, DataFrame | None]:
    """(url, None) for one hit, (None, candidates) for several, (None, None) for none."""
    target = target.strip()
    if target.startswith(("http://", "https://")):
        ok = is_landing is None or corpus.sparkSession.range(1).select(is_landing(F.lit(target)).alias("ok")).first().ok
        return (target if ok else None), None
    rows = corpus.where(F.col("file").isNotNull()) if downloaded_only else corpus
    for tier, limit in ((exact_titles(rows, target).orderBy("row_id"), None), (partial_titles(rows, target, 21), 20)):
        found = tier.select("url").limit(2).collect()
        if len(found) == 1:
            return found[0].url, None
        if found:
            return None, tier if limit is None else tier.limit(limit)
    fuzzy = fuzzy_titles(rows, target)
    return None, (None if fuzzy.isEmpty() else fuzzy)


def slug_index(records: DataFrame) -> DataFrame:
    """(slug, url): of equal slugs the first in load order."""
    return records.where("slug is not null").groupBy("slug").agg(F.min_by("url", "load_order").alias("url"))


def resolve_ids(ids: DataFrame, slugs: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, url, kind) by slug, slug without extension, raw path, then base64url id."""
    from lorebase.functions.urls import nid_decode

    by = lambda c, alias: slugs.select(F.col("slug").alias(c), F.col("url").alias(alias))
    out = ids.withColumn("bare", F.regexp_replace("id", r"\.[^./]*$", "")).join(by("id", "u0"), "id", "left").join(by("bare", "u1"), "bare", "left")
    out = out.join(paths.select(F.col("path").alias("id"), F.col("path").alias("u2")), "id", "left")
    decoded = F.when(F.regexp("id", F.lit("^[A-Za-z0-9_-]+$")) & (F.length("id") % 4 != 1), nid_decode(F.col("id")))
    u3 = F.when(F.regexp(decoded, F.lit("^https?://")), decoded)
    kind = F.when(F.col("u0").isNotNull(), "slug").when(F.col("u1").isNotNull(), "slug").when(F.col("u2").isNotNull(), "path").when(u3.isNotNull(), "nid")
    return out.select("id", F.coalesce("u0", "u1", "u2", u3).alias("url"), kind.alias("kind"))


def describe_ids(ids: DataFrame, slugs: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """(id, url, title, kind, language) of the shelf ids that can be described: records, raw text files, other documents.

    records(url, title, language); files(path, title, language) with a kind as readers.classify gives it.
    """
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    found = resolve_ids(ids, slugs, files.where("kind = 'text'").select("path")).where("kind in ('slug', 'path')").select("id", F.col("url").alias("found"), "kind")
    novels = records.select(F.col("url").alias("found"), F.col("title").alias("t"), F.col("language").alias("l"))
    texts = files.where("kind = 'text'").select(F.col("path").alias("found"), F.coalesce("title", stem).alias("t"), F.col("language").alias("l"))
    named = found.join(novels.unionByName(texts), "found", "left").select("id", F.col("found").alias("url"), F.col("t").alias("title"), F.when(F.col("kind") == "slug", "novel").otherwise("text").alias("kind"), F.col("l").alias("language"))
    docs = ids.join(files.where("kind = 'doc'").select(F.col("path").alias("id"), stem.alias("title")), "id").join(named.select("id"), "id", "left_anti")
    return named.unionByName(docs.select("id", F.col("id").alias("url"), "title", F.lit("doc").alias("kind"), F.lit("").alias("language")))
