"""URL and identifier functions (P7-P16, P21, P22, P38, P40, P43) as columns; RFC 3986 joining is the one UDF."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .constants import BASE62


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def path_of(url: Column) -> Column:
    """Path of a URL, also where a URI parser would refuse the rest."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def category_of(url: Column, fallback: str | None = None) -> Column:
    segs = segments(url)
    return F.when(F.size(segs) > 0, F.element_at(segs, 1)).otherwise(F.lit(fallback))


def url_parts(url: Column) -> Column:
    """struct<category, shard, id>; a shard only with three segments or more, the id without .html."""
    segs, n = segments(url), F.size(segments(url))
    last = F.when(n > 0, F.regexp_replace(F.element_at(segs, -1), r"\.html$", ""))
    return F.struct(F.coalesce(category_of(url), F.lit("")).alias("category"), F.when(n >= 3, F.element_at(segs, 2)).otherwise("").alias("shard"), F.coalesce(last, F.lit("")).alias("id"))


def host_of(url: Column) -> Column:
    """Host without user information and port, in lower case."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":.*$", ""))


def same_site(url: Column, site: str) -> Column:
    host = host_of(url)
    return (host == site) | F.endswith(host, F.lit("." + site))


def is_landing(url: Column, site: str, categories: list[str]) -> Column:
    segs = segments(url)
    name = F.regexp_extract(F.element_at(segs, -1), r"^(.*)\.html$", 1)
    ok = F.regexp(url, F.lit("^https?://")) & same_site(url, site) & (F.size(segs) >= 2)
    ok = ok & F.element_at(segs, 1).isin(*categories) & (name != "") & ~F.startswith(name, F.lit("index")) & ~F.regexp(name, F.lit(r"_\d+$"))
    return F.coalesce(F.when(F.size(segs) >= 2, ok), F.lit(False))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), where the value is worked out once for all its uses; `of` takes all columns it needs from the value."""
    return F.get(F.transform(F.array(value), of), 0)


def page_url_ok(landing: Column, page: Column, site: str) -> Column:
    """A reading page extends the landing page's stem by _N; without a stem there is nothing to check."""
    return _once(F.struct(path_of(landing).alias("path"), page.alias("page")), lambda x: _page_path_ok(x["path"], x["page"], site))


def _page_path_ok(landing: Column, page: Column, site: str) -> Column:
    stem, end = F.regexp_extract(landing, r"^(.*)\.html$", 1), F.lit(".html")
    there = _once(path_of(page), lambda path: F.startswith(path, stem) & F.regexp(F.substring(path, F.length(stem) + 1, F.length(path)), F.lit(r"^_\d+\.html$")))
    return ~F.endswith(landing, end) | (same_site(page, site) & there)


def page_urls_valid(landing: Column, pages: Column, site: str) -> Column:
    return _once(F.struct(path_of(landing).alias("path"), pages.alias("pages")), lambda x: F.forall(x["pages"], lambda p: _page_path_ok(x["path"], p, site)))


def base62_decode(s: Column) -> Column:
    """Number of a base-62 id; null where a character is no digit."""
    digits = lambda x: F.transform(F.split(x, ""), lambda c: F.call_function("instr", F.lit(BASE62), c).cast("long") - 1)
    return _once(s, lambda x: F.when(F.regexp(x, F.lit("^[0-9A-Za-z]+$")), F.aggregate(digits(x), F.lit(0).cast("long"), lambda a, d: a * 62 + d)))


def base62_encode(n: Column, width: Column | int) -> Column:
    """Base-62 digits, padded with 0 to the width and never cut."""
    zero = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.floor(a["n"] / 62).cast("long").alias("n"), F.concat(F.substring(F.lit(BASE62), F.pmod(a["n"], F.lit(62)).cast("int") + 1, F.lit(1)), a["s"]).alias("s"))).otherwise(a)
    digits = F.aggregate(F.sequence(F.lit(1), F.lit(11)), zero, step, lambda a: F.when(a["s"] == "", "0").otherwise(a["s"]))
    return _once(F.struct(digits.alias("s"), _lit(width).alias("width")), lambda d: F.lpad(d["s"], F.greatest(F.length(d["s"]), d["width"]), F.lit("0")))


def step_url_id(url: Column, delta: Column | int) -> Column:
    """The URL whose id lies delta further, of the same width; null without an id or below zero."""
    part = lambda n: F.regexp_extract(url, r"^(.*/)([0-9A-Za-z]+)\.html$", n)
    at = F.struct(part(1).alias("stem"), part(2).alias("id"), (base62_decode(part(2)) + _lit(delta)).alias("n"))
    return _once(at, lambda x: F.when((x["id"] != "") & (x["n"] >= 0), F.concat(x["stem"], base62_encode(x["n"], F.length(x["id"])), F.lit(".html"))))


def url_id(url: Column) -> Column:
    """struct<category, shard, id, id_num, parse_error> of a landing URL."""
    known = lambda p: F.struct(p["category"].alias("category"), p["shard"].alias("shard"), p["id"].alias("id"), base62_decode(p["id"]).alias("id_num"))
    return _once(_once(url_parts(url), known), lambda p: F.struct(*[p[c].alias(c) for c in ("category", "shard", "id", "id_num")], p["id_num"].isNull().alias("parse_error")))


def nid_encode(url: Column) -> Column:
    """Base64url without padding."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode(url, "UTF-8")), r"\s", ""), "+/", "-_"), "=+$", "")


def nid_decode(nid: Column) -> Column:
    padded = F.rpad(nid, (F.ceil(F.length(nid) / 4) * 4).cast("int"), F.lit("="))
    return F.decode(F.unbase64(F.translate(padded, "-_", "+/")), "UTF-8")


def slug_of(category: Column, file: Column) -> Column:
    return F.when(file.isNotNull(), F.concat_ws("/", category, F.regexp_extract(file, r"([^/]*?)(?:\.[^./]*)?$", 1)))


def local_path(file: Column, root: str) -> Column:
    return F.when(F.startswith(file, F.lit("/")), file).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), file))


def page_urls(landing: Column, n: Column) -> Column:
    """URLs of the pages 2 to n + 1 of a landing page."""
    stem = F.regexp_replace(landing, r"\.html$", "")
    return F.when(n >= 1, F.transform(F.sequence(F.lit(2), (n + 1).cast("int")), lambda i: F.concat(stem, F.lit("_"), i.cast("string"), F.lit(".html")))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def absolute_url(href: pd.Series, base: pd.Series) -> pd.Series:
    """RFC 3986 reference resolution; Spark has no function for it."""
    return pd.Series([None if h is None or b is None else h if h.startswith("http") else urljoin(b, h) for h, b in zip(href, base, strict=True)], dtype=object)
