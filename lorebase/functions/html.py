"""HTML extraction (T3-T5, T28, A13) with the standard library's tolerant parser, as Arrow UDFs.

A page is turned into a small tree once; void elements never open, a <p> closes an open <p>, list items close each
other, and unknown end tags are ignored, so unclosed paragraphs nest no deeper than browsers let them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import functions as F

from . import constants as K

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "option": {"option"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(k for k in reversed(e.kids) if isinstance(k, Element))

    def find(self, tag: str | None = None, cls: str | None = None, id_: str | None = None) -> Iterator[Element]:
        for e in self.walk():
            if e is not self and (tag is None or e.tag == tag) and (cls is None or cls in e.attrs.get("class", "").split()) and (id_ is None or e.attrs.get("id") == id_):
                yield e

    def first(self, **by) -> Element | None:
        return next(self.find(**by), None)

    def text(self, on: Callable[[Element], tuple[str, str] | None] = lambda e: ("", "")) -> str:
        """Text below; on(element) gives what stands before and after it, or None to skip it."""
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                out.append(e)
            elif (around := on(e)) is not None:
                stack.append(around[1])
                stack.extend(reversed(e.kids))
                out.append(around[0])
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag in closes:
                del self.open[at:]
                break
            if self.open[at].tag in ("ul", "ol", "table", "div", "article", "section", "nav", "button"):
                break
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].kids.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def parse(html: str | None) -> Element:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def _article(root: Element) -> Element | None:
    return root.first(tag="article", cls="article-content") or root.first(id_="nr1") or None


def reading_page(html: str | None, ads: tuple[str, ...], article: Callable[[Element], Element | None] = _article) -> tuple[str, bool]:
    """(paragraphs joined by blank lines, whether <br> breaks lines) of a reading page."""
    return _reading(article(parse(html)), ads)


def _reading(body: Element | None, ads: tuple[str, ...]) -> tuple[str, bool]:
    if body is None:
        return "", False
    ad = lambda s: any(m in s for m in ads)
    chrome = lambda e: e.tag in ("script", "style", "button") or "paginat" in e.attrs.get("class", "") or "go_top" in e.attrs.get("class", "").split()
    breaks = False

    def around(e: Element) -> tuple[str, str] | None:
        nonlocal breaks
        if e is not body and (chrome(e) or e.tag == "p" and ad(e.text(lambda x: None if chrome(x) else ("", "")))):
            return None
        breaks = breaks or e.tag == "br"
        return ("\n", "") if e.tag == "br" else ("", "\n") if e.tag == "p" else ("", "")

    lines = (x.strip() for x in body.text(around).split("\n"))
    return "\n\n".join(x for x in lines if x and not ad(x)), breaks


def paragraphs_only(html: str | None, ads: tuple[str, ...], article=_article) -> str:
    """The older reading of a page: its <p> elements alone."""
    return _paragraphs(article(parse(html)), ads)


def _paragraphs(body: Element | None, ads: tuple[str, ...]) -> str:
    texts = (p.text().strip() for p in body.find(tag="p")) if body else ()
    return "\n\n".join(t for t in texts if t and not any(m in t for m in ads))


def page_chars(html: str | None, ads: tuple[str, ...], article=_article) -> tuple[int, int]:
    """Characters but spaces (scalars.nonspace_chars) of a page's text, and of its paragraphs alone; it is parsed once."""
    body = article(parse(html))
    chars = lambda t: sum(map(len, t.split()))
    return chars(_reading(body, ads)[0]), chars(_paragraphs(body, ads))


def any_article(root: Element) -> Element | None:
    return _article(root) or root.first(tag="article")


def _same_site(url: str, site: str) -> bool:
    host = urlparse(url).netloc.lower().rpartition("@")[2].partition(":")[0]
    return host == site or host.endswith("." + site)


def _landing(url: str, site: str, categories: tuple[str, ...]) -> bool:
    u = urlparse(url)
    segs = [s for s in u.path.split("/") if s]
    name = segs[-1].removesuffix(".html") if segs and segs[-1].endswith(".html") else ""
    return u.scheme in ("http", "https") and _same_site(url, site) and len(segs) > 1 and segs[0] in categories and bool(name) and not name.startswith("index") and not re.search(r"_\d+$", name)


def _absolute(href: str, base: str) -> str:
    return href if href.startswith("http") else urljoin(base, href)


def _tight(e: Element | None) -> str:
    """Text of the parts, each stripped, joined without space."""
    parts = []
    if e is not None:
        stack = [e]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x.strip())
            else:
                stack.extend(reversed(x.kids))
    return "".join(parts)


def landing_page(html: str | None, url: str, site: str, heading: str | None = "article-title") -> dict:
    """Heading, date, ordered distinct page links, and neighbours of the same category."""
    root = parse(html)
    links: dict[str, None] = {}
    for ul in root.find(tag="ul", cls="list"):
        for li in ul.find(tag="li", cls="mulu"):
            links |= {_absolute(a.attrs["href"], url): None for a in li.find(tag="a") if a.attrs.get("href")}
    out = {"h1": _tight(root.first(tag="h1", cls=heading)), "upload_date": _tight(root.first(tag="time", cls="muted")), "chapter_urls": list(links)}
    segs = [s for s in urlparse(url).path.split("/") if s]
    nav = root.first(tag="nav", cls="article-nav")
    for side in ("prev", "next"):
        span = nav.first(tag="span", cls=f"article-nav-{side}") if nav else None
        a = span.first(tag="a") if span else None
        target = _absolute(a.attrs["href"], url) if a is not None and a.attrs.get("href") else None
        ok = target is not None and _landing(target, site, tuple(segs[:1]))
        out[f"{side}_url"], out[f"{side}_title"] = (target, _tight(a)) if ok else (None, None)
    return out


def related_links(html: str | None, url: str, site: str, categories: tuple[str, ...], block: str = "related") -> list[str]:
    """Ordered distinct landing pages in blocks whose class holds the given word."""
    found: dict[str, None] = {}
    for e in parse(html).walk():
        if block in e.attrs.get("class", ""):
            found |= {u: None for a in e.find(tag="a") if a.attrs.get("href") and _landing(u := _absolute(a.attrs["href"], url), site, categories)}
    return list(found)


#: Fixed value: results that are held as Python objects.
HELD = 256


def _by_page(ddl: str, kind: pa.DataType, read: Callable):
    """read over the pages of a batch. The batch stays in Arrow; one page at a time and a few results are Python objects."""

    @F.arrow_udf(ddl)
    def run(*columns: pa.Array) -> pa.Array:
        done = []
        for at in range(0, len(columns[0]), HELD):
            rows = zip(*(c.slice(at, HELD) for c in columns), strict=True)
            done.append(pa.array([read(*(v.as_py() for v in row)) for row in rows], kind))
        return pa.concat_arrays(done) if done else pa.array([], kind)

    return run


def page_text_udf(ads: tuple[str, ...] = K.AD_MARKERS, any_page: bool = False):
    """struct<text, has_br> of reading pages; any_page also takes an <article> of any class."""
    article = any_article if any_page else _article
    kind = pa.struct([("text", pa.string()), ("has_br", pa.bool_())])
    return _by_page("text string, has_br boolean", kind, lambda h: dict(zip(("text", "has_br"), reading_page(h, ads, article), strict=True)))


def old_text_udf(ads: tuple[str, ...] = K.AD_MARKERS, any_page: bool = False):
    article = any_article if any_page else _article
    return _by_page("string", pa.string(), lambda h: paragraphs_only(h, ads, article))


def page_chars_udf(ads: tuple[str, ...] = K.AD_MARKERS, any_page: bool = False):
    """struct<new_chars, old_chars> of both readings; no text leaves the worker."""
    article = any_article if any_page else _article
    kind = pa.struct([("new_chars", pa.int64()), ("old_chars", pa.int64())])
    return _by_page("new_chars long, old_chars long", kind, lambda h: dict(zip(("new_chars", "old_chars"), page_chars(h, ads, article), strict=True)))


def landing_udf(site: str, heading: str | None = "article-title"):
    names = ("h1", "upload_date", "chapter_urls", "prev_url", "prev_title", "next_url", "next_title")
    kind = pa.struct([(n, pa.list_(pa.string()) if n == "chapter_urls" else pa.string()) for n in names])
    ddl = "h1 string, upload_date string, chapter_urls array<string>, prev_url string, prev_title string, next_url string, next_title string"
    return _by_page(ddl, kind, lambda h, u: landing_page(h, u or "", site, heading))


def related_udf(site: str, categories: tuple[str, ...], block: str = "related"):
    return _by_page("array<string>", pa.list_(pa.string()), lambda h, u: related_links(h, u or "", site, categories, block))
