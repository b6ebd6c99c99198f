"""Registered queries, third part: uploads, books and pages as a reader meets them, with their SQL."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions import html, scalars, text
from lorebase.functions.constants import FAILED_PAGE
from lorebase.operators import graph, rank, reports, store, uploads, words
from lorebase.sources import readers

from .corpus import RECORDS_SQL, records, table
from .queries import query

@query(
    "WITH c AS (SELECT event_type AS book, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS chapter, CAST(user_id AS VARCHAR) AS title, count(*) OVER (PARTITION BY event_type) AS total FROM events) "
    "SELECT book, chapter, CASE WHEN chapter < 9 THEN '0' ELSE '' END || (chapter + 1) AS ordinal, title, total, CASE WHEN chapter > 0 THEN chapter - 1 END AS prev, CASE WHEN chapter + 1 < total THEN chapter + 1 END AS next, "
    "chapter // 120 AS page, (total + 119) // 120 AS pages, chapter // 120 * 120 + 1 AS first, least((chapter // 120 + 1) * 120, total) AS last FROM c"
)
def chapter_navigation(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a kind as the chapters of a book: neighbours, and the pages of its list."""
    events = table(spark, sf, "events").select(F.col("event_type").alias("book"), "event_id", F.col("user_id").cast("string").alias("title"))
    # numbered by the running number of all events and that of the book's first one
    rows = graph.numbered(events, "k", F.col("book"), F.col("event_id"))
    first = rows.groupBy("book").agg(F.min("k").alias("first"))
    return text.chapter_navigation(rows.join(first, "book").select("book", (F.col("k") - F.col("first")).alias("chapter"), "title"), "book")


_MARK = f"\n{FAILED_PAGE} https://u.example/2.html]"


@query(f"SELECT doc_id AS path, length(text) + {len(_MARK)} AS chars FROM documents WHERE doc_id % 3 = 0")
def incomplete_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Saved texts of which pages are missing: every third one is given the mark of a failed page."""
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(_MARK))).otherwise(F.col("text"))
    found = readers.incomplete_files(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), marked.alias("text")))
    return found.select("path", F.length("text").cast("long").alias("chars"))


@F.pandas_udf(T.BinaryType())
def _epub(turns: pd.Series) -> pd.Series:
    """A book of the turns, one chapter each; the spine runs backwards through the files' names."""

    def one(chapters) -> bytes:
        box, n = io.BytesIO(), len(chapters)
        with zipfile.ZipFile(box, "w") as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="in/b.opf"/></rootfiles></container>')
            items = "".join(f'<item id="i{k}" href="c%20{n - k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(n))
            z.writestr("in/b.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref=\"i{k}\"/>' for k in range(n))}</spine></package>")
            for k, c in enumerate(chapters):
                body = "".join(f"<p>{escape(line)}</p>" for line in c["text"].split("\n"))
                z.writestr(f"in/c {n - k}.xhtml", f"<html><head><style>p {{}}</style></head><body><h1>{c['role']}</h1>{body}</body></html>")
        return box.getvalue()

    return turns.map(one)


@query(
    "WITH l AS (SELECT conv_id, turn, 0 AS i, role AS line FROM conversations UNION ALL SELECT conv_id, turn, unnest(range(1, len(string_split(text, chr(10))) + 1)), trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) FROM conversations) "
    "SELECT conv_id AS path, string_agg(line, repeat(chr(10), 2) ORDER BY turn, i) AS text FROM l WHERE line <> '' GROUP BY 1"
)
def epub_books(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as EPUB files, a turn a chapter, read back in the order of their spine."""
    books = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    found = readers.epub_texts(books.select(F.col("conv_id").cast("string").alias("path"), _epub("turns").alias("content")))
    return found.where("error is null").select(F.col("path").cast("long").alias("path"), "text")


@query(
    "WITH u AS (SELECT doc_id, concat(lang, '_', source) AS stem FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) + CASE WHEN ends_with(stem, '1') THEN 1 ELSE 0 END AS k FROM u) "
    "SELECT concat('upload:uploads/', stem, CASE WHEN k > 1 THEN concat('_', k) ELSE '' END, '.txt') AS url, 'uploads' AS category, concat('uploads/', stem, CASE WHEN k > 1 THEN concat('_', k) ELSE '' END, '.txt') AS file, 'full' AS source FROM n"
)
def saved_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Documents uploaded under the names of their language and source: names are numbered by arrival, some are taken."""
    d = table(spark, sf, "documents")
    name = F.concat("lang", F.lit("_"), "source")
    files = d.select(F.col("doc_id").alias("upload"), F.concat(F.lit("in/"), name, F.lit(".txt")).alias("filename"), F.encode("text", "UTF-8").alias("content"))
    taken = d.select(name.alias("stem")).where(F.endswith("stem", F.lit("1"))).distinct()
    return uploads.to_records(uploads.detect(files), taken).select("url", "category", "file", "source")


@query(f"WITH {RECORDS_SQL} SELECT row_id, CASE WHEN row_id % 3 = 0 THEN concat('raw/', row_id, '.txt') WHEN row_id % 5 > 0 AND file IS NOT NULL THEN concat(category, '/', row_id) END AS id FROM records")
def shelf_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Ids under which a shelf keeps titles: slugs of known records, raw paths as they are, none for unknown pages."""
    r = records(spark, sf)
    slug = F.when(F.col("file").isNotNull(), F.concat("category", F.lit("/"), F.col("row_id").cast("string")))
    raw = F.col("row_id") % 3 == 0
    url = F.when(raw, F.concat(F.lit("raw/"), F.col("row_id").cast("string"), F.lit(".txt"))).otherwise(F.col("url"))
    return r.select("row_id", scalars.shelf_id(url, F.when(~raw, slug), F.col("row_id") % 5 > 0).alias("id"))


@query(
    "WITH u AS (SELECT page_id, url, regexp_extract(url, '^([^:]*://[^/?#]*)', 1) AS origin, regexp_extract(url, '^[^:]*://([^/?#]*)', 1) AS host FROM pages) "
    "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') AND (host = 'example.com' OR ends_with(host, '.example.com')) THEN [concat(origin, '/fr/', page_id, '.html'), concat(origin, '/en/b/x', page_id, '.html')] ELSE [] END AS links FROM u"
)
def related_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Links of recommendation blocks that lead to titles of the same site: an index, another site, a category page and repeats do not."""
    i = F.col("page_id").cast("string")
    link = lambda *parts: F.concat(F.lit('<li><a href="'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit('">x</a>'))
    block = F.concat(F.lit('<div class="side related-box"><ul>'), link("/fr/", i, ".html"), link("/fr/index.html"), link("/fr/", i, "_2.html"), link("https://other.example.org/fr/1.html"), link("/en/"), link("/en/b/x", i, ".html"), link("/fr/", i, ".html"), F.lit("</ul></div>"))
    p = table(spark, sf, "pages").select("page_id", "url", F.concat("html", block).alias("html"))
    return p.select("page_id", html.related_udf("example.com", ("en", "fr"))("html", "url").alias("links"))


@query("SELECT o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS upload_date FROM orders WHERE o_orderstatus <> 'P' ORDER BY upload_date DESC, url DESC LIMIT 50")
def newest_worklist(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 newest live urls, newest first."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("url"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("upload_date"), F.when(F.col("o_orderstatus") == "P", "not_found").otherwise("ok").alias("fetch_status"))
    return store.worklist(store.pending(o, o.where("false")).drop("upload_date"), o, 50, forward=True).select("url", "upload_date")


@query(f"WITH {RECORDS_SQL} SELECT row_id, upload_date FROM records WHERE len(list_filter(tags, lambda t: contains(lower(t), 'olt'))) > 0 ORDER BY upload_date DESC, translate(title, 'o', 'z') DESC, row_id LIMIT 30")
def library_by_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Titles found by part of a tag alone: neither title nor author has it."""
    r = records(spark, sf).withColumn("author", F.lit("nobody")).withColumn("title", F.translate("title", "o", "z"))
    return rank.library_search(r, "OLT", 30).select("row_id", "upload_date")


# --- pages of a fixed shape, so that SQL can say what is read off them ---

_LINES_SQL = "l AS (SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS lines FROM conversations)"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as reading pages: the first line in a paragraph, the others between line breaks, and what belongs to no text."""
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(safe, "\n", -1)
    body = F.concat(F.lit("<p>"), F.get(lines, 0), F.lit("</p>"), F.array_join(F.slice(lines, 2, F.size(lines)), "<br>"))
    page = F.concat(F.lit('<html><body><p>before</p><article class="wide article-content">'), body, F.lit('<div class="pagination"><a>2</a></div><script>var p = "<p>";</script><p>传送门：<b>x</b></p></article><p>behind</p></body></html>'))
    return table(spark, sf, "conversations").select("conv_id", "turn", page.alias("html"))


@query(f"WITH {_LINES_SQL} SELECT conv_id, turn, array_to_string(list_filter(lines, lambda x: x <> ''), repeat(chr(10), 2)) AS text, len(lines) > 2 AS has_br, lines[1] AS old_text FROM l")
def reading_pages(spark: SparkSession, sf: str) -> DataFrame:
    """What both readings take from a page."""
    p = _pages(spark, sf).select("conv_id", "turn", html.page_text_udf()("html").alias("p"), html.old_text_udf()("html").alias("old_text"))
    return p.select("conv_id", "turn", "p.text", "p.has_br", "old_text")


@query(
    f"WITH {_LINES_SQL}, n AS (SELECT conv_id, length(regexp_replace(array_to_string(lines, ''), '\\s', '', 'g')) - length(regexp_replace(lines[1], '\\s', '', 'g')) AS lost FROM l) "
    "SELECT conv_id AS url, CAST(coalesce(sum(lost) FILTER (WHERE lost > 20), 0) AS BIGINT) AS lost, count(*) FILTER (WHERE lost > 20) AS pages_affected FROM n GROUP BY 1"
)
def page_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Characters that the paragraphs alone lose, over 20 a page."""
    both = _pages(spark, sf).select(F.col("conv_id").alias("url"), html.page_chars_udf()("html").alias("c")).select("url", "c.*")
    return reports.loss_audit(both, 20).select("url", F.col("lost").cast("long").alias("lost"), "pages_affected")


@query(
    f"WITH {RECORDS_SQL}, r AS (SELECT *, regexp_extract(url, '^(https://[^/]+)', 1) AS origin, regexp_replace(url, '[^/]+$', '') AS folder FROM records) "
    "SELECT row_id, title, author, status, upload_date, [folder || row_id || '_2.html', folder || row_id || '_3.html'] AS chapter_urls, CASE WHEN row_id > 0 THEN origin || '/' || category || '/x/' || (row_id - 1) || '.html' END AS prev_url, CASE WHEN row_id > 0 THEN 'before ' || title END AS prev_title, CAST(NULL AS VARCHAR) AS next_url FROM r"
)
def landing_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Heading, date, pages and neighbours of titles: a repeated page counts once, a neighbour elsewhere not at all."""
    i = F.col("row_id").cast("string")
    before = F.concat(F.lit('<span class="article-nav-prev"><a href="/'), F.col("category"), F.lit("/x/"), (F.col("row_id") - 1).cast("string"), F.lit('.html"> before '), "title", F.lit(" </a></span>"))
    pages = [F.concat(F.lit('<li class="mulu"><a href="'), i, F.lit(f'_{k}.html">{k}</a></li>')) for k in (2, 3, 2)]
    page = F.concat(
        F.lit('<h1>other</h1><h1 class="article-title"> '), "title", F.lit("_"), "author", F.lit("【"), "status", F.lit('】 </h1><time class="muted">'), "upload_date", F.lit('</time><ul class="list">'), *pages, F.lit('<li><a href="no.html">no</a></li></ul>'),
        F.lit('<nav class="article-nav">'), F.when(F.col("row_id") > 0, before).otherwise(""), F.lit('<span class="article-nav-next"><a href="https://other.example.org/a/b.html">next</a></span></nav>'),
    )
    m = records(spark, sf).select("row_id", html.landing_udf("books.example")(page, F.col("url")).alias("m"))
    head = scalars.parse_heading(F.col("m.h1"))
    return m.select("row_id", head.alias("h"), "m").select("row_id", "h.title", "h.author", "h.status", "m.upload_date", "m.chapter_urls", "m.prev_url", "m.prev_title", "m.next_url")


# --- words without spaces ---

_DICT_SQL = (
    "p AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), d AS (SELECT word, min({'price': price, 'reading': reading}) AS e FROM "
    "(SELECT w AS word, 10 AS price, upper(w) AS reading FROM p UNION ALL SELECT left(w, 3), 12, concat(left(w, 3), '.') FROM p UNION ALL SELECT right(w, 2), 11, NULL FROM p) WHERE word <> '' GROUP BY 1)"
)


@query(
    f"WITH RECURSIVE {_DICT_SQL}, t AS (SELECT DISTINCT replace(p_name, ' ', '') AS run FROM part), "
    "e AS (SELECT run, i, d.word, d.e.price AS price, d.e.reading AS reading FROM (SELECT run, unnest(range(length(run))) AS i FROM t) JOIN d ON substr(run, i + 1, length(d.word)) = d.word), "
    "s AS (SELECT run, i, word, price, reading FROM e UNION ALL SELECT run, unnest(range(length(run))) AS i, substr(run, unnest(range(length(run))) + 1, 1), 20, NULL FROM t), "
    "w AS (SELECT run, 0 AS pos, 0 AS cost, CAST([] AS STRUCT(start INTEGER, word VARCHAR, reading VARCHAR)[]) AS words, CAST([] AS INTEGER[]) AS sizes FROM t "
    "UNION ALL SELECT w.run, w.pos + length(s.word), w.cost + s.price, list_append(w.words, {'start': CAST(s.i AS INTEGER), 'word': s.word, 'reading': s.reading}), list_append(w.sizes, CAST(length(s.word) AS INTEGER)) FROM w JOIN s ON s.run = w.run AND s.i = w.pos), "
    "b AS (SELECT run, words, row_number() OVER (PARTITION BY run ORDER BY cost, len(words), list_reverse(sizes) DESC) AS k FROM w WHERE pos = length(run)), "
    "o AS (SELECT p_partkey, unnest(words) AS w FROM part JOIN b ON b.run = replace(p_name, ' ', '') AND k = 1) SELECT p_partkey, w.start AS start, w.word AS word, w.reading AS reading FROM o"
)
def word_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts without their spaces, cut into the words that names are made of, their beginnings and their ends."""
    p = table(spark, sf, "part")
    w = p.select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    entry = lambda word, price, reading: F.struct(word.alias("word"), F.lit(price).alias("price"), reading.alias("reading"))
    start = F.left("w", F.lit(3))
    entries = F.array(entry(F.col("w"), 10, F.upper("w")), entry(start, 12, F.concat(start, F.lit("."))), entry(F.right("w", F.lit(2)), 11, F.lit(None).cast("string")))
    dictionary = w.select(F.explode(entries).alias("e")).select("e.*")
    joined = p.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("name"))
    return words.segment(joined, dictionary, "p_partkey", "name").select("p_partkey", "start", "word", "reading")
