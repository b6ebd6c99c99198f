"""Scalar columns over records, files and responses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

#: Python's idea of white space for Java patterns: (?U) makes \s cover U+3000 and NBSP.
SPACE = r"(?U)[\s\u001c-\u001f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def blank_to_default(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# --- records ---


def embed_text(title: Column, tags: Column, one_liner: Column, synopsis: Column, excerpt: Column) -> Column:
    """The text that is embedded: non-empty parts, one a line."""
    parts = F.array(title, F.array_join(tags, " "), one_liner, synopsis, F.left(excerpt, F.lit(K.EXCERPT_CHARS)))
    return F.array_join(F.filter(F.transform(parts, blank_to_default), lambda x: x != ""), "\n")


def content_hash(text: Column) -> Column:
    return F.sha1(F.encode(text, "UTF-8"))


def downloaded(file: Column) -> Column:
    return file.isNotNull()


def year_of(year_month: Column) -> Column:
    return F.when(F.regexp(year_month, F.lit(r"^\d{4}")), F.substring(year_month, 1, 4).try_cast("int"))


def length_of(chapter_count: Column, page_count: Column) -> Column:
    return F.coalesce(chapter_count, page_count)


def year_month(upload_date: Column, folder: Column | None = None) -> Column:
    """YYYY-MM of the folder if it is named so, else of the date, else empty."""
    y, m = (F.regexp_extract(upload_date, K.DATE_YM, i) for i in (1, 2))
    from_date = F.when(y != "", F.concat_ws("-", y, m)).otherwise("")
    return from_date if folder is None else F.when(F.regexp(folder, F.lit(r"^\d{4}-\d{2}$")), folder).otherwise(from_date)


def parse_heading(h1: Column) -> Column:
    """struct<title, author, status> of 'title_author【status】'."""
    text = strip(h1)
    status = F.regexp_extract(text, "【([^】]*)】", 1)
    head = F.when(F.regexp(text, F.lit("【[^】]*】")), strip(F.regexp_replace(text, "(?s)【[^】]*】.*$", ""))).otherwise(text)
    parts = F.split(head, "_", 2)
    return F.struct(strip(parts[0]).alias("title"), F.when(F.size(parts) > 1, strip(F.get(parts, 1))).otherwise("").alias("author"), status.alias("status"))


def title_to_filename(title: Column, author: Column, status: Column) -> Column:
    named = F.array_join(F.concat(F.array(title), F.filter(F.array(author, status), lambda x: F.coalesce(x, F.lit("")) != "")), "_")
    cleaned = strip(F.regexp_replace(named, K.FS_UNSAFE, ""))
    return F.concat(F.left(F.regexp_replace(cleaned, rf"{SPACE}+", "_"), F.lit(200)), F.lit(".txt"))


def month_folder(upload_date: Column) -> Column:
    found = year_month(upload_date)
    return F.when(found != "", found).otherwise("unknown")


def nonspace_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACE, ""))


def result_similarity(cosine: Column) -> Column:
    """Percent from 0 to 100, ties to even."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(cosine * 100).cast("int")))


def result_row(row_tags: Column, synopsis: Column, cosine: Column) -> Column:
    """struct<tags, synopsis, cosine, similarity> as a caller sees them."""
    return F.struct(F.slice(row_tags, 1, 8).alias("tags"), F.left(synopsis, F.lit(260)).alias("synopsis"), F.bround(cosine, 4).alias("cosine"), result_similarity(cosine).alias("similarity"))


def snippet(synopsis: Column, n: int) -> Column:
    return F.translate(F.left(synopsis, F.lit(n)), "\n", " ")


def result_line(rank: Column, source: Column, title: Column, author: Column, status: Column, synopsis: Column, cosine: Column) -> Column:
    """One line of a listing: rank, percent, whether only metadata is held, names and a snippet."""
    badge = F.when(source == "full", "full").otherwise("meta")
    return F.concat_ws(" ", F.format_string("%2d.", rank), F.format_string("%3d%%", result_similarity(cosine)), F.concat(F.lit("["), badge, F.lit("]")), title, author, status, snippet(synopsis, 110))


def _scaled(value: Column, units: tuple[str, ...], first: int, rest: int, grouped: bool) -> Column:
    value, out = value.cast("double"), None
    for i, unit in reversed(list(enumerate(units))):
        shown = F.format_string(f"%{',' if grouped else ''}.{rest if i else first}f {unit}", F.bround(value / 1024.0**i, rest if i else first))
        out = shown if out is None else F.when(value < 1024.0 ** (i + 1), shown).otherwise(out)
    return out


def human_size(n: Column) -> Column:
    """Report style: bytes without decimals, larger units with one."""
    return _scaled(n, ("B", "KB", "MB", "GB", "TB"), 0, 1, True)


def watch_size(n: Column) -> Column:
    """Watcher style: larger units with two decimals."""
    return _scaled(n, ("B", "KB", "MB", "GB", "TB"), 0, 2, True)


def kb_size(kb: Column) -> Column:
    """From kilobytes: KB with one decimal, MB and GB with two."""
    return _scaled(kb, ("KB", "MB", "GB"), 1, 2, False)


def progress_percent(position: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.least(F.lit(100), F.floor((position + 1) / total * 100 + 0.5).cast("int"))).otherwise(0)


def map_percent(x: Column) -> Column:
    """A coordinate of [-1, 1] on an axis from 5 to 95 percent."""
    return (x + 1) / 2 * 90 + 5


def reading_state(position: Column, total: Column) -> Column:
    return F.when(position >= total, "finished").otherwise(F.concat(F.lit("chapter "), (position + 1).cast("string"), F.lit("/"), total.cast("string")))


def shelf_id(url: Column, slug: Column, known: Column) -> Column:
    """Slug of a known record, else a raw path as it is, else null."""
    return F.when(known & slug.isNotNull(), slug).when(~F.regexp(url, F.lit("^https?://")), url)


# --- uploads ---


def safe_filename(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    cleaned = F.regexp_replace(strip(F.regexp_replace(base, r'[\\/:*?"<>|\x00-\x1f]', "_")), r"^\.+|\.+$", "")
    return F.when(cleaned == "", "untitled").otherwise(cleaned)


def parse_filename(stem: Column) -> Column:
    """struct<title, author, status> of an untidy file name."""
    status = F.when(F.contains(stem, F.lit(K.DONE)), K.DONE).when(F.contains(stem, F.lit(K.SERIAL)), K.SERIAL).otherwise("")
    plain = strip(F.regexp_replace(stem, r"[【\[（(][^】\]）)]*[】\]）)]", ""))
    book = r"《([^》]+)》(?U:\s*)[-—]?(?U:\s*)(.*)"
    quoted, dashed, lined = F.regexp(plain, F.lit(book)), F.contains(plain, F.lit(" - ")), F.contains(plain, F.lit("_"))
    title = F.when(quoted, strip(F.regexp_extract(plain, book, 1))).when(dashed, strip(F.split(plain, " - ", 2)[0])).when(lined, strip(F.regexp_extract(plain, r"(?s)^(.*)_[^_]*$", 1))).otherwise(plain)
    author = F.when(quoted, F.regexp_replace(F.regexp_extract(plain, book, 2), r"^[ \-—_·]+|[ \-—_·]+$", "")).when(dashed, strip(F.get(F.split(plain, " - ", 2), 1))).when(lined, strip(F.regexp_extract(plain, r"_([^_]*)$", 1))).otherwise("")
    return F.struct(F.when(title == "", strip(stem)).otherwise(title).alias("title"), F.when(F.length(author) > 30, "").otherwise(author).alias("author"), status.alias("status"))


def guess_synopsis(text: Column, first_title: Column, first_body: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip), lambda x: x != "")
    return F.when(first_title == "Front matter", F.left(strip(first_body), F.lit(400))).otherwise(F.left(F.array_join(F.slice(lines, 1, 3), " "), F.lit(400)))


def unclobbered(stem: Column, order: Column) -> Column:
    """name, name_2, name_3, ... by arrival among equal names (order from 1)."""
    return F.when(order == 1, stem).otherwise(F.concat(stem, F.lit("_"), order.cast("string")))


def chunk_hash(text: Column, voice: Column, rate: Column, volume: Column, pitch: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parameters as JSON with sorted keys, ', ' and ': '."""

    def quoted(c: Column) -> Column:
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return F.concat(F.lit('"'), c, F.lit('"'))

    pairs = [F.concat(F.lit(f'"{k}": '), quoted(v)) for k, v in (("pitch", pitch), ("rate", rate), ("text", text), ("voice", voice), ("volume", volume))]
    return F.left(F.sha1(F.encode(F.concat(F.lit("{"), F.array_join(F.array(*pairs), ", "), F.lit("}")), "UTF-8")), F.lit(16))


def fingerprint(line: Column, n: int = 16) -> Column:
    return F.left(strip(line), F.lit(n))


# --- predicates on nodes, lines, responses ---


def is_live(fetch_status: Column) -> Column:
    return F.coalesce(fetch_status, F.lit("ok")) == "ok"


def any_of(text: Column, markers: tuple[str, ...]) -> Column:
    return F.regexp(text, F.lit("|".join(re.escape(m) for m in markers)))


def is_ad(text: Column, markers: tuple[str, ...] = K.AD_MARKERS) -> Column:
    return any_of(text, markers)


def is_divider(line: Column) -> Column:
    return F.regexp(strip(line), F.lit(f"^{K.DIVIDER}{{{K.DIVIDER_MIN},}}$"))


def response_verdict(error: Column, status: Column, body: Column) -> Column:
    """Ordered verdict on a response; content decides before the status does."""
    body = F.coalesce(body, F.lit(""))
    return (
        F.when(error.isNotNull(), "error")
        .when(status == 429, "rate_limited")
        .when(any_of(body, K.CONTENT_MARKERS), "ok")
        .when(status.isin(403, 503) | any_of(body, K.BLOCK_MARKERS), "challenged")
        .when(status == 404, "not_found")
        .when(status == 200, "challenged")
        .otherwise("error")
    )


def backoff_seconds(attempt: Column) -> Column:
    """5 * 2^n, 60 at most."""
    return F.least(F.lit(60), F.lit(5) * F.pow(F.lit(2), attempt)).cast("int")


def page_text_or_mark(text: Column, url: Column) -> Column:
    """A page that failed keeps its place as a marker."""
    return F.coalesce(text, F.concat(F.lit(K.FAILED_PAGE + " "), url, F.lit("]")))


def scrape_decision(exists: Column, complete: Column, links_valid: Column, n_links: Column, force: Column) -> Column:
    """What to do with a title: skip, refetch, rebuild its links, or report that it has no chapters."""
    return F.when(exists & complete & ~force, "skip").when(~links_valid, "rebuild_links").when(n_links == 0, "no_chapters").otherwise(F.when(exists, "refetch").otherwise("fetch"))
