"""Scans (SC1-SC21): record and catalogue stores, text libraries, logs, dictionaries and archives of chapters.

File scans carry the position of a row, so that "the last duplicate wins" holds across splits: rows are ordered by file,
block and place in the block.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lorebase.functions import constants as K
from lorebase.functions import urls
from lorebase.functions.scalars import is_divider, strip
from lorebase.functions.tags import extract_tags

from .files import list_files, path_uri, read_files
from .schemas import CATALOG, RECORD, with_catalog_defaults, with_record_defaults


def _json_lines(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """Rows of JSON-lines files with their order; folders or files that are missing give none, a malformed line fails."""
    found = []
    for i, p in enumerate(paths):
        try:
            raw = spark.read.text(p)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        at = F.struct(F.lit(i).alias("store"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        found.append(raw.where(F.trim("value") != "").select(at.alias("at"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("at", "r.*"))
    if not found:
        return spark.createDataFrame([], schema).select(F.lit(None).cast("struct<store:int,file:string,block:bigint,row:bigint>").alias("at"), "*")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def last_by_url(rows: DataFrame) -> DataFrame:
    """Of rows with equal url the last in order; one aggregate with map-side combine, no window."""
    columns = [c for c in rows.columns if c != "at"]
    return rows.groupBy("url").agg(F.max_by(F.struct(*columns), "at").alias("r")).select("r.*")


def load_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of one store or several; later lines and later stores win."""
    return with_record_defaults(last_by_url(_json_lines(spark, paths, RECORD)))


def load_catalog(spark: SparkSession, paths: list[str]) -> DataFrame:
    return with_catalog_defaults(last_by_url(_json_lines(spark, paths, CATALOG)))


def load_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(all, live) of a JSON array; fails on a missing or repeated url."""
    rows = spark.read.schema(CATALOG).option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad = rows.agg(F.count_if(F.col("url").isNull()).alias("none"), (F.count("url") - F.count_distinct("url")).alias("twice")).first()
    if bad["none"] or bad["twice"]:
        raise ValueError(f"catalogue has {bad['none']} entries without url and {bad['twice']} repeated ones")
    rows = with_catalog_defaults(rows)
    return rows, rows.where("fetch_status = 'ok'")


def load_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index table, or None while it has not been written whole; a damaged one fails."""
    try:
        spark.read.json(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(f"{path}/vectors")


def load_engine(index: DataFrame, records: DataFrame) -> DataFrame:
    """Index rows with their records; fails if an indexed url has no record."""
    orphans = index.join(records, "url", "left_anti").select("url").limit(5).collect()
    if orphans:
        raise ValueError(f"indexed urls without a record: {[r.url for r in orphans]}")
    return index.drop("content_hash").join(records, "url")


def load_user_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The state of all users; none where nothing has been written."""
    try:
        return spark.read.schema(f"{schema}, user string").option("recursiveFileLookup", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, user string")


def load_demo(spark: SparkSession, path: str) -> DataFrame:
    """The demo corpus: records, vectors and coordinates in one table."""
    return spark.read.parquet(path)


# --- saved text files ---


def _spark_files(spark: SparkSession, root: str, glob: str, kind: str, **options):
    return spark.read.format(kind).options(recursiveFileLookup=True, pathGlobFilter=glob, **options).load(root)


def text_files(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(path, text) of whole files below root; tasks list and read them."""
    listed = list_files(spark, root, glob)
    if listed is None:
        return _spark_files(spark, root, glob, "text", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return read_files(listed, path_uri).select("path", F.col("content").cast("string").alias("text"))


def file_facts(spark: SparkSession, root: str, glob: str = "*.txt") -> DataFrame:
    """(path, modified, bytes) without reading contents; tasks list the files."""
    listed = list_files(spark, root, glob)
    if listed is None:
        return _spark_files(spark, root, glob, "binaryFile").select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return listed.select("path", "modified", "bytes")


def _head_lines(text: Column) -> Column:
    return F.slice(F.split(text, "\n", -1), 1, 25)


def _labelled(lines: Column, label: str) -> Column:
    found = F.filter(lines, lambda x: F.startswith(x, F.lit(label)))
    return F.when(F.size(found) > 0, strip(F.substring(F.get(found, 0), len(label) + 1, 100_000)))


def source_url(text: Column) -> Column:
    return _labelled(_head_lines(text), K.SOURCE_LABEL)


def is_complete(text: Column) -> Column:
    """By the integrity line; a file without one is complete."""
    return F.coalesce(_labelled(_head_lines(text), K.INTEGRITY_LABEL) == K.COMPLETE, F.lit(True))


def watched_novel(files: DataFrame) -> DataFrame:
    """(path, title, author, status, chapters, integrity, chars) of saved files(path, text).

    Chapters are the labelled number, or the headings of the body where that is no number; chars counts the body behind the
    source line; a file without the integrity line is `unknown`.
    """
    lines = F.split("text", "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit(K.SOURCE_LABEL))), True).cast("int")
    f = files.withColumn("head", F.when(at > 0, F.slice(lines, 1, at)).otherwise(lines)).withColumn("body", F.when(at > 0, F.slice(lines, at + 1, F.size(lines))).otherwise(F.array().cast("array<string>")))
    field = lambda label: F.coalesce(_labelled(F.col("head"), label), F.lit(""))
    headed = F.size(F.filter("body", lambda x: F.regexp(strip(x), F.lit(K.CHAPTER_HEAD))))
    return f.select(
        "path", field(K.TITLE_LABEL).alias("title"), field(K.AUTHOR_LABEL).alias("author"), field(K.STATUS_LABEL).alias("status"),
        F.coalesce(F.when(F.regexp(field(K.CHAPTERS_LABEL), F.lit(r"^\d+$")), field(K.CHAPTERS_LABEL).try_cast("int")), headed).alias("chapters"),
        F.when(field(K.INTEGRITY_LABEL) == "", "unknown").otherwise(field(K.INTEGRITY_LABEL)).alias("integrity"), F.length(strip(F.array_join("body", "\n"))).alias("chars"),
    )


def incomplete_files(files: DataFrame) -> DataFrame:
    return files.where(F.contains("text", F.lit(K.PAGE_FAILED)))


def parse_saved(files: DataFrame, root: str = "") -> DataFrame:
    """Records of saved files (path, url, text); files without a title are left out.

    The three parts of a file (labels, synopsis, body) are found by positions of lines; each capped part is a running
    sum over the file's own lines, folded in one expression.
    """
    lines = F.split("text", "\n", -1)
    source_at = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit(K.SOURCE_LABEL))), True).cast("int")
    head = F.when(source_at > 0, F.slice(lines, 1, source_at)).otherwise(lines)
    rest = F.when(source_at > 0, F.slice(lines, source_at + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    last = lambda label: F.coalesce(F.element_at(F.filter(F.col("head"), lambda x: F.startswith(x, F.lit(label))), -1), F.lit(""))
    field = lambda label: strip(F.substring(last(label), len(label) + 1, 100_000))
    f = files.withColumn("head", head).withColumn("rest", rest)
    f = f.withColumn("heads", F.size(F.filter("head", lambda x: F.startswith(x, F.lit(K.TITLE_LABEL)))))
    # the synopsis ends at the first divider, or with the line on which it reaches its limit
    none = F.array().cast("array<string>")
    part = F.struct(F.lit(False).alias("over"), none.alias("syn"), F.lit(0).alias("n"), none.alias("body"), F.lit(0).alias("m"))

    def step(s: Column, x: Column) -> Column:
        body_line = strip(x)
        takes = (body_line != "") & ~is_divider(x) & ~F.regexp(body_line, F.lit(K.CHAPTER_HEAD)) & (s["m"] < K.EXCERPT_CHARS)
        return (
            F.when(~s["over"] & is_divider(x), s.withField("over", F.lit(True)))
            .when(~s["over"], F.struct((s["n"] + F.length(x) >= K.SYNOPSIS_RAW_CHARS).alias("over"), F.concat(s["syn"], F.array(x)).alias("syn"), (s["n"] + F.length(x)).alias("n"), s["body"].alias("body"), s["m"].alias("m")))
            .when(takes, s.withField("body", F.concat(s["body"], F.array(body_line))).withField("m", s["m"] + F.length(body_line)))
            .otherwise(s)
        )

    f = f.withColumn("parts", F.aggregate("rest", part, step))
    f = f.select("path", "url", *[field(label).alias(c) for c, label in (("title", K.TITLE_LABEL), ("author", K.AUTHOR_LABEL), ("status", K.STATUS_LABEL), ("upload_date", K.UPLOADED_LABEL), ("chapters", K.CHAPTERS_LABEL))], F.array_join("parts.syn", "\n").alias("raw"), F.left(F.array_join("parts.body", "\n"), F.lit(K.EXCERPT_CHARS)).alias("excerpt")).where("title <> ''")
    f = f.withColumn("x", extract_tags("raw", "title", "author"))
    folder, grand = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1)
    date_ym = F.regexp_extract("upload_date", K.DATE_YM, 1)
    ym = F.when(F.regexp(folder, F.lit(r"^\d{4}-\d{2}$")), folder).when(date_ym != "", F.concat_ws("-", date_ym, F.regexp_extract("upload_date", K.DATE_YM, 2))).otherwise("")
    out = f.select(
        "url", F.coalesce(urls.category_of(F.col("url")), grand).alias("category"), "title", "author", "status", "upload_date", ym.alias("year_month"),
        F.when(F.regexp("chapters", F.lit(r"^\d+$")), F.col("chapters").try_cast("int")).alias("chapter_count"), F.lit(None).cast("int").alias("page_count"),
        F.left("x.synopsis", F.lit(K.SYNOPSIS_CHARS)).alias("synopsis"), F.col("x.tags").alias("tags"), F.col("x.one_liner").alias("one_liner"), F.col("x.intent").alias("intent"), "excerpt",
        F.lit("full").alias("source"), F.regexp_replace("path", f"^(?:file:)?/*{re.escape(root.strip('/'))}/" if root else "^$", "").alias("file"), F.lit("").alias("content_hash"),
    )
    return with_record_defaults(out)


def navigation(text: Column) -> Column:
    """struct<prev_url, next_url, title, upload_date>: a nav label's URL stands in the two lines after it."""
    lines = _head_lines(text)

    def url_after(label: str) -> Column:
        at = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit(label))), True).cast("int")
        near = F.transform(F.slice(lines, at + 1, 2), lambda x: F.regexp_extract(x, r"URL:\s*(https?://\S+)", 1))
        return F.when(at > 0, F.get(F.filter(near, lambda x: x != ""), 0))

    return F.struct(url_after(K.PREV_LABEL).alias("prev_url"), url_after(K.NEXT_LABEL).alias("next_url"), _labelled(lines, K.TITLE_LABEL).alias("title"), _labelled(lines, K.UPLOADED_LABEL).alias("upload_date"))


# --- bytes ---


@F.pandas_udf(T.StringType())
def decode_text(raw: pd.Series) -> pd.Series:
    """UTF-8 with or without BOM, else GB18030, else UTF-8 with replacements."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        for name in ("utf-8-sig", "gb18030"):
            try:
                return b.decode(name)
            except UnicodeDecodeError:
                pass
        return b.decode("utf-8", "replace")

    return raw.map(one)


_BLOCK_TAGS = frozenset("p div br li h1 h2 h3 h4 h5 h6 section article blockquote tr".split())


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.mute = [], 0

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style")
        self.out += ["\n"] if tag in _BLOCK_TAGS else []

    def handle_endtag(self, tag):
        self.mute -= tag in ("script", "style") and self.mute > 0
        self.out += ["\n"] if tag in _BLOCK_TAGS else []

    def handle_data(self, data):
        self.out += [] if self.mute else [data]


def _plain_text(html: str) -> str:
    p = _Plain()
    p.feed(html)
    p.close()
    return "\n\n".join(x for line in "".join(p.out).split("\n") if (x := " ".join(line.split())))


#: Media types of a book's chapters.
CHAPTER_TYPES = ("application/xhtml+xml", "text/html", "")


def epub_text(raw: bytes) -> str:
    """Text of an EPUB in the order of its spine."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf_path = next(e.attrib["full-path"] for e in box.iter() if local(e) == "rootfile")
        opf = list(ElementTree.fromstring(z.read(opf_path)).iter())
        items = {e.attrib["id"]: e.attrib for e in opf if local(e) == "item"}
        spine = [items[e.attrib["idref"]] for e in opf if local(e) == "itemref" and e.attrib.get("idref") in items]
        base = posixpath.dirname(opf_path)
        # hrefs are URLs; a chapter that the spine names and the archive lacks is an error, not a gap
        hrefs = [unquote(a["href"].partition("#")[0]) for a in spine if a.get("media-type", "").lower() in CHAPTER_TYPES]
        parts = [_plain_text(z.read(posixpath.normpath(posixpath.join(base, h))).decode("utf-8", "replace")) for h in hrefs]
    return "\n\n".join(p for p in parts if p)


def epub_texts(files: DataFrame) -> DataFrame:
    """(path, text, error) of files(path, content): one that is no EPUB, or lacks a chapter, has an error instead of a text."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for path, raw in zip(b.path, b.content, strict=True):
                try:
                    rows.append((path, epub_text(bytes(raw)), None))
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
                    rows.append((path, None, repr(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def read_epubs(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, error) of the EPUB files below root."""
    return epub_texts(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(root))


# --- logs, dictionaries, lists ---


def page_counts(log: DataFrame, pages: str = r"(\d+)p\b", link: str = r"(https?://\S+)") -> DataFrame:
    """(url, pages) of log(file, line_no, line): a count belongs to the URL on the next line; the largest is taken."""
    after = F.lead("line").over(Window.partitionBy("file").orderBy("line_no"))
    pairs = log.select(F.regexp_extract(after, link, 1).alias("url"), F.regexp_extract("line", pages, 1).try_cast("int").alias("pages"))
    return pairs.where("url <> '' and pages is not null").groupBy("url").agg(F.max("pages").alias("pages"))


DICT_LINE = r"^(\S+)\s+(\S+)\s+\[([^\]]*)\]\s+/(.*)/\s*$"


def dictionary(lines: DataFrame, tone) -> DataFrame:
    """(word, order, trad, simp, pinyin, defs) of lines(line_no, line), under simplified and traditional words."""
    part = lambda i: F.regexp_extract("line", DICT_LINE, i)
    rows = lines.where(~F.startswith("line", F.lit("#")) & F.regexp("line", F.lit(DICT_LINE))).select("line_no", part(1).alias("trad"), part(2).alias("simp"), part(3).alias("numbered"), F.filter(F.split(part(4), "/"), lambda d: d != "").alias("defs"))
    return rows.select(F.explode(F.array_distinct(F.array("simp", "trad"))).alias("word"), F.col("line_no").alias("order"), "trad", "simp", tone("numbered").alias("pinyin"), "defs")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> '' and not startswith(url, '#')")


def safe_join(root: str, relative: str) -> str:
    """A path below root; anything that leaves it is refused."""
    base = os.path.realpath(root)
    full = os.path.realpath(os.path.join(base, relative.lstrip("/")))
    if full != base and not full.startswith(base + os.sep):
        raise ValueError("path leaves the library")
    return full


TEXT_SUFFIX, DOC_SUFFIX = (".txt", ".md"), (".pdf", ".epub", ".doc", ".docx", ".mobi")


def classify(name: Column, is_dir: Column) -> Column:
    ends = lambda suffixes: F.regexp(F.lower(name), F.lit("(?:" + "|".join(map(re.escape, suffixes)) + ")$"))
    return F.when(is_dir, "dir").when(ends(TEXT_SUFFIX), "text").when(ends(DOC_SUFFIX), "doc").otherwise("other")


def list_dir(spark: SparkSession, root: str, relative: str = "", hidden: tuple[str, ...] = ("metadata.jsonl",)) -> DataFrame:
    """(name, path, kind, size): folders first, then by name; hidden names and the store file are left out."""
    full = safe_join(root, relative)
    rows = [(e.name, os.path.relpath(e.path, os.path.realpath(root)), e.is_dir(), 0 if e.is_dir() else e.stat().st_size) for e in os.scandir(full) if e.name[0] not in "._" and e.name not in hidden]
    df = spark.createDataFrame(rows, "name string, path string, is_dir boolean, size long")
    return df.select("name", "path", classify(F.col("name"), F.col("is_dir")).alias("kind"), "size").orderBy(F.col("kind") != "dir", F.lower("name"))
