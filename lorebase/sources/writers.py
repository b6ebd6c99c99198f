"""Sinks (SK1-SK11). A table is written beside its place and then moved there, so readers see the old or the new one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorebase.functions import constants as K
from lorebase.functions.scalars import parse_heading, title_to_filename, unclobbered

from .files import hadoop, located, open_store


def replace_folder(spark: SparkSession, path: str, write) -> None:
    """write(staging path), then swap it in by renames on the path's own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    P = jvm.org.apache.hadoop.fs.Path
    stage, old = (f"{path.rstrip('/')}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    write(stage)
    fs = P(path).getFileSystem(conf)
    had = fs.exists(P(path))
    if had and not fs.rename(P(path), P(old)):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(P(stage), P(path)):
        if had:
            fs.rename(P(old), P(path))
        raise OSError(f"{stage} can't be moved")
    if had:
        fs.delete(P(old), True)


def write_records(records: DataFrame, path: str) -> None:
    """Records as JSON lines, one folder a category, ordered by (upload_date, url) over and within its files.

    Ranges of rows, not categories, are the tasks, so that a large category is written by many.
    """
    out = records.repartitionByRange("category", "upload_date", "url").sortWithinPartitions("category", "upload_date", "url").withColumn("_category", F.col("category"))
    replace_folder(records.sparkSession, path, lambda p: out.write.partitionBy("_category").option("ignoreNullFields", False).json(p))


def write_catalog(catalog: DataFrame, path: str) -> None:
    out = catalog.repartitionByRange("category", "url").sortWithinPartitions("category", "url").withColumn("_category", F.col("category"))
    replace_folder(catalog.sparkSession, path, lambda p: out.write.partitionBy("_category").option("ignoreNullFields", False).json(p))


def write_index(index: DataFrame, path: str, model: str, created: str) -> None:
    """Vectors and then a manifest of one row; the manifest makes the index readable."""

    def write(p: str) -> None:
        index.write.parquet(f"{p}/vectors")
        done = index.sparkSession.read.parquet(f"{p}/vectors")
        done.agg(F.lit(model).alias("model"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dim"), F.lit(created).alias("created"), F.count("*").alias("count")).write.json(f"{p}/manifest")

    replace_folder(index.sparkSession, path, write)


def render_text(title: Column, author: Column, status: Column, upload_date: Column, url: Column, nav: dict[str, tuple[Column, Column]], chapters: Column, failed: Column, scraped: Column) -> Column:
    """The saved form of a title; chapters: array<struct<header, body>> with a null header before the first head."""
    dash = lambda c: F.when(F.coalesce(c, F.lit("")) == "", K.NONE_MARK).otherwise(c)

    def around(label: str, name: Column, link: Column) -> list[Column]:
        h = parse_heading(F.coalesce(name, F.lit("")))
        file = F.when(F.coalesce(name, F.lit("")) == "", K.NONE_MARK).otherwise(title_to_filename(h["title"], h["author"], h["status"]))
        return [F.concat(F.lit(label), dash(name)), F.concat(F.lit("        URL:  "), dash(link)), F.concat(F.lit("        文件: "), file), F.lit("")]

    heads = F.filter(chapters, lambda c: c["header"].isNotNull())
    whole = F.when(failed == 0, K.COMPLETE).otherwise(F.concat(F.lit("缺失"), failed.cast("string"), F.lit("页（见正文 [页面获取失败]）")))
    lines = [F.concat(F.lit(a), b) for a, b in ((K.TITLE_LABEL, title), (K.AUTHOR_LABEL, author), (K.STATUS_LABEL, status), (K.UPLOADED_LABEL, upload_date), (K.CHAPTERS_LABEL, F.size(heads).cast("string")), (K.INTEGRITY_LABEL, whole), (K.SCRAPED_LABEL, scraped))]
    lines += [F.lit(""), *around(K.PREV_LABEL, *nav["prev"]), *around(K.NEXT_LABEL, *nav["next"]), F.concat(F.lit(K.SOURCE_LABEL), url)]
    frame = F.lit(K.DIVIDER * K.DIVIDER_WIDTH + "\n\n")
    bodies = F.transform(chapters, lambda c: F.when(c["header"].isNotNull(), F.concat(frame, c["header"], F.lit("\n\n"), c["body"])).otherwise(c["body"]))
    return F.concat(F.array_join(F.array(*lines), "\n"), F.lit("\n\n"), F.array_join(bodies, "\n\n"), F.lit("\n"))


def _put_files(rows: DataFrame, path: str) -> None:
    """Rows (file, data binary) as files path/file, by the tasks; neighbouring rows of one file are put together in it.

    A task writes to a hidden folder of its own and then moves the file to its place, so none is half written and
    an attempt that is repeated replaces what the first one wrote. File systems are those of pyarrow (local, hdfs, s3, gs, abfs).
    """
    spark = rows.sparkSession
    p, fs = hadoop(spark, path)
    fs.mkdirs(p)
    uri, place = located(fs, p)
    stage = f".stage-{uuid.uuid4().hex}"

    def put(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(uri)
        root = base + place.rstrip("/")
        # one folder for all tasks would make them wait for each other
        own = f"{root}/{stage}/{uuid.uuid4().hex}"
        part, n, known, name, out = f"{own}/part", 0, set(), None, None
        store.create_dir(own, recursive=True)

        def done() -> None:
            out.close()
            target = f"{root}/{name}"
            if (folder := target.rpartition("/")[0]) not in known:
                store.create_dir(folder, recursive=True)
                known.add(folder)
            if store.type_name == "hdfs" and store.get_file_info(target).type != pafs.FileType.NotFound:
                store.delete_file(target)
            store.move(part, target)

        for b in it:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if file != name:
                    if out is not None:
                        done()
                    name, out, n = file, store.open_output_stream(part), n + 1
                out.write(data.as_py() or b"")
        if out is not None:
            done()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.select("file", "data").mapInArrow(put, "n long").agg(F.sum("n")).collect()
    fs.delete(hadoop(spark, f"{path.rstrip('/')}/{stage}")[0], True)


def write_texts(texts: DataFrame, path: str) -> None:
    """(file, text) as one text file each: path/file, whose parts may be folders and have as many bytes as the file system allows.

    Tasks write the files and give them their names. If this is cut off, some files are new and some old, none is half
    written, and another call replaces them all. A name that occurs twice is an error of the caller; then texts may be lost.
    """
    _put_files(texts.select("file", F.encode(F.concat(F.regexp_replace(F.coalesce("text", F.lit("")), r"\n\z", ""), F.lit("\n")), "UTF-8").alias("data")), path)


def patch_navigation(text: Column, label: str, name: Column, url: Column, file: Column) -> Column:
    """The first block of a label with its URL and file lines replaced."""
    block = F.concat(F.lit(label), name, F.lit("\n        URL:  "), url, F.lit("\n        文件: "), file)
    quoted = F.regexp_replace(block, r"([\\$])", r"\\$1")
    pattern = F.lit(rf"(?s)\A(.*?)(?m:^{label}[^\n]*\n[ ]+URL:[^\n]*\n[ ]+文件:[^\n]*)")
    return F.regexp_replace(text, pattern, F.concat(F.lit("$1"), quoted))


def render_table(headers: list[str], rows: list[list[str]], footer: list[str] | None = None, title: str | None = None) -> str:
    """A collected report as text: first column left, others right, a rule above the footer."""
    every = [headers, *rows, *([footer] if footer else [])]
    widths = [max(len(r[i]) for r in every) for i in range(len(headers))]
    line = lambda r: "  ".join(x.ljust(w) if i == 0 else x.rjust(w) for i, (x, w) in enumerate(zip(r, widths, strict=True))).rstrip()
    rule = "  ".join("-" * w for w in widths)
    out = [*([title, ""] if title else []), line(headers), rule, *map(line, rows), *([rule, line(footer)] if footer else [])]
    return "\n".join(out)


def write_report(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_user_state(state: DataFrame, path: str) -> None:
    """state(user, ...) as JSON lines, a file for each user: those of the users at hand are replaced whole, others stay.

    Files lie in 256 folders by hash of the name, so that listing them is spread. A user's name is part of a path; others
    than plain names are refused.
    """
    bad = state.where(~F.regexp("user", F.lit(K.USER_NAME)) | F.col("user").isNull()).limit(1)
    if not bad.isEmpty():
        raise ValueError("invalid user name")
    file = F.concat(F.left(F.sha1(F.encode("user", "UTF-8")), F.lit(2)), F.lit("/"), "user", F.lit(".json"))
    line = F.concat(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), F.lit("\n"))
    lines = state.select("user", file.alias("file"), F.encode(line, "UTF-8").alias("data"))
    _put_files(lines.repartition("user").sortWithinPartitions("user"), path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def run_log(rows: DataFrame) -> DataFrame:
    """(line) of rows(url, title, failed array<string>): titles whose pages failed, and the pages below them."""
    some = rows.where(F.size("failed") > 0).orderBy("url")
    lines = F.concat(F.array(F.concat(F.col("title"), F.lit("  "), F.col("url"), F.lit("  ("), F.size("failed").cast("string"), F.lit(")"))), F.transform("failed", lambda u: F.concat(F.lit("    "), u)))
    return some.select(F.explode(lines).alias("line"))


def count_table(counts: DataFrame, per_row: int, key: str = "url") -> DataFrame:
    """(key, row, text) of counts(key, page_no, n): so many cells to a row of text."""
    cell = F.format_string("%4d:%6d", "page_no", "n")
    rows = counts.withColumn("row", F.floor((F.col("page_no") - 1) / per_row))
    return rows.groupBy(key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", cell.alias("c")))), lambda x: x["c"]), " ").alias("text"))


def upload_names(uploads: DataFrame, taken: DataFrame) -> DataFrame:
    """uploads(stem, seq) with file: names not taken before, numbered from _2 on by arrival."""
    used = taken.groupBy("stem").agg(F.count("*").alias("used"))
    order = F.row_number().over(Window.partitionBy("stem").orderBy("seq"))
    out = uploads.withColumn("k", order).join(used, "stem", "left").withColumn("k", F.col("k") + F.coalesce("used", F.lit(0)))
    return out.withColumn("file", F.concat(unclobbered(F.col("stem"), F.col("k")), F.lit(".txt"))).drop("k", "used")


def write_demo(corpus: DataFrame, path: str) -> None:
    """The demo corpus without excerpts."""
    replace_folder(corpus.sparkSession, path, lambda p: corpus.drop("excerpt").write.parquet(p))
