"""Uploads (P36, SK10): suggested metadata of raw files, and records of what is saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.functions import scalars, text
from lorebase.sources.readers import decode_text
from lorebase.sources.schemas import with_record_defaults
from lorebase.sources.writers import upload_names


def detect(files: DataFrame) -> DataFrame:
    """(upload, filename, title, author, status, language, chapter_count, synopsis, text) of files(upload, filename, content)."""
    stem = F.regexp_replace(F.regexp_extract("filename", r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    raw = files.select("upload", stem.alias("stem"), decode_text("content").alias("text"))
    parts = text.book_chapters(raw, key="upload")
    found = parts.groupBy("upload").agg(F.count("*").cast("int").alias("chapter_count"), F.min_by(F.struct("title", "body"), "chapter").alias("first"))
    name = scalars.parse_filename(F.col("stem"))
    out = raw.join(found, "upload", "left").withColumn("n", name)
    return out.select(
        "upload", F.concat(scalars.safe_filename(F.col("stem")), F.lit(".txt")).alias("filename"), "n.title", "n.author", "n.status",
        text.detect_language(F.left("text", F.lit(2000))).alias("language"), F.coalesce("chapter_count", F.lit(0)).alias("chapter_count"),
        scalars.guess_synopsis(F.col("text"), F.coalesce("first.title", F.lit("")), F.coalesce("first.body", F.lit(""))).alias("synopsis"), "text",
    )


def to_records(detected: DataFrame, taken: DataFrame, category: str = "uploads") -> DataFrame:
    """Full records of detected uploads under names that are free; taken: (stem) of saved files."""
    named = upload_names(detected.withColumn("stem", F.regexp_replace("filename", r"\.txt$", "")).withColumn("seq", F.col("upload")), taken)
    path = F.concat(F.lit(category + "/"), "file")
    none = F.lit(None)
    rows = named.select(
        F.concat(F.lit("upload:"), path).alias("url"), F.lit(category).alias("category"), "title", "author", "status", F.lit("").alias("upload_date"), F.lit("").alias("year_month"), "chapter_count", none.cast("int").alias("page_count"),
        "synopsis", F.array().cast("array<string>").alias("tags"), F.lit("").alias("one_liner"), F.lit("").alias("intent"), F.lit("").alias("excerpt"), F.lit("full").alias("source"), path.alias("file"), F.lit("").alias("content_hash"),
    )
    return with_record_defaults(rows)
