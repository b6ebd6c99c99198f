"""Schemas of the data model; reading fills defaults, since Spark leaves missing fields null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions.scalars import content_hash, embed_text

_S, _I, _L = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType())
TEXT_FIELDS = ("category", "title", "author", "status", "upload_date", "year_month", "synopsis", "one_liner", "intent", "excerpt")
RECORD = T.StructType(
    [T.StructField(n, t) for n, t in (("url", _S), ("category", _S), ("title", _S), ("author", _S), ("status", _S), ("upload_date", _S), ("year_month", _S), ("chapter_count", _I), ("page_count", _I), ("synopsis", _S), ("tags", _L), ("one_liner", _S), ("intent", _S), ("excerpt", _S), ("source", _S), ("file", _S), ("content_hash", _S))]
)
CATALOG = T.StructType(
    [T.StructField(n, t) for n, t in (("url", _S), ("category", _S), ("title", _S), ("author", _S), ("upload_date", _S), ("fetch_status", _S), ("prev_url", _S), ("next_url", _S), ("rec_urls", _L), ("has_meta", T.BooleanType()))]
)
INDEX = T.StructType([T.StructField("url", _S), T.StructField("row_id", T.LongType()), T.StructField("content_hash", _S), T.StructField("model", _S), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def with_record_defaults(df: DataFrame) -> DataFrame:
    """Empty strings for missing text, no tags, source full, and a content hash only where there is none."""
    for c in TEXT_FIELDS:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    df = df.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("source", F.coalesce("source", F.lit("full")))
    made = content_hash(embed_text(*[F.col(c) for c in ("title", "tags", "one_liner", "synopsis", "excerpt")]))
    return df.withColumn("content_hash", F.when(F.coalesce("content_hash", F.lit("")) != "", F.col("content_hash")).otherwise(made)).select(*RECORD.names)


def with_catalog_defaults(df: DataFrame) -> DataFrame:
    out = df.withColumn("fetch_status", F.coalesce("fetch_status", F.lit("ok"))).withColumn("has_meta", F.coalesce("has_meta", F.lit(False)))
    return out.withColumn("rec_urls", F.coalesce("rec_urls", F.array().cast("array<string>"))).select(*CATALOG.names)
