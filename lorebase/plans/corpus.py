"""Adapters: the driver's tables seen through the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First ship date of each part; pre-aggregated on the map side."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_shipdate").alias("first"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as records."""
    p = table(spark, sf_dir, "part").join(dates(spark, sf_dir), F.col("p_partkey") == F.col("l_partkey"), "left")
    key = F.col("p_partkey")
    return p.select(
        key.alias("row_id"),
        F.concat(F.lit("https://www.books.example/"), F.lower("p_type"), F.lit("/"), F.lpad((key % 7).cast("string"), 2, "0"), F.lit("_b/"), key.cast("string"), F.lit(".html")).alias("url"),
        F.lower("p_type").alias("category"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
        F.when(F.col("p_size") % 2 == 0, "完结").otherwise("连载").alias("status"), F.col("p_size").alias("chapter_count"), F.lit(None).cast("int").alias("page_count"),
        F.coalesce(F.date_format("first", "yyyy-MM"), F.lit("")).alias("year_month"), F.coalesce(F.date_format("first", "yyyy-MM-dd"), F.lit("")).alias("upload_date"),
        F.split("p_name", " ").alias("tags"), F.concat_ws(" ", "p_name", F.lit("by"), "p_brand").alias("synopsis"),
        F.when(key % 3 != 0, F.concat(F.lower("p_type"), F.lit("/"), key.cast("string"), F.lit(".txt"))).alias("file"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with vectors."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    return records(spark, sf_dir).join(e, "row_id")


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a chain by date, with dead, mismatched and missing neighbours made by rule."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("upload_date"), F.lag("o_orderkey").over(w).alias("prev"), F.lead("o_orderkey").over(w).alias("next"))
    url = F.col("url")
    return o.select(
        "url", "o_custkey", "upload_date", F.when(url % 11 == 0, "not_found").otherwise("ok").alias("fetch_status"),
        F.when(url % 13 == 0, F.lit(None)).otherwise(F.col("prev")).alias("prev_url"), F.when(url % 17 == 0, -url - 1).otherwise(F.col("next")).alias("next_url"),
    )


#: The same as SQL common table expressions.
RECORDS_SQL = """
dates AS (SELECT l_partkey, min(l_shipdate) AS first FROM lineitem GROUP BY l_partkey),
records AS (SELECT p_partkey AS row_id, concat('https://www.books.example/', lower(p_type), '/', lpad(CAST(p_partkey % 7 AS VARCHAR), 2, '0'), '_b/', p_partkey, '.html') AS url,
  lower(p_type) AS category, p_name AS title, p_brand AS author, CASE WHEN p_size % 2 = 0 THEN '完结' ELSE '连载' END AS status, p_size AS chapter_count,
  coalesce(strftime(first, '%Y-%m'), '') AS year_month, coalesce(strftime(first, '%Y-%m-%d'), '') AS upload_date, string_split(p_name, ' ') AS tags,
  concat(p_name, ' by ', p_brand) AS synopsis, CASE WHEN p_partkey % 3 <> 0 THEN concat(lower(p_type), '/', p_partkey, '.txt') END AS file
  FROM part LEFT JOIN dates ON p_partkey = l_partkey)"""
CORPUS_SQL = RECORDS_SQL + """,
corpus AS (SELECT r.*, embedding FROM records r JOIN embeddings e ON r.row_id = e.vec_id)"""
GRAPH_SQL = """
raw AS (SELECT o_orderkey AS url, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS upload_date, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
graph AS (SELECT url, o_custkey, upload_date, CASE WHEN url % 11 = 0 THEN 'not_found' ELSE 'ok' END AS fetch_status, CASE WHEN url % 13 <> 0 THEN prev END AS prev_url,
  CASE WHEN url % 17 = 0 THEN -url - 1 ELSE next END AS next_url FROM raw),
live AS (SELECT * FROM graph WHERE fetch_status = 'ok'),
rec AS (SELECT a.url, a.next_url FROM live a JOIN live b ON a.next_url = b.url AND b.prev_url = a.url)"""
