"""A corpus pipeline of five stages over documents; each is written as Parquet and read again by the next.

    language_id        documents without a language, or too far from all of them, go
    line_dedup         lines that repeat an earlier line go; a document of which nothing is left goes
    near_duplicates    of each group of near duplicates (5 words, 0.8) the smallest doc_id stays
    decontaminate      documents that hold a benchmark item go
    sentencepiece      texts become token ids; those that don't decode to their text would show in round_trip

All but the last return the columns of documents, extra ones with them, whatever their names. A document with a null doc_id passes the stages
that compare documents unchanged, since no other can be ordered before or after it. Null and wordless texts have no
language and go in the first stage; an empty table runs through and gives no rows. Rows are written between stages, so
a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import decontaminate, langid, line_dedup, ngram_join, sentencepiece_codec
from lorebase.llm.common import fresh, new_path, quoted, save


def aside(docs: DataFrame, *made: str) -> tuple[DataFrame, list[Column]]:
    """docs whose columns called like those that an operator makes bear other names; the columns under their own."""
    moved = {}
    for c in docs.columns:
        if c.lower() in made:
            moved[c] = fresh(f"_{c}", [*docs.columns, *moved.values(), *made])
    back = [column.alias(c) for c, column in zip(docs.columns, quoted([moved.get(c, c) for c in docs.columns]), strict=True)]
    return docs.withColumnsRenamed(moved), back


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = aside(docs, "lang_pred", "score", "rejected")
    return langid.predict(docs, langid.learn(docs)).where("not rejected").select(*back)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whatever has kept a word stays, and so does what had none before."""
    docs, back = aside(docs, "n_lines", "n_removed")
    out = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.regexp("text", F.lit(r"[^\x20\x09-\x0D]"))
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*back)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest doc_id of each group stays; of rows that repeat its doc_id, all with its set."""
    groups = ngram_join.ngram_jaccard_groups(docs, k=5, num=80, den=100)
    by_id = groups.groupBy("doc_id").agg(F.collect_set(F.when(F.col("doc_id") != F.col("component_id"), F.col("class_id"))).alias("sets"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    go = save(by_id.where(F.size("sets") > 0), "go")
    # rows without a doc_id have no partner, and would all be dealt to one task
    left = docs.where("doc_id is not null").join(go.where("not stays").select("doc_id"), "doc_id", "left_anti").select(*quoted(docs.columns)).unionByName(docs.where("doc_id is null"))
    # a doc_id of which some sets go and others stay: only then do rows need their set
    some = go.where("stays").select("doc_id", "sets")
    return left if some.isEmpty() else ngram_join.without_sets(left, some, 5).select(*quoted(docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, back = aside(docs, "item_ids", "distances")
    found = decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("item_ids") == 0).select(*back)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the executors have been through four stages: fewer words are kept than by the operator alone
    return sentencepiece_codec.encode(docs, cache=150_000).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("sentencepiece", token_stage),
]

#: SQL can't express the language model or the merge order; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
