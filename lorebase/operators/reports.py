"""Reports (A1-A16, J2): grouped counts with a TOTAL row from one rollup, rendered on the driver only for text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.functions import constants as K
from lorebase.functions.scalars import human_size
from lorebase.sources.writers import render_table

TOTAL = "TOTAL"


def with_total(rows: DataFrame, by: str, *aggs: Column) -> DataFrame:
    """One row a group and a TOTAL row; is_total is 1 there. One aggregation, pre-aggregated on the map side."""
    out = rows.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), *aggs)
    return out.withColumn(by, F.when(F.col("is_total") == 1, TOTAL).otherwise(F.col(by)))


def catalogue_report(categories: DataFrame, catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """category, catalogue, live, dead, metadata, downloaded; categories without rows count 0."""
    c = catalog.groupBy("category").agg(F.count("*").alias("catalogue"), F.count_if(F.coalesce("fetch_status", F.lit("ok")) == "ok").alias("live"))
    m = metadata.groupBy("category").agg(F.count("*").alias("metadata"), F.count_if(F.col("file").isNotNull()).alias("downloaded"))
    names = ("catalogue", "live", "metadata", "downloaded")
    rows = categories.select("category").join(c, "category", "left").join(m, "category", "left").na.fill(0, list(names))
    out = with_total(rows, "category", *[F.sum(n).alias(n) for n in names])
    return out.select("category", "is_total", "catalogue", "live", (F.col("catalogue") - F.col("live")).alias("dead"), "metadata", "downloaded")


def size_report(categories: DataFrame, files: DataFrame) -> DataFrame:
    """category, files, bytes, average (0 without files)."""
    rows = categories.select("category").join(files.select("category", "bytes"), "category", "left")
    out = with_total(rows, "category", F.count("bytes").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return out.withColumn("average", F.when(F.col("files") > 0, F.col("bytes") / F.col("files")).otherwise(0.0))


def incomplete_report(categories: DataFrame, files: DataFrame, text: str = "text") -> DataFrame:
    """category, novels with failed pages, failed pages."""
    n = F.when(F.contains(text, F.lit(K.FAILED_TEXT)), F.regexp_count(text, F.lit(r"\[页面获取失败:")))
    rows = categories.select("category").join(files.select("category", n.alias("n")), "category", "left")
    return with_total(rows, "category", F.count("n").alias("novels"), F.coalesce(F.sum("n"), F.lit(0)).alias("failed_pages"))


def incomplete_urls(files: DataFrame, text: str = "text") -> DataFrame:
    """Source urls of files with failed pages: the repair list."""
    found = F.regexp_extract(text, rf"(?m)^{K.SOURCE_LABEL}(.*)$", 1)
    return files.where(F.contains(text, F.lit(K.FAILED_TEXT))).select(F.trim(found).alias("url")).where("url <> ''")


def failed_page_urls(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[页面获取失败: ?([^\]]*)\]"), F.lit(1))


def size_summary(files: DataFrame) -> DataFrame:
    """One row over files(path, bytes): count, total, average, largest and smallest file (first path on ties)."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total"), F.avg("bytes").alias("average"), F.min(F.struct(-F.col("bytes"), "path")).getField("path").alias("largest"), F.min(F.struct("bytes", "path")).getField("path").alias("smallest"))


def size_by_month(files: DataFrame) -> DataFrame:
    return files.groupBy("month").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


#: Answers that end a burst at once, and those that keep it from being clean.
BLOCKED, TROUBLE = ("rate_limited", "challenged"), ("rate_limited", "challenged", "error")
#: Seconds between requests, at least, where all bursts were clean, where some were, and where none was.
SAFE, BACKED_OFF, GIVEN_UP = 1.0, 2.0, 5.0


def until_blocked(requests: DataFrame) -> DataFrame:
    """requests(burst, seq, verdict) up to the first of their burst that was blocked, that one included."""
    ends = requests.where(F.col("verdict").isin(*BLOCKED)).groupBy("burst").agg(F.min("seq").alias("_end"))
    return requests.join(ends, "burst", "left").where("_end is null or seq <= _end").drop("_end")


def burst_stats(requests: DataFrame) -> DataFrame:
    """Per burst, of requests(burst, seq, verdict, latency): counts by verdict, mean latency, whether it was cut short, whether it was clean.

    A burst ends at its first blocked request; clean is one without blocked requests and errors.
    """
    verdicts = ("ok", "rate_limited", "challenged", "not_found", "error")
    any_of = lambda names: F.count_if(F.col("verdict").isin(*names)) > 0
    return until_blocked(requests).groupBy("burst").agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in verdicts], F.avg("latency").alias("mean_latency"), any_of(BLOCKED).alias("aborted"), (~any_of(TROUBLE)).alias("clean"))


def recommended_delay(bursts: DataFrame, *by: str) -> DataFrame:
    """delay: seconds between requests by bursts(step, delay, clean), which are tried in order until one isn't clean.

    All clean: the last one's delay, 1 s at least. Else twice that of the last clean one, 2 s at least; 5 s without one.
    One row, or one for each ramp named by the columns `by`.
    """
    first_bad = F.min(F.when(~F.col("clean"), F.col("step"))).alias("bad")
    tried = bursts.groupBy(*by).agg(first_bad)
    both = bursts.join(tried, list(by)) if by else bursts.crossJoin(F.broadcast(tried))  # one row
    counts = F.col("clean") & (F.col("bad").isNull() | (F.col("step") < F.col("bad")))
    found = both.groupBy(*by).agg(F.max_by(F.when(counts, F.col("delay")), F.when(counts, F.col("step"))).alias("last"), F.max("bad").alias("bad"))
    delay = F.when(F.col("last").isNull(), GIVEN_UP).when(F.col("bad").isNull(), F.greatest("last", F.lit(SAFE))).otherwise(F.greatest(F.col("last") * 2, F.lit(BACKED_OFF)))
    return found.select(*by, delay.cast("double").alias("delay"))


def sum_stats(parts: DataFrame, *names: str) -> DataFrame:
    return parts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def outcome_counts(rows: DataFrame, by: str = "outcome") -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def loss_audit(pages: DataFrame, tolerance: int = 0) -> DataFrame:
    """url, lost characters and pages that lost some, of pages(url, old_chars, new_chars), most first."""
    lost = F.col("new_chars") - F.col("old_chars")
    over = F.when(lost > tolerance, lost)
    return pages.groupBy("url").agg(F.coalesce(F.sum(over), F.lit(0)).alias("lost"), F.count(over).alias("pages_affected")).orderBy(F.desc("lost"), "url")


def page_counters(pages: DataFrame) -> DataFrame:
    """url, total characters, failed and empty pages, whether line breaks were used."""
    return pages.groupBy("url").agg(F.sum("chars").alias("total_chars"), F.count_if("failed").alias("n_failed"), F.count_if((F.col("chars") == 0) & ~F.col("failed")).alias("n_empty"), F.bool_or("has_br").alias("has_br"))


def enriched_catalog(catalog: DataFrame, metadata: DataFrame) -> DataFrame:
    """Titles, authors and dates of the metadata where it has the url."""
    m = metadata.select("url", *[F.col(c).alias(f"_{c}") for c in ("title", "author", "upload_date")])
    out = catalog.join(m, "url", "left")
    for c in ("title", "author", "upload_date"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


def size_table(report: DataFrame) -> str:
    """The size report as text."""
    rows = [list(map(str, r)) for r in report.orderBy("is_total", "category").select("category", F.format_number("files", 0), human_size(F.col("bytes")), human_size(F.col("average"))).collect()]
    return render_table(["Category", "Novels", "Total", "Average"], rows[:-1], rows[-1], "Downloaded library size")


def catalogue_table(report: DataFrame) -> str:
    names = ("catalogue", "live", "dead", "metadata", "downloaded")
    rows = [list(map(str, r)) for r in report.orderBy("is_total", "category").select("category", *[F.format_number(n, 0) for n in names]).collect()]
    return render_table(["Category", "Catalogue", "Live", "404", "Metadata", "Downloaded"], rows[:-1], rows[-1], "Catalogue summary")


def incomplete_table(report: DataFrame) -> str:
    rows = [list(map(str, r)) for r in report.orderBy("is_total", "category").select("category", F.format_number("novels", 0), F.format_number("failed_pages", 0)).collect()]
    return render_table(["Category", "Novels", "Failed pages"], rows[:-1], rows[-1], "Incomplete downloads")


def chain_json(strict: DataFrame) -> DataFrame:
    """(chain_number, json) of each chain: size, ends, boundaries and urls."""
    return strict.select("chain_number", F.to_json(F.struct("chain_number", "novel_count", "is_cycle", "start", "end", "start_boundary", "end_boundary", "urls")).alias("json"))


def chain_table(strict: DataFrame) -> str:
    """The chains as text, a line each; their members stay where they are."""
    ends = [F.col(c) for c in ("novel_count", "start.url", "end.url", "start_boundary.kind", "end_boundary.kind")]
    rows = [list(map(str, r)) for r in strict.orderBy("chain_number").select("chain_number", *ends).toLocalIterator()]
    return render_table(["Chain", "Novels", "Start", "End", "Before", "After"], rows, title="Catalogue chains")
