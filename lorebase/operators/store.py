"""Store maintenance (D1-D5, J3-J5, J9, N5-N7, O5, U1-U4, G11): upserts with precedence, deltas, worklists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.constants import SOURCE_RANK
from lorebase.scratch import segments


def source_rank(source: Column) -> Column:
    out = F.lit(0)
    for name, rank in SOURCE_RANK.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def upsert(store: DataFrame, new: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(store after, changes(url, added, updated)): rows of `new` are applied one after the other by `order`, which is unique for a url.

    A row replaces the stored one if its source ranks higher, or equal with another content hash. So the rank held is the
    highest so far, rows below it do nothing, and of the others one wins if it differs from the one before. All three are
    running windows. They run within ranges of (url, order), whose highest ranks and last rows are then passed on, so a
    url with very many rows is spread over tasks. The winner's other columns are joined by its order.
    """
    columns = [c for c in store.columns]
    base = store.select(*columns).withColumn("_at", F.lit(-1).cast("long"))
    both = base.unionByName(new.select(*columns, F.col(order).cast("long").alias("_at")))
    rows = segments(both.select("url", "_at", source_rank(F.col("source")).alias("rank"), "content_hash"), F.col("url"), F.col("_at"))
    within, before = Window.partitionBy("url", "_p").orderBy("_at"), Window.partitionBy("url").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # what is passed on exists for the few urls that lie in several ranges
    highest = rows.groupBy("url", "_p").agg(F.max("rank").alias("m")).select("url", "_p", F.max("m").over(before).alias("held")).where("held is not null")
    ranked = rows.withColumn("_top", F.max("rank").over(within)).join(highest, ["url", "_p"], "left")
    able = ranked.where(F.col("rank") >= F.greatest("_top", F.coalesce("held", "_top"))).select("url", "_p", "_at", F.struct("rank", "content_hash").alias("row"))
    last = able.groupBy("url", "_p").agg(F.max_by("row", "_at").alias("row")).select("url", "_p", F.last("row").over(before).alias("passed")).where("passed is not null")
    old = F.coalesce(F.lag("row").over(within), F.col("passed"))
    won = able.join(last, ["url", "_p"], "left").withColumn("old", old).where(F.col("old").isNull() | ~F.col("row").eqNullSafe(F.col("old")))
    folded = won.groupBy("url").agg(F.max("_at").alias("_at"), (F.min("_at") >= 0).cast("long").alias("added"), (F.count("*") - 1).alias("updated"))
    after = both.join(folded.select("url", "_at"), ["url", "_at"]).select(*columns)
    return after, folded.select("url", "added", "updated")


def route(records: DataFrame, default: str = "gl") -> DataFrame:
    """Records without a category go to the default one."""
    return records.withColumn("category", F.when(F.coalesce("category", F.lit("")) == "", default).otherwise(F.col("category")))


def index_delta(records: DataFrame, old: DataFrame) -> DataFrame:
    """(url, action): reuse, embed or drop, by url and content hash."""
    o = old.select("url", F.col("content_hash").alias("old_hash"))
    both = records.select("url", "content_hash").join(o, "url", "full_outer")
    return both.select("url", F.when(F.col("content_hash").isNull(), "drop").when(F.col("content_hash") == F.col("old_hash"), "reuse").otherwise("embed").alias("action"))


def pending(catalog: DataFrame, complete: DataFrame) -> DataFrame:
    """Live catalogue urls that are not complete yet."""
    return catalog.where(F.coalesce("fetch_status", F.lit("ok")) == "ok").join(complete.select("url"), "url", "left_anti")


def complete_in_catalogue(catalog: DataFrame, complete: DataFrame) -> DataFrame:
    return catalog.join(complete.select("url"), "url", "left_semi")


def worklist(catalog: DataFrame, metadata: DataFrame, limit: int | None = None, forward: bool = False) -> DataFrame:
    """Pending urls oldest first (or newest first), where a url without metadata has an empty date."""
    dated = catalog.join(metadata.select("url", "upload_date"), "url", "left").withColumn("upload_date", F.coalesce("upload_date", F.lit("")))
    ordered = dated.orderBy(F.desc("upload_date"), F.desc("url")) if forward else dated.orderBy("upload_date", "url")
    return ordered.limit(limit) if limit else ordered


def seed_ledger(urls: DataFrame, ledger: DataFrame) -> DataFrame:
    """New nodes take what the ledger holds of them."""
    held = ledger.select("url", F.col("has_meta").alias("_meta"), F.col("fetch_status").alias("_status"))
    return urls.join(held, "url", "left").withColumn("has_meta", F.coalesce("_meta", "has_meta")).withColumn("fetch_status", F.coalesce("_status", "fetch_status")).drop("_meta", "_status")


def overwrite_ledger(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones; an empty list of recommendations keeps the old one."""
    old = ledger.select("url", F.col("rec_urls").alias("_recs"))
    merged = new.join(old, "url", "left").withColumn("rec_urls", F.when(F.size(F.coalesce("rec_urls", F.array().cast("array<string>"))) > 0, F.col("rec_urls")).otherwise(F.coalesce("_recs", F.array().cast("array<string>")))).drop("_recs")
    return ledger.join(new.select("url"), "url", "left_anti").unionByName(merged.select(*ledger.columns))


def missing_previous(nodes: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Rows whose previous url is named but not held, by the store or by the rows themselves."""
    held = (nodes if store is None else store).select(F.col("url").alias("_u"))
    return nodes.where(F.coalesce(F.col("prev_url").cast("string"), F.lit("")) != "").join(held, F.col("prev_url") == F.col("_u"), "left_anti")


def recent(commands: DataFrame, n: int) -> DataFrame:
    """The last use of each command, most recent first."""
    return commands.groupBy("command").agg(F.max("seq").alias("seq")).orderBy(F.desc("seq")).limit(n)


def removed_files(known: DataFrame, current: DataFrame) -> DataFrame:
    return known.select("path").exceptAll(current.select("path"))


def oldest_and_sample(rows: DataFrame, oldest: int, sample: int, seed: int, by: str | None = None) -> DataFrame:
    """The oldest rows and a sample of the rest, overall or for each group: the least SHA-1 of seed and url.

    The draw depends on the url alone, so it is the same in every layout of the files.
    """
    drawn = F.sha1(F.encode(F.concat_ws(":", F.lit(str(seed)), F.col("url").cast("string")), "UTF-8"))
    if by is None:
        first = rows.orderBy("upload_date", "url").limit(oldest)
        rest = rows.join(first.select("url"), "url", "left_anti").orderBy(drawn, "url").limit(sample)
        return first.unionByName(rest)
    order = F.row_number().over(Window.partitionBy(by).orderBy("upload_date", "url"))
    ranked = rows.withColumn("_k", order).withColumn("_old", F.col("_k") <= oldest).withColumn("_r", drawn)
    ranked = ranked.withColumn("_s", F.row_number().over(Window.partitionBy(by, "_old").orderBy("_r", "url")))
    return ranked.where(F.col("_old") | (F.col("_s") <= sample)).drop("_k", "_old", "_r", "_s")
