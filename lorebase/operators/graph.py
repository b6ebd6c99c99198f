"""Link graph (G1-G11): boundaries, chains by pointer jumping, merged display chains, reach over both kinds of links, gaps.

Chains double their reach in every round, so a chain of n nodes takes about log2 n joins; each round's table is
checkpointed, so lineage and plans don't grow. Only flags are read on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.constants import PROBE_STOP, REC_DEPTH
from lorebase.scratch import cut as _cut


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with a running number from 1 in that order: ranges are numbered apart, their sizes alone are summed in one task."""
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    cols = [f"_o{i}" for i in range(len(order))]
    ranged = _cut(rows.select("*", *keys).repartitionByRange(*cols).withColumn("_p", F.spark_partition_id()))
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*cols))
    before = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("_p").agg(F.count("*").alias("_c")).select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.withColumn("_k", within).join(offsets, "_p").withColumn(name, (F.col("_before") + F.col("_k")).cast("int")).drop("_p", "_k", "_before", *cols)


def _live() -> Column:
    return F.coalesce("fetch_status", F.lit("ok")) == "ok"


def reciprocal_edges(nodes: DataFrame) -> DataFrame:
    """(url, next_url) where both ends are live and point at each other."""
    live = nodes.where(_live())
    back = live.select(F.col("url").alias("next_url"), F.col("prev_url").alias("url"))
    return live.select("url", "next_url").join(back, ["url", "next_url"])


def boundaries(nodes: DataFrame, direction: str) -> DataFrame:
    """(url, kind, target_url) of each live node towards prev or next."""
    field, reverse = ("prev_url", "next_url") if direction == "prev" else ("next_url", "prev_url")
    target = nodes.select(F.col("url").alias("target_url"), _live().alias("t_live"), F.col(reverse).alias("back"), F.lit(True).alias("held"))
    out = nodes.where(_live()).select("url", F.nullif(F.col(field), F.lit("")).alias("target_url") if dict(nodes.dtypes)[field] == "string" else F.col(field).alias("target_url")).join(target, "target_url", "left")
    kind = (
        F.when(F.col("target_url").isNull(), "chain_end")
        .when(F.col("held").isNull(), "missing_from_catalogue")
        .when(~F.col("t_live"), "confirmed_404")
        .when(~F.col("back").eqNullSafe(F.col("url")), "non_reciprocal")
        .otherwise("connected")
    )
    return out.select("url", kind.alias("kind"), "target_url")


def _jump(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (url, prev or null): (url, root, pos) of paths, and (url, anchor key material) rows of cycles.

    Rows carry the furthest known ancestor, the distance to it and the least (date, url) on the way.
    """
    t = _cut(first.select("url", F.coalesce("prev", "url").alias("up"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("pos"), F.col("prev").isNull().alias("done"), F.struct("upload_date", "url").alias("low")))
    rounds, n = 0, t.count()
    while 2**rounds <= max(1, n):
        if t.where("not done").limit(1).isEmpty():
            break
        up = t.select(F.col("url").alias("up"), F.col("up").alias("up2"), F.col("pos").alias("pos2"), F.col("done").alias("done2"), F.col("low").alias("low2"))
        stay = t.where("done")
        go = t.where("not done").join(up, "up").select("url", F.col("up2").alias("up"), (F.col("pos") + F.col("pos2")).alias("pos"), F.col("done2").alias("done"), F.least("low", "low2").alias("low"))
        t, rounds = _cut(stay.unionByName(go)), rounds + 1
    return t.where("done").select("url", F.col("up").alias("root"), "pos"), t.where("not done").select("url", "low")


def chain_members(nodes: DataFrame) -> DataFrame:
    """(url, root, pos, is_cycle): maximal paths over reciprocal edges; cycles start at their least (upload_date, url)."""
    live = nodes.where(_live()).select("url", F.coalesce(F.col("upload_date").cast("string"), F.lit("")).alias("upload_date"))
    edges = reciprocal_edges(nodes)
    prev = edges.select(F.col("next_url").alias("url"), F.col("url").alias("prev"))
    first = _cut(live.join(prev, "url", "left"))
    paths, cycles = _jump(first)
    out = paths.withColumn("is_cycle", F.lit(False))
    if not cycles.limit(1).isEmpty():
        # a cycle is opened before its anchor and walked like a path
        anchors = cycles.select(F.col("low.url").alias("url")).distinct().withColumn("anchor", F.lit(True))
        opened = first.join(cycles.select("url"), "url", "left_semi").join(anchors, "url", "left").withColumn("prev", F.when(F.col("anchor").isNull(), F.col("prev")))
        walked, _ = _jump(opened.select("url", "upload_date", "prev"))
        out = out.unionByName(walked.withColumn("is_cycle", F.lit(True)))
    return out


def chains(nodes: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row a chain: chain_number, novel_count, is_cycle, start and end with their boundaries, ordered urls."""
    m = (chain_members(nodes) if members is None else members).join(nodes.select("url", F.coalesce(F.col("upload_date").cast("string"), F.lit("")).alias("upload_date")), "url")
    c = m.groupBy("root").agg(F.count("*").alias("novel_count"), F.first("is_cycle").alias("is_cycle"), F.min_by(F.struct("url", "upload_date"), "pos").alias("start"), F.max_by(F.struct("url", "upload_date"), "pos").alias("end"), F.array_sort(F.collect_list(F.struct("pos", "url"))).alias("path"))

    def bound(side: str, end: str, other: str) -> tuple[DataFrame, Column]:
        b = boundaries(nodes, side).select(F.col("url").alias(f"{end}_url"), F.struct("kind", "target_url").alias(f"{end}_b"))
        cyc = F.struct(F.lit("cycle").alias("kind"), F.col(f"{other}.url").alias("target_url"))
        return b, F.when(F.col("is_cycle"), cyc).otherwise(F.col(f"{end}_b")).alias(f"{end}_boundary")

    (sb, sc), (eb, ec) = bound("prev", "start", "end"), bound("next", "end", "start")
    c = c.withColumn("start_url", F.col("start.url")).withColumn("end_url", F.col("end.url")).join(sb, "start_url", "left").join(eb, "end_url", "left")
    c = numbered(c, "chain_number", F.col("start.upload_date"), F.col("start.url"))
    return c.select("chain_number", "novel_count", "is_cycle", "start", "end", sc, ec, F.transform("path", lambda p: p["url"]).alias("urls"))


def display_chains(strict: DataFrame) -> DataFrame:
    """(display_number, start_url, n_chains, novel_count, parts): strict chains joined across one shared 404 or mismatch.

    A chain's end joins the start that shares its (kind, target) if exactly one does and it is another chain; of several
    ends for one start the first in chain order wins. Cycles of such joins start at their first chain.
    """
    kinds = ("confirmed_404", "non_reciprocal")
    s = _cut(strict.select("chain_number", "novel_count", "start", "start_boundary", "end_boundary"))
    starts = s.where(F.col("start_boundary.kind").isin(*kinds) & F.col("start_boundary.target_url").isNotNull()).groupBy(F.col("start_boundary.kind").alias("kind"), F.col("start_boundary.target_url").alias("target")).agg(F.count("*").alias("n"), F.min("chain_number").alias("to"))
    ends = s.where(F.col("end_boundary.kind").isin(*kinds)).select("chain_number", F.col("end_boundary.kind").alias("kind"), F.col("end_boundary.target_url").alias("target"))
    joins = ends.join(starts.where("n = 1"), ["kind", "target"]).where("to <> chain_number").groupBy("to").agg(F.min("chain_number").alias("from"))
    first = s.join(joins.select(F.col("to").alias("chain_number"), F.col("from").alias("prev")), "chain_number", "left").select(F.col("chain_number").alias("url"), F.lit("").alias("upload_date"), "prev")
    first = _cut(first)
    paths, rings = _jump(first)
    if not rings.limit(1).isEmpty():
        anchors = rings.select(F.col("low.url").alias("url")).distinct().withColumn("anchor", F.lit(True))
        opened = first.join(rings.select("url"), "url", "left_semi").join(anchors, "url", "left").withColumn("prev", F.when(F.col("anchor").isNull(), F.col("prev")))
        paths = paths.unionByName(_jump(opened.select("url", "upload_date", "prev"))[0])
    parts = paths.join(s.select(F.col("chain_number").alias("url"), "novel_count", "start"), "url").groupBy("root").agg(F.count("*").alias("n_chains"), F.sum("novel_count").alias("novel_count"), F.min_by("start", "pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", F.col("url").alias("chain")))).alias("p"))
    return numbered(parts, "display_number", F.col("start.upload_date"), F.col("start.url")).select("display_number", F.col("start.url").alias("start_url"), "n_chains", "novel_count", F.transform("p", lambda x: x["chain"]).alias("parts"))


def chain_counters(strict: DataFrame) -> DataFrame:
    kind = lambda side, k: F.count_if(F.col(f"{side}_boundary.kind") == k)
    return strict.agg(
        F.count("*").alias("chains"), F.coalesce(F.sum("novel_count"), F.lit(0)).alias("novels"), F.count_if("is_cycle").alias("cycles"), F.count_if(F.col("novel_count") == 1).alias("singles"), F.max("novel_count").alias("longest"),
        *[kind(side, k).alias(f"{side}_{k}") for side in ("start", "end") for k in ("chain_end", "missing_from_catalogue", "confirmed_404", "non_reciprocal")],
    )


def frontier(nodes: DataFrame, seeds: DataFrame, depth: int = REC_DEPTH) -> DataFrame:
    """(url, depth, via) of all that seeds(url) lead to: a chain link costs nothing and starts anew at 0, a recommendation 1.

    A url counts with its least depth, so a cheaper way opens again what a dearer one has reached, and the order in which
    urls are met changes nothing. Recommendations go `depth` deep. via: seed, chain (by a link) or rec.

    Nodes whose prev and next links answer each other reach one another at no cost: they are contracted to groups by
    pointer jumping first, so a long chain is one step. Rounds are as many as groups on the longest way; each joins
    only the groups whose depth fell with their edges. Urls without a row of their own are reached and lead nowhere.
    """
    links = F.array_compact(F.array("prev_url", "next_url"))
    plain = nodes.select("url", "prev_url", "next_url", F.lit("ok").alias("fetch_status"), F.lit(None).cast("string").alias("upload_date"))
    members = chain_members(plain).select("url", F.col("root").alias("group"))
    linked = members.groupBy("group").agg((F.count("*") > 1).alias("linked"))
    members = _cut(members.join(linked, "group"))
    steps = nodes.select("url", F.explode(links).alias("to")).withColumn("chain", F.lit(True))
    steps = steps.unionByName(nodes.select("url", F.explode("rec_urls").alias("to")).withColumn("chain", F.lit(False)))
    place = members.select(F.col("url").alias("to"), F.col("group").alias("to_group"), "linked")
    edges = steps.where(F.col("to").cast("string") != "").join(members.select("url", "group"), "url").join(place, "to", "left").select("group", F.coalesce("to_group", "to").alias("to"), F.coalesce("linked", F.lit(False)).alias("linked"), "chain")
    # within a group nothing is to be gained, but a node that names itself is reached by a link
    edges = _cut(edges.where((F.col("group") != F.col("to")) | (F.col("chain") & ~F.col("linked"))).groupBy("group", "to", "linked").agg(F.bool_or("chain").alias("chain")))
    start = seeds.select("url").distinct()
    front = seen = _cut(start.join(members.select("url", "group"), "url", "left").select(F.coalesce("group", "url").alias("group")).distinct().withColumn("depth", F.lit(0)))
    while not front.isEmpty():
        step = front.join(edges, "group").withColumn("deep", F.when(F.col("chain"), 0).otherwise(F.col("depth") + 1)).where(F.col("deep") <= depth)
        best = step.groupBy(F.col("to").alias("group")).agg(F.min(F.when(F.col("linked"), 0).otherwise(F.col("deep"))).alias("depth"))
        known = seen.select("group", F.col("depth").alias("old"))
        front = _cut(best.join(known, "group", "left").where("old is null or depth < old").select("group", "depth"))
        seen = _cut(seen.join(front.select("group"), "group", "left_anti").unionByName(front))
    rows = seen.join(members.select("url", "group"), "group", "left").select(F.coalesce("url", "group").alias("url"), "depth")
    rows = rows.join(start.withColumn("seed", F.lit(True)), "url", "left")
    return rows.select("url", "depth", F.when(F.col("seed"), "seed").when(F.col("depth") == 0, "chain").otherwise("rec").alias("via"))


def probed_pages(pages: DataFrame, stop: int = PROBE_STOP, key: str = "url") -> DataFrame:
    """Pages(key, page_no from 2) that a probe finds: it ends after `stop` misses in a row, smaller gaps are passed."""
    by = Window.partitionBy(key).orderBy("page_no")
    gap = F.col("page_no") - F.coalesce(F.lag("page_no").over(by), F.lit(1)) > stop
    return pages.withColumn("_cut", F.max(gap.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("_cut = 0").drop("_cut")


def id_gaps(rows: DataFrame, by: str, order: list[str], number: str = "id_num") -> DataFrame:
    """rows with delta to the last number that is not null before it."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("delta", F.col(number) - F.last(number, ignorenulls=True).over(w))
