"""Reader state (ST2-ST6, J10-J14, O6, O7): bookmarks, shelf, settings, dictionary look-ups, as folds over event logs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.scratch import segments

#: The settings that are kept.
SETTING_KEYS = ("theme", "pinyin", "synopsisPinyin", "fontSize", "leading", "tracking", "measure", "contrast", "infiniteScroll")


def place_fold(keys: int):
    """Over rows (keys, line, anchor_version) in order of their keys: the last (line, anchor_version) of each.

    The first row of a key sets the place. A later one takes it with a further line, or a line of a newer anchor. One
    state is held, whatever the number of rows; a key may go on in the next batch.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, line, version, kind = None, None, None, None

        def given(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), kind, strict=True)], schema=kind)

        for b in it:
            kind, done = b.schema, []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new, (at, v) = row[:keys], row[keys:]
                if key is None or new != key:
                    if key is not None:
                        done.append((*key, line, version))
                    key, moves = new, True
                else:
                    moves = at is not None and (at > (-1 if line is None else line) or v > (1 if version is None else version))
                if moves:
                    line, version = at, None if at is None else max(1, v)
            if done:
                yield given(done)
        if key is not None:
            yield given([(*key, line, version)])

    return run


def _fold_log(log: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Marks after a log, with the last seq.

    An event moves the mark forwards, to a newer anchor's line at the same place, or anywhere if forced. So what counts are
    the events from the last forced one on, and among them those at the furthest position. Both are found within ranges
    of (keys, order), so no task or array holds all events of a key. Only lines at that one position, whose outcome depends
    on every step, are folded in order, row by row from sorted batches.
    """
    item = F.struct("seq", "position", "line", F.coalesce("anchor_version", F.lit(2)).alias("anchor_version"), F.coalesce("force", F.lit(False)).alias("force"), "title", "total", "updated")
    # keys are equal as structs, in which null is equal to null, so a key with nulls is one as others
    key = F.struct(*keys).alias("_k")
    rows = segments(log.select(key, item.alias("e")), F.col("_k"), F.col("e.seq"))
    part, whole = ["_k", "_p"], Window.partitionBy("_k")
    some = lambda c: F.max_by(f"e.{c}", F.when(F.col(f"e.{c}").isNotNull(), F.col("e"))).alias(c)
    texts = rows.groupBy("_k").agg(*map(some, ("title", "total", "updated")), F.max("e.seq").alias("seq"))
    # keys without a forced event have no start, and those that lie in one range have nothing to compare
    start = rows.groupBy(*part).agg(F.max(F.when(F.col("e.force"), F.col("e"))).alias("m")).select(*part, F.max("m").over(whole).alias("start")).where("start is not null")
    at = F.greatest(F.lit(0), F.col("e.position"))
    later = rows.join(start, part, "left").where("start is null or e >= start").select(*part, "e", at.alias("position"))
    top = later.groupBy(*part).agg(F.max("position").alias("m")).select(*part, F.max("m").over(whole).alias("top"), F.count("*").over(whole).alias("n")).where("n > 1")
    own = F.max("position").over(Window.partitionBy(*part))
    line = F.when(F.col("e.line").isNotNull(), F.greatest(F.lit(0), F.col("e.line")))
    there = later.withColumn("own", own).join(top, part, "left").where("position = coalesce(top, own)").select("_k", "position", line.cast("int").alias("line"), F.col("e.anchor_version").cast("int").alias("anchor_version"), "e")
    there = there.repartition("_k").sortWithinPartitions("_k", "e").select("_k.*", F.col("position").cast("int").alias("position"), "line", "anchor_version")
    # the position is the same in all rows of a key, and so is part of it here
    given = T.StructType([T.StructField(f.name, f.dataType) for f in there.schema])
    places = there.mapInArrow(place_fold(len(keys) + 1), given).select(key, "position", "line", "anchor_version")
    return places.join(texts, "_k").select("_k.*", "position", "line", "anchor_version", "title", F.col("total").cast("int").alias("total"), "updated", "seq")


def bookmarks(log: DataFrame, keys: tuple[str, ...] = ("user", "url")) -> DataFrame:
    """Marks after log(user, url, seq, position, line, anchor_version, force, title, total, updated).

    For plain logs without force and anchors the maximum is the same, see furthest().
    """
    return _fold_log(log, keys).drop("seq")


def bookmarks_after(marks: DataFrame, log: DataFrame, keys: tuple[str, ...] = ("user", "url")) -> DataFrame:
    """Marks, with the last seq, after a log that goes on from marks of the same columns, whatever their seq.

    A mark is what a forced event at its place would leave, and so it is put before the log as one.
    """
    at = lambda new: F.struct(F.lit(new).alias("new"), F.col("seq").cast("long").alias("seq")).alias("seq")
    row = lambda df, new, force: df.select(*keys, at(new), "position", "line", "anchor_version", force.alias("force"), "title", "total", "updated")
    both = row(marks, False, F.lit(True)).unionByName(row(log, True, F.col("force")))
    return _fold_log(both, keys).withColumn("seq", F.col("seq.seq"))


def furthest(log: DataFrame, keys: tuple[str, ...] = ("user", "url")) -> DataFrame:
    return log.groupBy(*keys).agg(F.max(F.struct("position", F.coalesce("line", F.lit(-1)).alias("line"))).alias("m")).select(*keys, "m.position", F.nullif(F.col("m.line"), F.lit(-1)).alias("line"))


def cli_bookmarks(log: DataFrame, keys: tuple[str, ...] = ("user", "url")) -> DataFrame:
    """Last write wins, not below 0; a cleared mark (null position) is gone."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct("position"), "seq").alias("m"))
    return last.where("m.position is not null").select(*keys, F.greatest(F.lit(0), F.col("m.position")).alias("position"))


def clamp_progress(marks: DataFrame) -> DataFrame:
    """Positions within total; a line is kept only with an unclamped position."""
    top = F.greatest(F.lit(0), F.col("total") - 1)
    over = F.col("total").isNotNull() & (F.col("position") > top)
    return marks.withColumn("line", F.when(~over, F.col("line"))).withColumn("position", F.when(over, top).otherwise(F.col("position")))


def shelf_state(log: DataFrame) -> DataFrame:
    """(user, id, on_shelf, removed, first fields) after log(user, id, op add|remove, url, title, kind, seq).

    Since the last remove the first add holds; a remove leaves a tombstone that the next add clears.
    """
    g = log.groupBy("user", "id").agg(F.max(F.when(F.col("op") == "remove", F.col("seq"))).alias("gone"))
    later = log.join(g, ["user", "id"]).where((F.col("op") == "add") & (F.col("gone").isNull() | (F.col("seq") > F.col("gone"))))
    first = later.groupBy("user", "id").agg(F.min_by(F.struct("url", "title", "kind", F.col("seq").alias("added")), "seq").alias("f"))
    return g.join(first, ["user", "id"], "left").select("user", "id", F.col("f").isNotNull().alias("on_shelf"), F.col("f").isNull().alias("removed"), "f.url", "f.title", "f.kind", "f.added")


def shelf(items: DataFrame, progress: DataFrame, removed: DataFrame) -> DataFrame:
    """(user, id, origin): the shelf's items, and what was read, is not on it and was not removed."""
    keys = ["user", "id"]
    read = progress.select(*keys).join(removed.select(*keys), keys, "left_anti").join(items.select(*keys), keys, "left_anti")
    return items.select(*keys, F.lit("shelf").alias("origin")).unionByName(read.select(*keys, F.lit("progress").alias("origin")))


def shelf_rows(entries: DataFrame, items: DataFrame, records: DataFrame, progress: DataFrame) -> DataFrame:
    """Entries with record and progress, the latest first."""
    keys = ["user", "id"]
    out = entries.join(items.select(*keys, "added"), keys, "left").join(progress.select(*keys, "position", "total", "updated"), keys, "left").join(records.select("id", "title", "author", "category"), "id", "left")
    return out.withColumn("at", F.coalesce(F.nullif(F.col("updated"), F.lit("")), "added")).orderBy(F.desc_nulls_last("at"), "user", "id")


def reading_list(progress: DataFrame, records: DataFrame) -> DataFrame:
    return progress.join(records.select("url", "title", "author", "category"), "url", "left").orderBy(F.desc("updated"), "url")


def merge_settings(old: DataFrame, put: DataFrame) -> DataFrame:
    """(user, desktop, mobile): a put replaces its profile with the allowed keys; a legacy blob is the desktop profile."""
    allowed = F.array(*map(F.lit, SETTING_KEYS))
    clean = lambda m: F.map_filter(m, lambda k, _: F.array_contains(allowed, k))
    last = lambda p: F.max_by("values", F.when(F.col("profile") == p, F.col("seq"))).alias(p)
    new = put.withColumn("profile", F.coalesce("profile", F.lit("desktop"))).groupBy("user").agg(last("desktop"), last("mobile"))
    joined = old.select("user", F.col("desktop").alias("d"), F.col("mobile").alias("m")).join(new, "user", "full_outer")
    none = F.create_map().cast("map<string,string>")
    pick = lambda a, b: clean(F.coalesce(a, b, none))
    return joined.select("user", pick("desktop", "d").alias("desktop"), pick("mobile", "m").alias("mobile"))


def define(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, entries, per_char): entries in file order; characters where a word has several or no entry."""
    entry = F.array_sort(F.collect_list(F.struct("order", "pinyin", "defs"))).alias("entries")
    by_word = words.select("word").distinct().join(dictionary, "word", "left").groupBy("word").agg(F.filter(entry, lambda e: e["order"].isNotNull()).alias("entries"))
    chars = by_word.where((F.length("word") > 1) | (F.size("entries") == 0)).select("word", F.posexplode(F.split("word", "")).alias("i", "char"))
    first = dictionary.where(F.length("word") == 1).groupBy(F.col("word").alias("char")).agg(F.min_by(F.struct("pinyin", "defs"), "order").alias("e"))
    per = chars.join(first, "char").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "char", "e"))).alias("p"))
    return by_word.join(per, "word", "left").select("word", F.transform("entries", lambda e: F.struct(e["pinyin"], e["defs"])).alias("entries"), F.coalesce(F.transform("p", lambda x: F.struct(x["char"].alias("char"), x["e"]["pinyin"].alias("pinyin"), x["e"]["defs"].alias("defs"))), F.array().cast("array<struct<char:string,pinyin:string,defs:array<string>>>")).alias("per_char"))
