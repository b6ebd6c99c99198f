"""Streaming forms of watcher, bookmarks, progress lines and windowed counts (ST1, ST2, ST7, ST8).

State is keyed and lives in Spark's state store, but for bookmarks, which are a maintained store of their own; results go to
files batch by batch, with the batch number, so a batch that is repeated after a failure replaces its own rows, and a named
folder lets a later start go on. Watermarked windows are our addition for event tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorebase.operators import user
from lorebase.scratch import scratch_dir

from .maintain import exists, maintain


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}/{name}"


def run_to_files(stream: DataFrame, mode: str, at: str | None = None) -> DataFrame:
    """Process what is there now; the rows given out, with batch.

    at: a folder that keeps log, state and rows. A later start with the same one goes on from there and gives the rows of all
    starts; a batch that was cut off is done again and overwrites what it had written. Without it, a new folder.
    """
    spark = stream.sparkSession
    out, state = (f"{at}/out", f"{at}/state") if at else (_folder(spark, "out"), _folder(spark, "state"))

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    if not exists(spark, out):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", out).parquet(out)


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """events as a stream of files; the event time becomes a TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        # a stream reads folders: the one of a single file, narrowed to that file
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of closed windows; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


MARK = "user string, url string, position int, line int, anchor_version int, title string, total int, updated string, seq long"


def fold_mark(mark: tuple | None, e) -> tuple:
    """One event on (position, line, anchor_version, title, total, updated, seq), by the rule of operators.user.bookmarks."""
    some = lambda v, f=lambda x: x: None if v is None or v != v else f(v)
    at, line, version = max(0, int(e.position)), some(e.line, lambda v: max(0, int(v))), some(e.anchor_version, int)
    version = 2 if version is None else version
    p, ln, av, title, total, updated, _ = mark or (None,) * 7
    here, there = (at, -1 if line is None else line), (p or 0, -1 if ln is None else ln)
    if mark is None or bool(some(e.force)) or here > there or line is not None and at == (p or 0) and version > (1 if av is None else av):
        p, ln, av = at, line, None if line is None else max(1, version)
    last = lambda new, old: old if some(new) is None else new
    return p, ln, av, last(e.title, title), last(some(e.total, int), total), last(e.updated, updated), int(e.seq)


def bookmark_stream(events: DataFrame, at: str | None = None, parts: int = 32) -> DataFrame:
    """Marks after all that a stream of events(user, url, position, line, anchor_version, force, title, total, updated, seq) holds now.

    A batch's events are folded onto the marks so far by operators.user.bookmarks_after, whose cost goes by events and not
    by keys. The marks are a maintained store in parts by user; a later start with the same folder at goes on from there.
    """

    def fold(old: DataFrame, rows: DataFrame, _: str) -> tuple[DataFrame, None]:
        return user.bookmarks_after(old, rows).repartition(parts, part), None

    part = F.pmod(F.xxhash64("user"), F.lit(parts))
    return maintain(events, at or _folder(events.sparkSession, "marks"), part, fold=fold, schema=T.StructType.fromDDL(MARK)).drop("part")


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last state that was given out for each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("r")).select(*keys, "r.*")


def stable_files(scans: DataFrame) -> DataFrame:
    """From a stream of scans(path, bytes, modified, poll): a file once it is unchanged for one poll.

    A path that a scan misses is forgotten, so a file that comes back is given out again.
    """
    schema = "path string, bytes long, modified string, poll long"

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, modified, poll, told = state.get if state.exists else (None, None, None, False)
        out = []
        for r in pd.concat(list(rows)).sort_values("poll").itertuples(index=False):
            if poll is None or r.poll > poll + 1:
                size, modified, told = None, None, False
            same = size == r.bytes and modified == r.modified
            if same and not told:
                out.append((key[0], r.bytes, r.modified, r.poll))
            size, modified, poll, told = int(r.bytes), r.modified, int(r.poll), same
        state.update((size, modified, poll, told))
        yield pd.DataFrame(out, columns=["path", "bytes", "modified", "poll"])

    return scans.groupBy("path").applyInPandasWithState(step, schema, "bytes long, modified string, poll long, told boolean", "update", GroupStateTimeout.NoTimeout)


def stable_files_batch(scans: DataFrame) -> DataFrame:
    """The same over a finished log of scans."""
    from pyspark.sql import Window

    by = Window.partitionBy("path").orderBy("poll")
    prev = lambda c: F.lag(c).over(by)
    s = scans.withColumn("same", F.coalesce((prev("poll") == F.col("poll") - 1) & (prev("bytes") == F.col("bytes")) & (prev("modified") == F.col("modified")), F.lit(False)))
    return s.withColumn("before", F.coalesce(F.lag("same").over(by), F.lit(False))).where("same and not before").select("path", "bytes", "modified", "poll")


def progress_lines(lines: DataFrame, minutes: int = 15) -> DataFrame:
    """Latest (done, total) of jobs from a stream of lines(job, ts, line) like '[ 3/12]'; finished jobs expire in event time."""
    schema = "job string, done int, total int, expired boolean"
    parsed = lines.select("job", F.regexp_extract("line", r"\[\s*(\d+)/(\d+)\]", 1).try_cast("int").alias("done"), F.regexp_extract("line", r"\[\s*(\d+)/(\d+)\]", 2).try_cast("int").alias("total"), F.col("ts").cast("timestamp").alias("ts")).where("done is not null").withWatermark("ts", "1 minute")

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            done, total = state.get
            state.remove()
            yield pd.DataFrame([(key[0], done, total, True)], columns=["job", "done", "total", "expired"])
            return
        last = pd.concat(list(rows)).sort_values("ts").iloc[-1]
        state.update((int(last.done), int(last.total)))
        if last.done >= last.total:
            state.setTimeoutTimestamp(max(int(last.ts.timestamp() * 1000), state.getCurrentWatermarkMs()) + minutes * 60_000)
        yield pd.DataFrame([(key[0], int(last.done), int(last.total), False)], columns=["job", "done", "total", "expired"])

    return parsed.groupBy("job").applyInPandasWithState(step, schema, "done int, total int", "update", GroupStateTimeout.EventTimeTimeout)
