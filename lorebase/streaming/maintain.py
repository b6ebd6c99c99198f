"""A store that a stream maintains (ST7): it can be stopped anywhere, and goes on where it was.

Rows are held in partitions. A batch reads those it touches, folds its rows in and writes them anew under its own number;
partitions that it doesn't touch aren't read. The list of partitions written, one small file, is what commits a batch: readers
take each partition from the last batch that lists it. A batch sees only what earlier numbers have committed, and a
repeated one overwrites its own folders, so that it makes no difference whether it failed before, while or after it wrote.
Which rows make up a batch is fixed by the stream's own log in the same folder.

    data/batch=N/part=P/    whole partitions after batch N
    changes/batch=N/        (url, added, updated)
    commits/batch=N/        (part)
    state/                  the stream's log and offsets
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.operators import store

_BATCH = T.StructField("batch", T.LongType())


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, _BATCH])
    if not exists(spark, path):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(path)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(part, batch) of all commits."""
    return _batches(spark, f"{path}/commits", T.StructType([T.StructField("part", T.StringType())])).select("part", "batch")


def current(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """The store's rows, with part; as of the batches before a number, if one is given."""
    done = commits(spark, path)
    done = done if before is None else done.where(F.col("batch") < before)
    held = done.groupBy("part").agg(F.max("batch").alias("batch"))
    rows = _batches(spark, f"{path}/data", T.StructType([*schema.fields, T.StructField("part", T.StringType())]))
    return rows.join(held, ["part", "batch"], "left_semi").select(*[f.name for f in schema], "part")


def changes(spark: SparkSession, path: str) -> DataFrame:
    """(url, added, updated) summed over all committed batches."""
    schema = T.StructType.fromDDL("url string, added long, updated long")
    done = commits(spark, path).select("batch").distinct()
    return _batches(spark, f"{path}/changes", schema).join(done, "batch", "left_semi").groupBy("url").agg(F.sum("added").alias("added"), F.sum("updated").alias("updated"))


def maintain(stream: DataFrame, path: str, part: Column, order: str = "seq", fold: Callable[[DataFrame, DataFrame, str], tuple[DataFrame, DataFrame | None]] = store.upsert, after_batch: Callable[[int], None] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Fold what the stream holds now, and no start before has seen, into the store at path; its rows.

    part: the partition of a row, by its key alone. schema: the store's, where it isn't the stream's without the order.
    after_batch is called with a batch's number when it is committed. A fold that counts no changes gives None for them.
    """
    spark = stream.sparkSession
    schema = schema or T.StructType([f for f in stream.schema.fields if f.name != order])
    named = F.concat(F.lit("p-"), F.coalesce(part.cast("string"), F.lit("")))

    def write(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        new = rows.withColumn("part", named)
        dirty = new.select("part").distinct()
        old = current(session, path, schema, batch).join(dirty, "part", "left_semi").select(*[f.name for f in schema])
        after, changed = fold(old, rows, order)
        after.withColumn("part", named).write.mode("overwrite").partitionBy("part").parquet(f"{path}/data/batch={batch}")
        if changed is not None:
            changed.select(F.col("url").cast("string").alias("url"), "added", "updated").write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")
        dirty.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")
        if after_batch:
            after_batch(batch)

    q = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return current(spark, path, schema)


def remove_old(spark: SparkSession, path: str) -> list[int]:
    """Delete the data of batches whose partitions have all been written anew since; their numbers."""
    done = commits(spark, path)
    held = done.groupBy("part").agg(F.max("batch").alias("batch")).select("batch")
    # one row a batch
    old = sorted(r.batch for r in done.select("batch").distinct().join(held, "batch", "left_anti").collect())
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for batch in old:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data/batch={batch}")
        p.getFileSystem(conf).delete(p, True)
    return old
