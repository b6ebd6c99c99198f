"""The folder for intermediate tables, which driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one, in local mode alone.

    A cluster without the setting is an error: executors would each write to a disk of their own, and reading back
    would lose rows.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lorebase-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder: plans and lineage start anew behind it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def segments(rows: DataFrame, *order: Column) -> DataFrame:
    """rows dealt to ranges of that order, with the number of their range, _p.

    A key that leads the order has its rows in neighbouring ranges, however many they are, so what is grouped by the
    key and _p is never larger than a range.
    """
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    return cut(rows.select("*", *keys).repartitionByRange(*names).drop(*names).withColumn("_p", F.spark_partition_id()))
