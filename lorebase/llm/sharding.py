"""Operator 6: a uniform shuffle into shards of exact sizes, planned by a hypergeometric communication matrix.

Law `rows`: shard sizes differ by at most one row. In a uniform random permutation the number of rows that go from
a source partition to a shard is hypergeometric, so these counts are drawn first, partition by partition, from the
sizes alone; then each partition permutes its own rows and deals them out by its line of the matrix, rows are
exchanged, and each shard permutes again. Together this is a uniform permutation with exact shard sizes. Within
a shard the second permutation runs in cells (a uniform draw of cell, then of place in the cell), whose sizes give
the slot offsets: no task ever holds a whole shard, and a source partition holds its narrow rows only.

A source partition is a block of at most 2^20 rows of an input partition. Only the matrix, blocks x shards counts,
is on the driver. The rows are written once as (doc_id, size, crc, row number) before blocks are counted, and all
draws are seeded by block, so that lost executors redo the same work.

Null texts count 0 bytes and have the CRC of the empty string. Rows with null, equal or repeated doc_ids are dealt
like any others: each row has a slot of its own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

SHARDS = 40
#: Rows of a shard that share a cell, on average.
CELL = 50_000
#: A source partition of the matrix is a block of up to 2^20 rows of one input partition.
BLOCK_BITS = 20
#: numpy's own sampler takes populations below this.
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` draws without replacement are good; any population size."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    lo, hi = max(0, sample - bad), min(good, sample)
    mean = sample * good / (good + bad)
    spread = math.sqrt(max(1.0, mean * (bad / (good + bad)) * ((good + bad - sample) / max(1, good + bad - 1))))

    def log_p(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, sample - k, bad - sample + k))

    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (good + bad + 2)))
    top = log_p(mode)
    # ratio of uniforms around the mode, with a box that holds the unimodal, log-concave law
    width = 2 * (spread + 1.5)  # over 1.7155 * sqrt(variance + 0.5) + 0.8989, which suffices
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mode + 0.5 + width * (v - 0.5) / u)
        if lo <= k <= hi and 2 * math.log(u) <= log_p(k) - top:
            return k


def communication_matrix(sizes: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[p, s]: rows of source partition p that go to shard s; column sums differ by at most one."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    left = [total // shards + (s < total % shards) for s in range(shards)]
    out = np.zeros((len(sizes), shards), np.int64)
    for p, n in enumerate(sizes):
        rest = sum(left)
        for s in range(shards):
            k = hypergeometric(rng, left[s], rest - left[s], n) if n and rest else 0
            rest -= left[s]
            out[p, s], left[s], n = k, left[s] - k, n - k
    return out


def _deal(matrix, index, seed: int, cells: int):
    """Permute a source block's rows, give out shards by its line of the matrix, draw cell and order for later."""
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("shard", pa.int32()), ("cell", pa.int32()), ("draw", pa.int64()), ("row", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table, n = table.sort_by("row"), table.num_rows
        p = table.column("row")[0].as_py() >> BLOCK_BITS
        rng, line = np.random.default_rng([seed, p]), matrix.value[index.value[p]]
        shard = rng.permutation(np.repeat(np.arange(len(line), dtype=np.int32), line))
        columns = [table.column(c) for c in ("doc_id", "size", "text_crc32")]
        drawn = [pa.array(shard), pa.array(rng.integers(cells, size=n, dtype=np.int32)), pa.array(rng.integers(2**63 - 1, size=n, dtype=np.int64)), table.column("row")]
        return pa.table([*columns, *drawn], schema=schema)

    return run


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 6) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # the row number, of which the upper bits name a block of one input partition, is fixed by writing it
    narrow = save(sized.withColumn("row", F.monotonically_increasing_id()), "rows").withColumn("p", F.shiftright("row", BLOCK_BITS))
    counts = narrow.groupBy("p").count().orderBy("p").collect()
    index = spark.sparkContext.broadcast({r["p"]: i for i, r in enumerate(counts)})
    sizes = [r["count"] for r in counts]
    matrix = spark.sparkContext.broadcast(communication_matrix(sizes, shards, seed))
    cells = max(1, -(-sum(sizes) // (shards * CELL)))
    dealt = narrow.groupBy("p").applyInArrow(_deal(matrix, index, seed, cells), "doc_id long, size long, text_crc32 long, shard int, cell int, draw long, row long")
    dealt = save(dealt, "dealt")
    filled = dealt.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("draw", "row")) - 1
    return dealt.withColumn("within", within).join(offsets, ["shard", "cell"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
