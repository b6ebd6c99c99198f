"""Shared pieces of the training-data operators: scratch tables, Arrow maps, word hashing, components.

Word rule everywhere: lower-case A-Z only, words are runs of bytes other than space and 0x09-0x0D.
Texts travel to Python as bytes, so nothing is decoded and odd UTF-8 cannot fail a task.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_64_intdigest

from lorebase.scratch import scratch_dir

#: Rows per Arrow batch sent to Python: bounds a worker's memory when texts are long.
ARROW_ROWS = 1000

_made: list[tuple] = []


def configure(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/lorebase-{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is already gone
            return


#: Shuffle files of a finished write are removed at once, for nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back. Lost executors re-read files."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """f over the batches of each partition; workers serve later stages too, so memory is given back at the end."""
    configure(df.sparkSession)

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(it)
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    """Free memory that allocators keep goes back to the system, where there is a way."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        return


def text_bytes(col: str | Column = "text") -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("binary")


# --- words and shingles -------------------------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_IS_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Bytes hashed at a time: bounds memory whatever the texts' lengths.
STRETCH = 1 << 17
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse, modulo 2^64."""
    up, down = (np.full(n, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by a sort (np.unique hashes, which is several times slower here)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _stretches(texts: list[bytes | None]) -> Iterator[tuple[bytes, int, list[int]]]:
    """Texts joined by spaces into pieces of at most STRETCH bytes: (piece, first text, where each text ends in it).

    Long texts are cut behind white space; a longer word than a piece makes a piece of its own size.
    """
    held, size, first, ends = [], 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        at = 0
        while len(t) - at + 1 + size > STRETCH:
            if held:
                yield b"".join(held), first, ends
                held, size, first, ends = [], 0, i, []
            if len(t) - at + 1 <= STRETCH:
                break
            cut = max(t.rfind(c, at, at + STRETCH - 1) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
            if cut <= at:
                found = _SPACE_AFTER.search(t, at)
                cut = found.end() if found else len(t)
            yield t[at:cut], i, []
            at, first = cut, i
        if not held:
            first = i
        held += [t[at:], b" "]
        size += len(t) - at + 1
        ends.append(size)
    if held:
        yield b"".join(held), first, ends


_SPACE_AFTER = re.compile(rb"[\x20\x09-\x0d]")


def hash_texts(texts: list[bytes | None], lower: bool = True, lines: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(hashes of all words, text of each word, line in its text of each word if asked for).

    A word's hash is a polynomial of its bytes, from prefix sums over a whole stretch, and then mixed: a few vector
    operations a byte and no Python object a word.
    """
    hashes, owners, places, base = [], [], [], np.zeros(len(texts) + 1, np.int64)
    up, down = _powers(min(STRETCH, sum(len(t) + 1 for t in texts if t) + len(texts)))
    for piece, first, ends in _stretches(texts):
        a = np.frombuffer(piece, np.uint8)
        a = _LOWER[a] if lower else a
        edge = np.diff(np.concatenate([[True], _IS_SPACE[a], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(start) and end[0] - start[0] >= STRETCH:  # one word and perhaps the space behind it
            h = np.array([xxh3_64_intdigest(a[s:e].tobytes()) for s, e in zip(start, end, strict=True)], np.uint64)
        else:
            total = np.concatenate([[np.uint64(0)], np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)])])
            h = mix((total[end] - total[start]) * down[start % STRETCH] + (end - start).astype(np.uint64))
        which = np.searchsorted(np.array(ends, np.int64), start, side="right") + first
        hashes.append(h), owners.append(which)
        if lines:
            breaks = np.flatnonzero(a == 10)
            seen = np.searchsorted(breaks, start)
            # breaks before the text's own start in this piece don't count; those of its earlier pieces do
            from_ = np.searchsorted(breaks, np.array([0, *ends], np.int64))
            places.append(seen - from_[which - first] + base[which])
            for k in range(len(from_)):
                till = from_[k + 1] if k + 1 < len(from_) else len(breaks)
                if first + k < len(base):
                    base[first + k] += till - from_[k]
    none = np.zeros(0, np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([none, *owners]), np.concatenate([none, *places]) if lines else None


def gather(it: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches joined until they have so many rows or bytes."""
    held, n, total = [], 0, 0
    for b in it:
        held.append(b)
        n, total = n + b.num_rows, total + b.nbytes
        if n >= rows or total >= size:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, total = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores behind it until no column is called so (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever dots and quotes they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def split_by(values: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """values of owners 0 to n - 1, in order."""
    return np.split(values, np.searchsorted(owner, np.arange(1, n))) if n else []


def hash_each(texts: list[bytes | None], lower: bool = True) -> list[np.ndarray]:
    """The word hashes of each text."""
    hashes, owner, _ = hash_texts(texts, lower)
    return split_by(hashes, owner, len(texts))


def raw_shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles in order of place; fewer words make one shingle of all of them."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(k, n)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(31) + word_hashes[i : n - width + 1 + i])
    return h


def shingles(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return distinct(raw_shingles(word_hashes, k))


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a sorted token set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


# --- connected components -----------------------------------------------------------------------


#: Rounds grow with the logarithm of the longest path.
ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "cc") -> DataFrame:
    """(node, comp): the smallest node reachable, for every node of an edge list of longs.

    Rounds of large-star and small-star; both group with map-side partial minima, so a node with very many
    edges is pre-aggregated. Each round is a written table; the driver sees one flag per round only.
    """
    e = save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{name}-0"
    )
    for step in range(ROUNDS):
        # large star: each node links its larger neighbours to its smallest neighbour (or itself)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node links its smaller neighbours, and itself, to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("p")).select("p.u", F.col("p.m").alias("v")).where("u <> v").distinct()
        nxt = save(small, f"{name}-{step + 1}")
        # done when it is a forest of stars: no node is both a centre and a leaf, and each leaf has one centre
        tall = nxt.join(nxt.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1)
        many = nxt.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).select("n")
        e = nxt
        if tall.isEmpty() and many.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    raise RuntimeError(f"components: no forest of stars after {ROUNDS} rounds")
