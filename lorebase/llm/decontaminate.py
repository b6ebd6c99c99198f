"""Operator 10: benchmark decontamination by pigeonhole edit matching.

Texts and items are folded first: ASCII letters lower-case, runs of other ASCII characters than letters and digits
one space. An item of m folded bytes occurs in a document when some substring is within k = floor(ERROR * m) edits of
it. The item is split into k + 1 pieces: k edits spare at least one, so every occurrence holds some piece exactly.
One Aho-Corasick automaton finds all pieces of all items; around each hit Myers' bit-parallel distance decides.
Hits of one item whose windows touch are verified together.

The benchmark is a stated query set: its size is measured, and it is taken in blocks of at most BLOCK_BYTES, each
sent to the executors and held against all documents in one map over the scan. Nothing of the documents is shuffled
while there is one block, and only hits are with several.

Null and empty texts contain nothing, null or blank items occur nowhere, equal items are all reported. An item of
less than 1 / ERROR folded bytes has a budget of 0 and is matched exactly. An empty benchmark finds nothing, an empty
table gives no rows. Rows are kept one to one, with null doc_ids, repeated rows and extra columns of any name; very long texts are scanned in overlapping stretches of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, save, text_bytes

#: Edits allowed for each folded byte of an item.
ERROR = 0.08
BLOCK_BYTES = 4 << 20
STRETCH = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_OTHER = re.compile(rb"[^0-9a-z\x80-\xff]+")


def fold(text: bytes | None) -> bytes:
    return _OTHER.sub(b" ", text.translate(_LOWER)).strip(b" ") if text else b""


def budget(m: int, error: float) -> int:
    return int(m * error + 1e-9)


def pieces(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """k + 1 pieces of nearly equal length with their offsets; fewer only if the item has fewer bytes."""
    n = min(k + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: bytes, text: bytes, k: int) -> int:
    """The least edit distance of pattern to a substring of text, or k + 1 if it is more than k."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return min(best, k + 1)


class Matcher:
    def __init__(self, items: list[tuple[int, bytes]], error: float):
        self.items = [(i, f, budget(len(f), error)) for i, t in items if (f := fold(t))]
        found: dict[bytes, list[tuple[int, int]]] = {}
        for at, (_, f, k) in enumerate(self.items):
            for offset, piece in pieces(f, k):
                found.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece.decode("latin1"), (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.reach = max((len(f) + 2 * k for _, f, k in self.items), default=0)

    def find(self, text: bytes | None) -> dict[int, int]:
        """item -> least distance, of the items that occur."""
        folded, out = fold(text), {}
        if not self.items or not folded:
            return out
        for start in range(0, len(folded), STRETCH):
            self._find(folded[start : start + STRETCH + self.reach], out)
        return out

    def _find(self, folded: bytes, out: dict[int, int]) -> None:
        windows: dict[int, list[list[int]]] = {}
        for end, (n, where) in self.automaton.iter(folded.decode("latin1")):
            for at, offset in where:
                _, f, k = self.items[at]
                start = end + 1 - n - offset
                lo, hi = max(0, start - k), min(len(folded), start + len(f) + k)
                of = windows.setdefault(at, [])
                if of and lo <= of[-1][1] and hi >= of[-1][0]:
                    of[-1][:] = min(lo, of[-1][0]), max(hi, of[-1][1])
                else:
                    of.append([lo, hi])
        for at, of in windows.items():
            item, f, k = self.items[at]
            for lo, hi in of:
                least = out.get(item, k + 1)
                if least and (d := myers(f, folded[lo:hi], k)) <= k:
                    out[item] = min(d, least)


def find_items(docs: DataFrame, benchmark: DataFrame, error: float = ERROR) -> DataFrame:
    """docs with item_ids and distances (arrays, by item_id); columns so named are replaced."""
    spark = docs.sparkSession
    keep = [c for c in docs.columns if c.lower() not in ("item_ids", "distances")]
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_bytes("text").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    part = lambda b: spark.sparkContext.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()])
    if blocks == 1:
        return _find_block(docs, keep, part(0), error)
    row, found_at = fresh("_row", keep), fresh("_found", keep)
    # several blocks: number the rows once, so that hits of the blocks find back to their rows
    fixed = save(docs.select(*keep, F.monotonically_increasing_id().alias(row)), "docs")
    hits = None
    for b in range(blocks):
        found = _find_block(fixed.select(row, "text"), [row], part(b), error).where(F.size("item_ids") > 0).select(row, F.arrays_zip("item_ids", "distances").alias("z"))
        hits = found if hits is None else hits.union(found)
    by_row = hits.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list("z"))).alias(found_at))
    out = fixed.join(by_row, row, "left").drop(row)
    return out.select(*keep, F.coalesce(F.col(f"{found_at}.item_ids"), F.array().cast("array<long>")).alias("item_ids"), F.coalesce(F.col(f"{found_at}.distances"), F.array().cast("array<int>")).alias("distances"))


def _find_block(docs: DataFrame, keep: list[str], block, error: float) -> DataFrame:
    rows = docs.select(F.struct(*keep).alias("row"), text_bytes("text").alias("bytes"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block.value, error)
        for b in it:
            found = [sorted(matcher.find(t).items()) for t in b.column(1).to_pylist()]
            ids, distances = pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64())), pa.array([[d for _, d in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, distances], names=["row", "item_ids", "distances"])

    kind = rows.schema["row"].dataType.simpleString()
    return map_arrow(rows, run, f"row {kind}, item_ids array<long>, distances array<int>").select("row.*", "item_ids", "distances")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "distances", (F.size("item_ids") > 0).alias("contaminated"))
