"""Operator 11: passages that repeat, found by suffix trees that are split by prefixes of variable length.

Words are runs of bytes other than space and 0x09-0x0D, unchanged. A window is WIDTH consecutive words of one document.
A window goes if its words also start earlier: in a document of smaller doc_id, or earlier in the same one. Each word
that such a window covers is removed; windows are judged on the input.

The trees are sparse. Of the K-word shingles within a window the one of smallest hash, the first of equals, is its anchor;
equal windows have it at the same place, so suffixes that start at anchors, about one word in six, are enough. An anchor
owns the windows that chose it: those that start `low` to `high` words before it.

1. Suffixes are dealt to buckets by their first K words (a hash). Where these occur once, no window of the anchor
   repeats. A task that meets a prefix more often sends it once, with its count; the anchors themselves are known to
   matter and are sent elsewhere, so that a passage in a third of all documents makes no large bucket.
2. Prefixes of more than LIMIT suffixes are split: there each window is a suffix of its own, whose prefix is all WIDTH
   words. Which are so is told by a bit for each of 2^20 slots of prefix hashes, a table of fixed size; a prefix that
   shares a slot with a frequent one is split as well, by all tasks alike.
3. Anchors that matter meet their documents again and send the words of their windows to the group of their prefix,
   about GROUP suffixes each. Equal ones within a task are sent once; that the later ones go is known.
4. A group sorts its suffixes word by word. Neighbours' common prefixes are the internal nodes of its subtree: those of
   depth WIDTH - d, cut further by the d words to the left, are the repeats of windows that start d words before the
   anchor. Words are compared as words, not by their hashes.

Rows of a null doc_id take no part and keep all words, as do texts of fewer than WIDTH words; null texts have no words.
Rows that share a doc_id are no copies of each other, but each is one of smaller doc_ids and of itself; wholly equal
rows give equal results. An empty table gives no rows. Extra columns are kept; columns called like a result are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from .common import batch, distinct, fresh, gather, hash_texts, map_arrow, mix, quoted, save, text_bytes

#: Words of a window.
WIDTH = 20
#: Slots of prefix hashes, by their high bits.
SLOT_BITS = 20
#: A prefix of more suffixes is split; suffixes of a group; anchors of a bucket; least number of buckets and groups.
LIMIT, GROUP, BUCKET, LEAST = 1 << 14, 1 << 15, 1 << 18, 64
#: Anchors and bytes of suffixes that a task gathers before it sends them; words looked at in one step.
SEND, SEND_BYTES, STEP = 1 << 20, 1 << 26, 1 << 20
#: Bytes of text for each anchor, to choose the number of buckets.
BYTES_PER_ANCHOR = 36

#: count: how often the task met the prefix; 0 for an anchor that is known to matter.
ANCHOR = np.dtype([("key", "<u8"), ("doc", "<i8"), ("tag", "<i8"), ("at", "<i4"), ("own", "<u2"), ("count", "<u4")])
#: An anchor that matters: its place, the windows it owns and its prefix.
WANTED = np.dtype([("key", "<u8"), ("at", "<i4"), ("own", "<u2")])
#: Windows to be removed: bit d stands for the one that starts d words before the anchor.
MARK = np.dtype([("at", "<i4"), ("mask", "<u8")])


def _pack(rows: np.ndarray) -> bytes:
    """Byte by byte of each field, so that the high bytes, mostly zeros, compress to nothing."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(rows[c]).view(np.uint8).reshape(len(rows), -1).T).tobytes() for c in rows.dtype.names)


def _unpack(packed: list[bytes], kind: np.dtype) -> np.ndarray:
    out, done = np.zeros(sum(map(len, packed)) // kind.itemsize, kind), 0
    for p in packed:
        n, at = len(p) // kind.itemsize, 0
        for c in kind.names:
            size = kind[c].itemsize
            out[c][done : done + n] = np.ascontiguousarray(np.frombuffer(p, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind[c])
            at += n * size
        done += n
    return out


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are ordered by these columns differ from the one before."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def anchors_of(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in hashes, prefix, low, high) of the anchors of texts' words in a row."""
    k = max(1, width // 2)
    w = width - k + 1
    places, keys, lows, highs = [], [], [], []
    for begin in range(0, len(hashes) - width + 1, STEP):
        h = hashes[begin : begin + STEP + width - 1]
        key = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            key = mix(key * np.uint64(31) + h[j : len(h) - k + 1 + j])
        least = np.lib.stride_tricks.sliding_window_view(key, w).argmin(axis=1)
        start = np.arange(len(least))
        whole = owner[begin + start] == owner[begin + start + width - 1]
        start, anchor = start[whole], (least + start)[whole]
        first = _starts(anchor)
        last = np.append(first[1:], len(anchor)) - 1
        places.append(anchor[first] + begin), keys.append(key[anchor[first]])
        highs.append(anchor[first] - start[first]), lows.append(anchor[first] - start[last])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none.astype(np.uint64), *keys]), np.concatenate([none, *lows]), np.concatenate([none, *highs])


def _anchors(width: int, buckets: int):
    """(bucket, packed anchors) of rows (doc_id, tag, text)."""
    schema = pa.schema([("bucket", pa.int32()), ("rows", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            rows = np.concatenate(held)
            rows = rows[np.argsort(rows["key"], kind="stable")]
            first = _starts(rows["key"])
            count = np.diff(np.append(first, len(rows)))
            rows["count"] = 0
            many = np.repeat(count > 1, count)
            told = rows[first]
            told["count"] = count
            # what is met once speaks for itself; of the others one row counts and all are known
            rows = np.concatenate([told, rows[many]])
            where = np.where(rows["count"] > 0, mix(rows["key"]), mix(rows["doc"].astype(np.uint64) + np.uint64(1))) % np.uint64(buckets)
            order = np.argsort(where, kind="stable")
            rows, where = rows[order], where[order]
            first = _starts(where)
            return batch(schema, where[first].astype(np.int32), [_pack(r) for r in np.split(rows, first[1:])])

        for b in gather(it, 1000, 1 << 22):
            doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            hashes, owner, _ = hash_texts(b.column(2).to_pylist(), lower=False)
            place, key, low, high = anchors_of(hashes, owner, width)
            if not len(place):
                continue
            rows, of = np.zeros(len(place), ANCHOR), owner[place]
            rows["key"], rows["doc"], rows["tag"] = key, doc[of], tag[of]
            rows["at"], rows["own"] = place - np.searchsorted(owner, of), low | high << 8
            held.append(rows)
            size += len(rows)
            if size >= SEND:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Per bucket: (doc, tag, packed anchors that matter); rows without doc: the slots of frequent prefixes."""
    rows = _unpack(table.column("rows").to_pylist(), ANCHOR)
    known, rows = rows[rows["count"] == 0], rows[rows["count"] > 0]
    rows = rows[np.argsort(rows["key"], kind="stable")]
    first = _starts(rows["key"])
    size = np.diff(np.append(first, len(rows)))
    total = np.add.reduceat(rows["count"].astype(np.int64), first) if len(rows) else np.zeros(0, np.int64)
    slots = distinct(rows["key"][first][total > LIMIT] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    # of a prefix that its task met more often, the anchors are among the known ones
    met = np.concatenate([known, rows[np.repeat(size > 1, size) & (rows["count"] == 1)]])
    met = met[np.lexsort((met["at"], met["tag"], met["doc"]))]
    first = _starts(met["doc"], met["tag"])
    out = np.zeros(len(met), WANTED)
    for c in WANTED.names:
        out[c] = met[c]
    packed = [_pack(r) for r in np.split(out, first[1:])] if len(met) else []
    none = len(slots)
    return pa.table(
        [pa.concat_arrays([pa.array(met["doc"][first]), pa.nulls(none, pa.int64())]), pa.array(np.concatenate([met["tag"][first], slots])), pa.array([*packed, *[None] * none], pa.binary())], names=["doc", "tag", "wanted"]
    )


def _suffixes(width: int, groups: int, frequent):
    """(grp, doc, tag, at, low, high, words) of rows (doc, tag, text, lists of packed anchors), equal ones of a task once.

    words: those of all owned windows, with single spaces. Known marks have none, and a mask of windows in `at`'s row.
    """
    schema = pa.schema([("grp", pa.int32()), ("doc", pa.int64()), ("tag", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("words", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[tuple[int, int, int, int]]] = {}
        size = 0

        def send() -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for (words, low, high, where), at in found.items():
                at.sort()
                least, last = at[0][0], None
                for doc, tag, place in at:
                    # earlier in a smaller document, or earlier in this one
                    if doc > least or (last is not None and last[:2] == (doc, tag) and last[2] < place):
                        out.append((mix(np.array([doc], np.int64).astype(np.uint64)).item() % groups, doc, tag, place, low, high, None))
                    elif (doc, tag, place) != last:
                        out.append((where, doc, tag, place, low, high, words))
                    last = doc, tag, place
            found.clear()
            for k in range(0, len(out), 1 << 14):
                yield batch(schema, *map(list, zip(*out[k : k + (1 << 14)], strict=True)))

        for b in it:
            for doc, tag, text, packed in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                text = b" ".join(text.split())
                # start of each word, and where the next one would start
                start = np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1, [len(text) + 1]]).tolist()
                want = _unpack(packed, WANTED)
                keys, low, high = want["key"], (want["own"] & 255).astype(np.int64), (want["own"] >> 8).astype(np.int64)
                often = frequent.value[keys >> np.uint64(64 - SLOT_BITS)]
                where = (mix(keys + np.uint64(1)) % np.uint64(groups)).astype(np.int64)
                for at, lo, hi, g, split in zip(want["at"].tolist(), low.tolist(), high.tolist(), where.tolist(), often.tolist(), strict=True):
                    for lo_, hi_ in [(d, d) for d in range(lo, hi + 1)] if split else [(lo, hi)]:
                        words = text[start[at - hi_] : start[at - lo_ + width] - 1]
                        same = found.setdefault((words, lo_, hi_, xxh3_64_intdigest(words) % groups if split else g), [])
                        if not same:
                            size += len(words) + 200
                        same.append((doc, tag, at))
                        size += 100
                if size >= SEND_BYTES:
                    yield from send()
                    size = 0
        yield from send()

    return run


def _refine(old: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Classes of (class, word)."""
    return np.unique(old * (int(word.max(initial=0)) + 2) + word + 1, return_inverse=True)[1]


def subtree_marks(doc: np.ndarray, tag: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, words: pa.Array, width: int) -> np.ndarray:
    """Of each suffix, the owned windows that start earlier elsewhere, as bits d."""
    n, mask = len(doc), np.zeros(len(doc), np.uint64)
    lists = pc.split_pattern(words, b" ")
    ids = pc.dictionary_encode(lists.values).indices.to_numpy().astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    right_size, w = width - low, int(high.max(initial=0))
    # words from the anchor on, and those to its left, nearest first; -1: none
    right, left = np.full((n, width), -1, np.int64), np.full((n, w), -1, np.int64)
    for j in range(width):
        has = np.flatnonzero(j < right_size)
        right[has, j] = ids[offsets[has] + high[has] + j]
    for j in range(w):
        has = np.flatnonzero(j < high)
        left[has, j] = ids[offsets[has] + high[has] - 1 - j]
    order = np.lexsort(right.T[::-1])
    sorted_ = right[order]
    # words in common with the suffix before: the depth of the node above both
    common = np.concatenate([[0], np.logical_and.accumulate(sorted_[1:] == sorted_[:-1], axis=1).sum(axis=1)])
    lefts = np.zeros(n, np.int64)
    for d in range(w + 1):
        if d:
            lefts = _refine(lefts, left[:, d - 1])
        node = np.empty(n, np.int64)
        node[order] = np.cumsum(common < width - d)
        own = np.flatnonzero((low <= d) & (d <= high))
        own = own[np.lexsort((at[own], tag[own], doc[own], lefts[own], node[own]))]
        if not len(own):
            continue
        first = _starts(node[own], lefts[own])
        least = np.repeat(doc[own][first], np.diff(np.append(first, len(own))))
        again = doc[own] > least
        same = (node[own][1:] == node[own][:-1]) & (lefts[own][1:] == lefts[own][:-1]) & (doc[own][1:] == doc[own][:-1]) & (tag[own][1:] == tag[own][:-1])
        # an equal row has the same place and is no earlier one: the first place of a document stays, as often as it is there
        run_ = _starts(np.cumsum(np.concatenate([[True], ~same])))
        again |= at[own] > np.repeat(at[own][run_], np.diff(np.append(run_, len(own))))
        mask[own[again]] |= np.uint64(1) << np.uint64(d)
    return mask


def _subtrees(width: int):
    """Per group: (doc, tag, packed marks)."""

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table.column("words")))
        doc, tag, at, low, high = (known.column(c).to_numpy().astype(np.int64) for c in ("doc", "tag", "at", "low", "high"))
        bits = (np.uint64(1) << (high + 1).astype(np.uint64)) - (np.uint64(1) << low.astype(np.uint64))
        sides = [(doc, tag, at, bits)]
        table = table.filter(pc.is_valid(table.column("words")))
        if table.num_rows:
            doc, tag, at, low, high = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "tag", "at", "low", "high"))
            sides.append((doc, tag, at, subtree_marks(doc, tag, at, low, high, table.column("words").combine_chunks().cast(pa.large_binary()), width)))
        doc, tag, at, bits = (np.concatenate(c) for c in zip(*sides, strict=True))
        keep = np.flatnonzero(bits)
        keep = keep[np.lexsort((at[keep], tag[keep], doc[keep]))]
        marks = np.zeros(len(keep), MARK)
        marks["at"], marks["mask"] = at[keep], bits[keep]
        first = _starts(doc[keep], tag[keep])
        packed = [_pack(m) for m in np.split(marks, first[1:])] if len(keep) else []
        return pa.table([pa.array(doc[keep][first]), pa.array(tag[keep][first]), pa.array(packed, pa.binary())], names=["doc", "tag", "marks"])

    return run


def repeated_windows(docs: DataFrame, size: int, width: int = WIDTH) -> DataFrame:
    """(doc, tag, marks) of the windows to be removed, from rows (doc, tag, text in bytes) of `size` bytes of text."""
    spark = docs.sparkSession
    buckets = max(LEAST, size // (BYTES_PER_ANCHOR * BUCKET))
    sent = map_arrow(docs, _anchors(width, buckets), "bucket int, rows binary")
    found = save(sent.groupBy("bucket").applyInArrow(_repeated, "doc long, tag long, wanted binary"), "anchors")
    # at most one row a slot
    slots = found.where("doc is null").select(F.col("tag").alias("slot")).distinct().toArrow().column(0).to_numpy()
    table = np.zeros(1 << SLOT_BITS, bool)
    table[slots] = True
    wanted = found.where("doc is not null").groupBy("doc", "tag").agg(F.collect_list("wanted").alias("wanted"), F.sum(F.octet_length("wanted")).alias("bytes"))
    wanted = save(wanted, "wanted")
    total = wanted.agg(F.sum("bytes")).first()[0] or 0
    groups = max(LEAST, total // (WANTED.itemsize * GROUP))
    # the narrow side is hashed, so that whole texts need no sort
    met = docs.join(wanted.select("doc", "tag", "wanted").hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "wanted")
    dealt = map_arrow(met, _suffixes(width, groups, spark.sparkContext.broadcast(table)), "grp int, doc long, tag long, at int, low int, high int, words binary")
    return save(dealt.groupBy("grp").applyInArrow(_subtrees(width), "doc long, tag long, marks binary"), "marks")


def _covered(packed: list[bytes] | None, width: int) -> list[tuple[int, int]]:
    """Spans of words, from and to, that marked windows cover; overlapping and touching ones are one."""
    marks = _unpack(packed or [], MARK)
    starts = [marks["at"][bit] - d for d in range(width) if len(bit := np.flatnonzero(marks["mask"] >> np.uint64(d) & np.uint64(1)))]
    if not starts:
        return []
    starts = distinct(np.concatenate(starts).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + width]))
    return list(zip(starts[first].tolist(), (starts[np.append(first[1:], len(starts)) - 1] + width).tolist(), strict=True))


def _apply(width: int):
    """row, n_words, n_removed, kept and spans of (row, text, marks)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            counts, gone, kept, spans = [], [], [], []
            for text, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                cut = _covered(packed, width)
                stays = bytearray(b"\x01") * len(words)
                for from_, to in cut:
                    stays[from_:to] = bytes(to - from_)
                counts.append(len(words)), gone.append(sum(to - from_ for from_, to in cut))
                kept.append(b" ".join(compress(words, stays))), spans.append([{"start": f, "end": t} for f, t in cut])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, span)], names=["row", "n_words", "n_removed", "kept", "spans"])

    return run


RESULTS = ("n_words", "n_removed", "kept", "spans")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with n_words, n_removed (long), kept (the words that stay, joined by spaces) and spans (of removed words, from and to)."""
    if not 2 <= width <= 64:
        raise ValueError("a window has 2 to 64 words")
    keep = [c for c in docs.columns if c.lower() not in RESULTS]
    id_, text = F.col("doc_id").cast("long"), F.col("text")
    rows = docs.where("doc_id is not null and text is not null")
    by_id = rows.groupBy(id_.alias("doc")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    facts = by_id.agg(F.max("n"), F.sum("size")).first()
    # rows that share a doc_id are told apart by their texts
    tagged = (facts[0] or 0) > 1
    tag = F.xxhash64("text") if tagged else F.lit(0).cast("long")
    marks = repeated_windows(rows.select(id_.alias("doc"), tag.alias("tag"), text_bytes("text").alias("text")), facts[1] or 0, width)
    by_row = marks.groupBy("doc", "tag").agg(F.collect_list("marks").alias("marks"))
    doc, of, found, salt = (fresh(c, docs.columns) for c in ("_doc", "_tag", "_marks", "_salt"))
    # rows with a null doc_id match nothing; a salt keeps them from one task
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(tag)
    side = by_row.select(F.col("doc").alias(doc), F.col("tag").alias(of), F.col("marks").alias(found))
    columns = quoted(keep)
    both = docs.select(*columns, spread.alias(salt)).join(side.hint("shuffle_hash"), (id_ == F.col(doc)) & (F.col(salt) == F.col(of)), "left")
    given = both.select(F.struct(*columns).alias("row"), text_bytes("text").alias("text"), F.col(found).alias("marks"))
    results = "n_words long, n_removed long, kept binary, spans array<struct<start: long, end: long>>"
    schema = T.StructType([given.schema["row"], *T.StructType.fromDDL(results).fields])
    out = map_arrow(given, _apply(width), schema)
    return out.select("row.*", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), "spans")


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
t AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
s AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS gram FROM t),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM s WHERE i + 19 <= n),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g WHERE k > 1),
r AS (SELECT t.doc_id, count(c.i) AS n_removed, string_agg(word, ' ' ORDER BY t.i) FILTER (WHERE c.i IS NULL) AS kept FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.i = t.i GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    """Every whole document without the passages that it repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
