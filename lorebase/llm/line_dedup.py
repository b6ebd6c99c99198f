"""Operator 8: near-duplicate lines by an exact set-similarity join.

A line's tokens are its distinct words (A-Z folded). Lines without a word are never removed. A line is removed if an
earlier line, by (doc_id, line number), has Jaccard similarity of at least num / den with it.

Equal token sets are settled by their 64-bit keys: of these only the first line can stay, and copies within a task go
no further. Sets so small that one word more or less falls short of num / den (under 4 words at 0.8) can only have
equal partners and end there.

The others meet in the postings of their prefix, the n - ceil(t * n) + 1 first tokens in an order by rarity. That
order comes from counts over all documents in SLOTS slots of token hashes, a table of fixed size. A posting holds the
line, the set's key and size, the token's position and a sketch of 128 bits, in each of which the parity of the
set's tokens there is kept: sets that differ in d tokens differ in at most d bits. Within a posting the smaller set of
a pair has to show the token in its shorter index prefix; length, positional and sketch filters drop most pairs at
once, without leaving the task.

First round: a token of many lines is dealt to blocks of about BLOCK lines, without copies. In each posting the
earliest lines are held against all others, PIVOTS times, so that a group of near copies costs a few looks a line.
A line gives out FEW candidates a posting; these are verified on their words, read again from the documents. Second round: only the lines that
none of these removed, and that had more candidates or a token of several blocks, are held against all blocks and
give out all candidates. Lines themselves are never copied, only these probes are. Nothing is capped: what the first
round leaves open, the second one settles.

Postings know words by 32 bits of their hashes, which may make candidates but loses none; what is removed is decided on
64-bit hashes of the words. Rows that share a doc_id share positions and so are no copies
of each other; rows with a null doc_id take no part and come back unchanged, as do null and empty texts; an empty
table gives no rows. Lines end at \\n and keep other white space. Very long texts and lines are hashed piece by piece.
Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, distinct, fresh, gather, hash_each, hash_texts, map_arrow, mix, save, text_bytes
from .native import let

#: Slots in which tokens are counted, by their high bits; a slot counted less than LOCAL_MIN times in CHUNK tokens is
#: given out by chance, at a rate that leaves the expected total as it is.
SLOT_BITS, CHUNK, LOCAL_MIN = 20, 1 << 22, 8
SLOTS = 1 << SLOT_BITS
#: Lines of a posting that are compared in one task; postings per bucket; least number of buckets.
BLOCK, BUCKET, MIN_BUCKETS = 1 << 14, 250_000, 256
#: Keys a task remembers to drop copies; postings it gathers before it sends them; pairs looked at in one step.
SEEN, SEND, STEP = 1 << 16, 1 << 19, 1 << 20
FEW, PIVOTS = 2, 4

LINE = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("key", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary())])
#: name: 32 bits of the key. Equal sets have equal names, sizes and sketches, and only these are taken for equal here.
POSTING = np.dtype([("token", "<u4"), ("doc", "<i8"), ("line", "<i4"), ("name", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("probe", "u1"), ("low", "<u8"), ("high", "<u8")])
#: Larger sizes and positions share a place in the order of a posting, and pass the index filter.
LARGE = 65535
#: Roles of a posting: only looked up, only probing, both.
LOOKED_UP, PROBING, BOTH = 0, 1, 2


def _ragged(values: np.ndarray, lengths: np.ndarray, held: np.ndarray) -> pa.Array:
    """A binary array of rows of uint32; rows that aren't held are null."""
    keep = np.repeat(held, lengths)
    offsets = np.concatenate([[0], np.cumsum(4 * np.where(held, lengths, 0))]).astype(np.int32)
    valid = pa.array(held).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(lengths), [valid, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values[keep]))])


def _least(num: int, den: int) -> int:
    """The least size of a set that a different one can be similar to: n / (n + 1) >= num / den."""
    return -(-num // (den - num)) if num < den else 1 << 62


def _prefix(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """n - ceil(n * num / den) + 1."""
    return n + (-n * num // den) + 1


def _overlap(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of similar sets with so many tokens together."""
    return -(-num * total // (num + den))


def _lines(least: int):
    """doc_id, line, key, n and tokens (uint32, ascending) of each line; with n = -count, token slots and their counts.

    Tokens are null for lines of fewer than `least` tokens and for copies of a line that the task has met lately;
    tokens are counted in lines that hold them.
    """

    def tokens_of(docs: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        hashes, owner, line = hash_texts(texts, lines=True)
        new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (line[1:] != line[:-1])])) if len(owner) else owner
        size = np.diff(np.append(new, len(owner)))
        at = np.repeat(np.arange(len(new), dtype=np.uint64), size)
        packed = at << np.uint64(32) | hashes >> np.uint64(32)
        order = np.argsort(packed)
        packed, whole = packed[order], hashes[order]
        same = packed[1:] == packed[:-1]
        if (same & (whole[1:] != whole[:-1])).any():  # two words of a line share a token: each counts
            order = np.lexsort((whole, packed))
            packed, whole = packed[order], whole[order]
            same = (packed[1:] == packed[:-1]) & (whole[1:] == whole[:-1])
        first = np.concatenate([[True], ~same]) if len(packed) else np.zeros(0, bool)
        packed, whole = packed[first], whole[first]
        n = np.bincount((packed >> np.uint64(32)).astype(np.int64), minlength=len(new))
        tokens = (packed & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        key = mix(np.add.reduceat(mix(whole + np.uint64(1)), np.cumsum(n) - n) + n.astype(np.uint64)) if len(n) else np.zeros(0, np.uint64)
        return docs[owner[new]], line[new].astype(np.int32), n, tokens, key.view(np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size, chunk, seen = np.zeros(SLOTS, np.int64), 0, 0, {}

        def report(name: int) -> pa.RecordBatch:
            slots = np.flatnonzero(counts)
            c = counts[slots]
            luck = mix(slots.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(name)) % np.uint64(LOCAL_MIN)
            often = c > luck.astype(np.int64)  # c < LOCAL_MIN: at a rate of c / LOCAL_MIN
            slots, c = slots[often], np.maximum(c[often], LOCAL_MIN)
            none = len(slots)
            counts[:] = 0
            return batch(LINE, pa.nulls(none, pa.int64()), pa.nulls(none, pa.int32()), slots, -np.minimum(c, 2**31 - 1).astype(np.int32), pa.nulls(none, pa.binary()))

        for b in it:
            doc, line, n, tokens, key = tokens_of(b.column(0).to_numpy(), b.column(1).to_pylist())
            if not len(n):
                continue
            if len(seen) > SEEN:
                seen.clear()
            held = n >= least
            for i in np.flatnonzero(held).tolist():
                at = int(doc[i]), int(line[i])
                if (old := seen.get(k := int(key[i]))) is None or at < old:
                    seen[k] = at
                else:
                    held[i] = False
            yield batch(LINE, doc, line, key, n.astype(np.int32), _ragged(tokens, n, held))
            counted = tokens[np.repeat(held, n)]
            counts += np.bincount(counted >> np.uint32(32 - SLOT_BITS), minlength=SLOTS)
            size += len(counted)
            chunk ^= int(key[0]) & (2**64 - 1)
            if size >= CHUNK:
                yield report(chunk)
                size = 0
        if size:
            yield report(chunk)

    return run


def _pack(rows: np.ndarray) -> bytes:
    """Byte by byte of each column, so that the high bytes, mostly zeros, compress to nothing."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(rows[c]).view(np.uint8).reshape(len(rows), -1).T).tobytes() for c in POSTING.names)


def _unpack(packed: list[bytes]) -> dict[str, np.ndarray]:
    parts = {c: [] for c in POSTING.names}
    for p in packed:
        n, at = len(p) // POSTING.itemsize, 0
        for c in POSTING.names:
            kind = POSTING[c]
            planes = np.frombuffer(p, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
            parts[c].append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
            at += n * kind.itemsize
    return {c: np.concatenate([np.zeros(0, POSTING[c]), *v]) for c, v in parts.items()}


def _blocks(levels: np.ndarray) -> np.ndarray:
    """The blocks of tokens of these levels."""
    return np.ceil(2.0 ** (np.arange(256) / 4) / BLOCK)[levels].astype(np.int64)


def _postings(num: int, den: int, levels, buckets: int, wanted=None):
    """(bucket, packed postings) of the prefixes of lines(doc_id, line, key, n, tokens, probe).

    levels: of each slot. wanted: in the second round, whether a slot is one of a probing line's prefix. Probing
    lines go to all blocks of their tokens then, and all lines, to be looked up, to their own.
    """
    schema = pa.schema([("bucket", pa.int32()), ("postings", pa.binary())])

    def packed(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        doc, line, key, n, probe = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "line", "key", "n", "probe"))
        n = n.astype(np.int64)
        tokens = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint32)
        slots = tokens >> np.uint32(32 - SLOT_BITS)
        starts, of = np.cumsum(n) - n, np.repeat(np.arange(len(n), dtype=np.uint64), n)
        order = np.sort(of << np.uint64(40) | levels.value[slots].astype(np.uint64) << np.uint64(32) | tokens)
        of = of.astype(np.int64)
        pos = np.arange(len(tokens)) - starts[of]
        inside = pos < _prefix(n, num, den)[of]
        token, owner, pos = (order[inside] & np.uint64(0xFFFFFFFF)).astype(np.uint32), of[inside], pos[inside]
        if wanted is not None:
            keep = wanted.value[token >> np.uint32(32 - SLOT_BITS)]
            token, owner, pos = token[keep], owner[keep], pos[keep]
        bit, half = np.uint64(1) << (tokens & np.uint32(63)).astype(np.uint64), (tokens >> np.uint32(6)) & np.uint32(1)
        out = np.zeros(len(token), POSTING)
        for c, h in (("low", 0), ("high", 1)):
            out[c] = np.bitwise_xor.reduceat(np.where(half == h, bit, np.uint64(0)), starts)[owner]
        out["token"], out["doc"], out["line"], out["name"], out["n"], out["pos"] = token, doc[owner], line[owner], key.astype(np.uint64).astype(np.uint32)[owner], n[owner], pos
        out["probe"] = BOTH if wanted is None else LOOKED_UP
        blocks = _blocks(levels.value[token >> np.uint32(32 - SLOT_BITS)])
        block = (mix(out["name"].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        if wanted is not None:
            asks = np.flatnonzero(probe[owner])
            copies = np.repeat(asks, blocks[asks])
            other = np.arange(len(copies)) - np.repeat(np.cumsum(blocks[asks]) - blocks[asks], blocks[asks])
            probing = out[copies]
            probing["probe"] = PROBING
            out, block = np.concatenate([out, probing]), np.concatenate([block, other])
        place = mix(mix(out["token"].astype(np.uint64)) + block.astype(np.uint64))
        return out, (place % np.uint64(buckets)).astype(np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            rows, place = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            order = np.argsort(place.astype(np.uint64) << np.uint64(32) | rows["token"])
            rows, place = rows[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            parts = np.split(rows, first[1:])
            return batch(schema, place[first].astype(np.int32), [_pack(p) for p in parts])

        for b in gather(it, 1 << 13, 1 << 22):
            held.append(packed(b))
            size += len(held[-1][0])
            if size >= SEND:
                yield send()
                held, size = [], 0
        if size:
            yield send()

    return run


PAIR = pa.schema([("xd", pa.int64()), ("xl", pa.int32()), ("yd", pa.int64()), ("yl", pa.int32()), ("more", pa.bool_())])


class Postings:
    """The postings of a bucket, each set once a posting, in order of token, size and position."""

    def __init__(self, p: dict[str, np.ndarray], num: int, den: int):
        order = np.argsort(p["token"].astype(np.uint64) << np.uint64(32) | p["name"])
        order = order[self._first_of_each(p, order)]
        place = p["token"][order].astype(np.uint64) << np.uint64(32) | np.minimum(p["n"][order], LARGE).astype(np.uint64) << np.uint64(16) | np.minimum(p["pos"][order], LARGE).astype(np.uint64)
        order = order[np.argsort(place)]
        self.token, self.doc, self.line, self.low, self.high = (p[c][order] for c in ("token", "doc", "line", "low", "high"))
        self.n, self.pos = p["n"][order].astype(np.int64), p["pos"][order].astype(np.int64)
        self.place = self.token.astype(np.int64) << 16 | np.minimum(self.n, LARGE)
        self.index = (self.pos < self.n - _overlap(2 * self.n, num, den) + 1) | (self.n >= LARGE)

    @staticmethod
    def _first_of_each(p: dict[str, np.ndarray], order: np.ndarray) -> np.ndarray:
        """Of equal sets of a posting the first line stands for all; copies are settled elsewhere."""
        token, name = p["token"][order], p["name"][order]
        same = (token[1:] == token[:-1]) & (name[1:] == name[:-1])
        if not same.any():
            return np.ones(len(order), bool)
        keep = np.ones(len(order), bool)
        some = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        q = {c: v[order[some]] for c, v in p.items()}
        by = np.lexsort((q["line"], q["doc"], q["high"], q["low"], q["n"], q["name"], q["token"]))
        again = np.ones(max(0, len(by) - 1), bool)
        for c in ("token", "name", "n", "low", "high"):
            again &= q[c][by[1:]] == q[c][by[:-1]]
        keep[some[by[1:][again]]] = False
        return keep

    def earlier(self, i: np.ndarray, other: Postings, j: np.ndarray) -> np.ndarray:
        """Whether line i of these stands before line j of others."""
        return (self.doc[i] < other.doc[j]) | ((self.doc[i] == other.doc[j]) & (self.line[i] < other.line[j]))

    def __len__(self) -> int:
        return len(self.token)


def _similar(x: Postings, i: np.ndarray, y: Postings, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether positions and sketches let x[i] and y[j], which share a token, be similar."""
    a, b, pa_, pb = x.n[i], y.n[j], x.pos[i], y.pos[j]
    need = _overlap(a + b, num, den)
    shown = ((a >= b) & y.index[j]) | ((b >= a) & x.index[i])  # by the smaller one, or by either
    ok = shown & (den * np.minimum(a, b) >= num * np.maximum(a, b)) & (np.minimum(pa_, pb) + np.minimum(a - pa_, b - pb) >= need)
    k = np.flatnonzero(ok)
    apart = np.bitwise_count(x.low[i[k]] ^ y.low[j[k]]).astype(np.int64) + np.bitwise_count(x.high[i[k]] ^ y.high[j[k]])
    ok[k] = apart <= a[k] + b[k] - 2 * need[k]
    return ok


def _ranges(from_: np.ndarray, to: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all j from from_[i] to to[i] - 1, STEP or so at a time; a longer row is cut."""
    count = np.maximum(to - from_, 0)
    ends = np.cumsum(count)
    at, total = 0, int(ends[-1]) if len(ends) else 0
    while at < total:
        till = min(total, at + STEP)
        lo, hi = np.searchsorted(ends, at, side="right"), np.searchsorted(ends, till, side="left") + 1
        rows = np.arange(lo, hi)
        first = np.maximum(at - (ends[rows] - count[rows]), 0)
        last = np.minimum(till - (ends[rows] - count[rows]), count[rows])
        size = last - first
        i = np.repeat(rows, size)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + (from_[rows] + first)[i - lo]
        at = till


class Candidates:
    """Pairs (later, earlier); with few, the first so many of a later line and posting."""

    def __init__(self, p: Postings, few: int | None):
        self.few, self.given, self.later, self.earlier = few, np.zeros(len(p), np.int64), [], []

    def add(self, later: np.ndarray, earlier: np.ndarray) -> None:
        if self.few is not None and len(later):
            order = np.argsort(later, kind="stable")
            later, earlier = later[order], earlier[order]
            start = np.flatnonzero(np.concatenate([[True], later[1:] != later[:-1]]))
            nth = np.arange(len(later)) - np.repeat(start, np.diff(np.append(start, len(later))))
            keep = nth + self.given[later] < self.few
            self.given += np.bincount(later, minlength=len(self.given))
            later, earlier = later[keep], earlier[keep]
        self.later.append(later)
        self.earlier.append(earlier)


def _first_pairs(p: Postings, found: Candidates, num: int, den: int) -> None:
    """Candidates among p: earliest lines of the postings against all first, then all that want for candidates."""
    start = np.flatnonzero(np.concatenate([[True], p.token[1:] != p.token[:-1]])) if len(p) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(p)))
    large = np.flatnonzero(np.repeat(size > 8, size))
    large = large[np.lexsort((p.line[large], p.doc[large], p.token[large]))]
    been = np.zeros(len(p), bool)
    for _ in range(PIVOTS):
        open_ = large[found.given[large] < FEW]
        can = open_[~been[open_]]
        if not len(can):
            break
        pivot = can[np.concatenate([[True], p.token[can[1:]] != p.token[can[:-1]]])]
        been[pivot] = True
        of = np.searchsorted(p.token[pivot], p.token[open_])
        there = of < len(pivot)
        open_, y = open_[there], pivot[of[there]]
        ok = (p.token[open_] == p.token[y]) & p.earlier(y, p, open_)
        open_, y = open_[ok], y[ok]
        ok = _similar(p, open_, p, y, num, den)
        found.add(open_[ok], y[ok])
    wanting = found.given < FEW
    if wanting.all():
        most = p.n * den // num
        y = np.flatnonzero(p.index)
        for i, x in _ranges(y + 1, np.searchsorted(p.place, p.place[y] - np.minimum(p.n[y], LARGE) + np.minimum(most[y], LARGE), side="right")):
            i = y[i]
            ok = _similar(p, x, p, i, num, den)
            x, i = x[ok], i[ok]
            swap = p.earlier(x, p, i)
            later, earlier = np.where(swap, i, x), np.where(swap, x, i)
            new = ~been[earlier]
            found.add(later[new], earlier[new])
        return
    _probe(p, np.flatnonzero(wanting), p, found, num, den, been)


def _probe(x: Postings, rows: np.ndarray, y: Postings, found: Candidates, num: int, den: int, met: np.ndarray | None = None) -> None:
    """Candidates of rows of x among all of y that come earlier, but for those of y that x has met."""
    least, most = -(-x.n[rows] * num // den), x.n[rows] * den // num
    base = x.place[rows] - np.minimum(x.n[rows], LARGE)
    for i, j in _ranges(np.searchsorted(y.place, base + np.minimum(least, LARGE)), np.searchsorted(y.place, base + np.minimum(most, LARGE), side="right")):
        i = rows[i]
        ok = y.earlier(j, x, i)
        if met is not None:
            ok &= ~met[j]
        i, j = i[ok], j[ok]
        ok = _similar(x, i, y, j, num, den)
        found.add(i[ok], j[ok])


def _pairs(num: int, den: int, levels, few: int | None):
    """Per bucket: (later line, earlier line) that all filters let pass; with few, so many a posting.

    A line with so many, which may have more, or with a token of several blocks has a row without an earlier line.
    """

    def run(table: pa.Table) -> pa.Table:
        p = _unpack(table.column("postings").to_pylist())
        pick = lambda rows: {c: v[rows] for c, v in p.items()}
        y = Postings(pick(np.flatnonzero(p["probe"] != PROBING)), num, den)
        x = y if few is not None else Postings(pick(np.flatnonzero(p["probe"] == PROBING)), num, den)
        found = Candidates(x, few)
        if few is not None:
            _first_pairs(x, found, num, den)
        else:
            _probe(x, np.arange(len(x)), y, found, num, den)
        later, earlier = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (found.later, found.earlier))
        again = np.flatnonzero((found.given >= few) | (_blocks(levels.value[x.token >> np.uint32(32 - SLOT_BITS)]) > 1)) if few is not None else np.zeros(0, np.int64)
        none = len(again)
        columns = [np.concatenate([x.doc[later], x.doc[again]]), np.concatenate([x.line[later], x.line[again]])]
        nulls = np.concatenate([np.zeros(len(later), bool), np.ones(none, bool)])
        yd, yl = (pa.array(np.concatenate([v, np.zeros(none, v.dtype)]), mask=nulls) for v in (y.doc[earlier], y.line[earlier]))
        return pa.table([pa.array(columns[0]), pa.array(columns[1]), yd, yl, pa.array(nulls)], schema=PAIR)

    return run


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, line, words) of the asked lines of (doc_id, text, lines): their distinct words as 64-bit hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("words", pa.binary())])
    for b in it:
        doc, line, texts = [], [], []
        for d, text, asked in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            parts = text.split(b"\n")
            for i in asked:
                if i < len(parts):  # rows that share a doc_id may be shorter
                    doc.append(d), line.append(i), texts.append(parts[i])
        if texts:
            yield batch(schema, doc, line, [distinct(h).tobytes() for h in hash_each(texts)])


def _verify(num: int, den: int):
    """Of pairs with their words, whether they are similar; many pairs at a time by one sort."""
    schema = pa.schema([("xd", pa.int64()), ("xl", pa.int32()), ("ok", pa.bool_())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sides = []
            for c in (2, 3):
                raw = b.column(c).to_pylist()
                size = np.array([len(t) // 8 for t in raw], np.int64)
                sides.append((size, np.repeat(np.arange(len(raw)), size), np.frombuffer(b"".join(raw), np.uint64)))
            (a, i, x), (c, j, y) = sides
            of = np.concatenate([i, j])
            # a word of one pair is another value than the same word of the next pair
            both = mix(np.concatenate([x, y]) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            order = np.argsort(both)
            both = both[order]
            common = np.bincount(of[order][1:][both[1:] == both[:-1]], minlength=len(a))
            yield batch(schema, b.column(0), b.column(1), den * common >= num * (a + c - common))

    return run


def repeated_lines(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, lines): the numbers, from 0, of each document's lines to be removed."""
    sc = docs.sparkSession.sparkContext
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"))
    least = _least(num, den)
    found = save(map_arrow(rows, _lines(least), "doc_id long, line int, key long, n int, tokens binary"), "lines")
    # at most one row a slot
    counted = found.where("n < 0").groupBy("key").agg(F.sum(-F.col("n").cast("long")).alias("c")).toArrow()
    table = np.zeros(SLOTS, np.uint8)
    table[counted.column("key").to_numpy()] = np.minimum(255, 4 * np.log2(counted.column("c").to_numpy().astype(np.float64))).astype(np.uint8)
    levels = sc.broadcast(table)
    lines, joined = found.where("n > 0"), found.where("tokens is not null")
    total = joined.agg(F.sum(F.col("n") - F.ceil(F.col("n") * num / den) + 1)).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-int(total) // BUCKET))

    def candidates(probing: DataFrame, few: int | None, wanted=None) -> DataFrame:
        packed = map_arrow(probing.select("doc_id", "line", "key", "n", "tokens", "probe"), _postings(num, den, levels, buckets, wanted), "bucket int, postings binary")
        return packed.groupBy("bucket").applyInArrow(_pairs(num, den, levels, few), "xd long, xl int, yd long, yl int, more boolean")

    def settled(pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(doc_id, line) of the lines that a verified pair removes, and of those that are still open."""
        pairs = save(pairs.distinct(), f"pairs-{name}")
        ends = pairs.where("not more").select(F.explode(F.array(F.struct(F.col("xd").alias("doc_id"), F.col("xl").alias("line")), F.struct(F.col("yd").alias("doc_id"), F.col("yl").alias("line")))).alias("e")).select("e.*")
        asked = ends.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
        # candidates are read again where they stand; the narrow side is hashed, so that whole texts need no sort
        sets = save(map_arrow(rows.join(asked.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "lines"), _sets, "doc_id long, line int, words binary"), f"sets-{name}")
        tx, ty = (sets.select(F.col("doc_id").alias(f"{c}d"), F.col("line").alias(f"{c}l"), F.col("words").alias(f"t{c}")) for c in "xy")
        both = pairs.where("not more").join(ty, ["yd", "yl"]).join(tx, ["xd", "xl"]).select("xd", "xl", "tx", "ty")
        held = map_arrow(both, _verify(num, den), "xd long, xl int, ok boolean")
        gone = save(held.where("ok").select(F.col("xd").alias("doc_id"), F.col("xl").alias("line")).distinct(), f"gone-{name}")
        return gone, pairs.where("more").select(F.col("xd").alias("doc_id"), F.col("xl").alias("line")).join(gone, ["doc_id", "line"], "left_anti")

    gone, open_ = settled(candidates(joined.withColumn("probe", F.lit(True)), FEW), "first")
    open_ = save(open_, "open")
    if not open_.isEmpty():
        asking = save(joined.join(open_, ["doc_id", "line"], "left_semi"), "asking")
        # at most one row a slot
        slots = map_arrow(asking.select("n", "tokens"), _slots(num, den, levels), "slot int").distinct().toArrow()
        wanted = np.zeros(SLOTS, bool)
        wanted[slots.column(0).to_numpy()] = True
        both = joined.withColumn("probe", F.lit(False)).unionByName(asking.withColumn("probe", F.lit(True)))
        gone = gone.union(settled(candidates(both, None, sc.broadcast(wanted)), "rest")[0])

    return _copies(lines).union(gone).groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


#: A key with more than one in so many lines is frequent; there are fewer such keys than this.
FREQUENT = 1024


def _copies(lines: DataFrame) -> DataFrame:
    """(doc_id, line) of all lines of a key but the first. Frequent keys, fewer than FREQUENT, are broadcast."""
    lines = lines.select("key", "doc_id", "line")
    firsts = save(lines.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("c")).where("c > 1"), "firsts")
    total = lines.count()
    frequent = F.broadcast(firsts.where(F.col("c") * FREQUENT > total).select("key", F.col("first").alias("common")))
    marked = lines.join(frequent, "key", "left")
    rest = marked.where("common is null").select("key", "doc_id", "line").join(firsts.where(F.col("c") * FREQUENT <= total).select("key", "first"), "key")
    return marked.where("common is not null").withColumnRenamed("common", "first").unionByName(rest).where(F.struct("doc_id", "line") != F.col("first")).select("doc_id", "line")


def _slots(num: int, den: int, levels):
    """The slots of the prefixes of (n, tokens)."""
    schema = pa.schema([("slot", pa.int32())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gather(it, 1 << 13, 1 << 22):
            n = b.column(0).to_numpy().astype(np.int64)
            tokens = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32)
            of = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            order = np.sort(of << np.uint64(40) | levels.value[tokens >> np.uint32(32 - SLOT_BITS)].astype(np.uint64) << np.uint64(32) | tokens)
            inside = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(_prefix(n, num, den), n)
            yield batch(schema, distinct((order[inside] & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - SLOT_BITS)).astype(np.int32))

    return run


def dedup_lines(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """docs with repeated lines taken out of text, and n_lines, n_removed (long); columns so named are replaced."""
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    doc, gone, salt = (fresh(c, docs.columns) for c in ("_doc", "_lines", "_salt"))
    # rows with a null doc_id match nothing; a salt keeps them from one task
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(1 << 16))).otherwise(0)
    marks = repeated_lines(docs, num, den).select(F.col("doc_id").alias(doc), F.col("lines").alias(gone), F.lit(0).cast("long").alias(fresh("_zero", docs.columns)))
    rows = docs.select(*keep, spread.alias(salt))
    # the narrow side is hashed, so that whole texts need no sort
    out = rows.join(marks.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col(doc)) & (F.col(salt) == F.col(fresh("_zero", docs.columns))), "left")
    total = F.when(F.length("text") > 0, F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    # the numbers that stay are found by one set, not line by line
    numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = let(F.split("text", "\n", -1), lambda lines: F.transform(numbers(lines), lambda i: F.get(lines, i)))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return out.select(*[text.alias(c) if c.lower() == "text" else F.col(c) for c in keep], F.coalesce(total, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))


ORACLE = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i, line, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS w FROM l),
c AS (SELECT w, doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM s WHERE len(w) > 0),
f AS (SELECT row_number() OVER (ORDER BY doc_id, i) AS id, doc_id, i, w, len(w) AS n FROM c WHERE k = 1),
t AS (SELECT id, n, unnest(w) AS x FROM f), d AS (SELECT x, count(*) AS df FROM t GROUP BY x),
p AS (SELECT id, n, x FROM (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY df, x) AS pos FROM t JOIN d USING (x)) WHERE pos <= n - (n * 80 + 99) // 100 + 1),
q AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.x = b.x AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
g AS (SELECT DISTINCT q.b AS id FROM q JOIN f a ON a.id = q.a JOIN f b ON b.id = q.b WHERE 100 * len(list_intersect(a.w, b.w)) >= 80 * (a.n + b.n - len(list_intersect(a.w, b.w)))),
gone AS (SELECT doc_id, i FROM c WHERE k > 1 UNION ALL SELECT doc_id, i FROM f JOIN g USING (id)),
r AS (SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.i) FILTER (WHERE gone.i IS NULL) AS text, count(gone.i) AS n_removed FROM s LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.i = s.i GROUP BY s.doc_id)
SELECT d.doc_id, CASE WHEN r.n_removed > 0 THEN coalesce(r.text, '') ELSE d.text END AS text, CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
