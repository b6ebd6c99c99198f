"""Operator 3: SentencePiece encoding and decoding with forward states shared by common prefixes.

A text is marked (a space becomes U+2581, one is put in front) and cut into words where no piece can cross. The
distinct words of a batch are sorted, which is the depth-first order of their trie: the forward state of each
prefix is computed once and kept on a stack while words share it. With it go the places in the trie of pieces that
the suffixes of the prefix have reached, so that only pieces which really occur are looked at.

The forward state depends on the model file's kind:

    unigram  Viterbi: the best score of a segmentation of the prefix, and its last piece.
    BPE      the last piece of the prefix's merge result. Best sums of BPE scores (ranks of merges) are not what
             merging gives, so scores can't be added up here. But the last piece is unique and follows from shorter
             prefixes: a piece that merging rebuilds from its own characters, and that merging leaves next to the last
             piece of what precedes it. The result equals the library's merge order. Whether merging leaves two
             pieces side by side is read off the last merges along their common edge, undone from the latest on.

Characters without a piece become byte pieces. Decoding joins pieces, turns marks into spaces and drops the first.
Round trips are exact but that U+2581 itself becomes a space, and bytes that are no UTF-8 become U+FFFD; round_trip is
false for such texts.

A null text has null ids, an empty one none; an empty table gives no rows. Rows are kept one to one, with their extra
columns, so repeated rows need no rule; of pieces of equal rank the leftmost merges first. Very long words cost in
proportion to their length. The map over the scan needs no shuffle; memory holds one batch and a cache of CACHE words.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, quoted, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker keeps (about 200 bytes each, and a third as many pairs of pieces); texts cut at a time.
CACHE, ROWS = 600_000, 250
#: Kinds of models and pieces in the file format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A character without a piece scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        c = b[i]
        i += 1
        value |= (c & 127) << shift
        shift += 7
        if c < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


def parse_model(raw: bytes) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, type) by id, and the kind of the model."""
    pieces, kind = [], UNIGRAM
    for field, value in _fields(raw):
        if field == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif field == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
    return pieces, kind


class Codec:
    def __init__(self, pieces: list[tuple[str, float, int]], kind: int):
        self.kind, self.cache = kind, CACHE
        self.score = {p: s for p, s, t in pieces if t in (NORMAL, USER)}
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte = {int(p[1:-1], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
        self.longest = max(map(len, self.id), default=1)
        self.worst = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        self.bytes = [of_byte.get(i, b"" if t in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode()) for i, (p, _, t) in enumerate(pieces)]
        # runs of marks form pieces of their own after all other merges; nothing else has a mark but in front
        run = re.compile(f"{MARK}*")
        self.simple = all(MARK not in p[1:] or run.fullmatch(p) for p in self.id)
        self.cut = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if not any("\n" in p for p in self.id) else f"{MARK}+[^{MARK}]*|[^{MARK}]+") if self.simple else re.compile(".+", re.S)
        self.beside: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.order: dict[str, bool] = {}
        self.last: tuple[str, str] | None = None
        #: Words' places in the tables below: their ids one behind the other, where those begin, whether they decode to the word.
        self.place: dict[str, int] = {}
        self.flat, self.start, self.exact = array("i"), array("i", [0]), bytearray()
        self.runs: dict[int, tuple[str, ...]] = {}
        self.root: dict = {}
        for p in self.id:
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p

    # --- BPE ---

    def merged(self, text: str) -> list[str]:
        """Merge the adjacent pair of the best score, the leftmost first, until none is a piece."""
        parts, score = list(text), self.score
        n, self.last = len(parts), None
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (s := score.get(p := parts[i] + parts[j])) is not None:
                heapq.heappush(agenda, (-s, i, p))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, p = heapq.heappop(agenda)
            j = right[i] if parts[i] else -1
            if j < 0 or parts[i] + parts[j] != p:
                continue
            self.last = parts[i], parts[j]
            parts[i], parts[j] = p, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [p for p in parts if p]

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """What a piece is merged from in the end ("", "" for one character); None if merging never gives it.

        None also if a half ranks behind the whole: merges then don't come in the order of their ranks.
        """
        if piece not in self.halves:
            found = None
            if len(piece) == 1:
                found = "", ""
            elif self.merged(piece) == [piece]:
                found = self.last
            self.halves[piece] = found
        return self.halves[piece]

    def _ordered(self, piece: str) -> bool:
        """Whether all merges that lead to the piece come in the order of their ranks."""
        if len(piece) == 1:
            return True
        if piece not in self.order:
            halves = self._halves(piece)
            self.order[piece] = halves is not None and all(len(h) == 1 or self.score[h] > self.score[piece] and self._ordered(h) for h in halves)
        return self.order[piece]

    def _fits(self, before: str, piece: str) -> bool:
        """Whether merging leaves the piece whole, next to `before`."""
        pair = before, piece
        ok = self.beside.get(pair)
        if ok is None:
            if len(self.beside) > self.cache // 3:
                self.beside.clear()
            ok = self._halves(piece) is not None
            if ok and before:
                ok = self._stay(before, piece) if self._ordered(before) and self._ordered(piece) else self.merged(before + piece) == [before, piece]
            self.beside[pair] = ok
        return ok

    def _stay(self, left: str, right: str) -> bool:
        """Undo the latest merge at either edge, again and again: no pair that stood there may merge before it."""
        score, halves = self.score, self.halves
        left_until = right_until = float("-inf")  # scores at which these were merged into what encloses them
        while True:
            s = score.get(left + right)
            if s is not None and s > left_until and s >= right_until:  # of equal ones the leftmost comes first
                return False
            if len(left) == 1 and len(right) == 1:
                return True
            if len(right) == 1 or len(left) > 1 and score[left] < score[right]:
                left_until = score[left]
                left = halves[left][1]
            else:
                right_until = score[right]
                right = halves[right][0]

    # --- the walk over sorted words ---

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """The pieces of each of the sorted distinct words; a character without a piece stands for itself."""
        last, best, reached, before = [""], [0.0], [[]], ""
        step = self._unigram_step if self.kind == UNIGRAM else self._merge_step
        for word in words:
            common = 0
            for a, b in zip(word, before, strict=False):
                if a != b:
                    break
                common += 1
            del last[common + 1 :], best[common + 1 :], reached[common + 1 :]
            step(word, common, last, best, reached)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            out.reverse()
            yield word, out
            before = word

    def _merge_step(self, word: str, common: int, last: list[str], best: list[float], reached: list[list]) -> None:
        """States of the prefixes of word beyond `common`; reached: (start, trie node) of the suffixes that go on."""
        root, beside, fits, open_ = self.root.get, self.beside.get, self._fits, reached[-1]
        for end in range(common, len(word)):
            piece = c = word[end]
            now = []
            for start, node in open_:
                node = node.get(c)
                if node is not None:
                    now.append((start, node))
                    if piece is c and (p := node.get("")) is not None:
                        ok = beside((last[start], p))
                        if ok if ok is not None else fits(last[start], p):
                            piece = p
            node = root(c)
            if node is not None:
                now.append((end, node))
            last.append(piece)
            reached.append(now)
            open_ = now

    def _unigram_step(self, word: str, common: int, last: list[str], best: list[float], reached: list[list]) -> None:
        for end in range(common, len(word)):
            piece = c = word[end]
            top, now = best[end] + self.worst, []
            for start, node in [*reached[end], (end, self.root)]:
                node = node.get(c)
                if node is not None:
                    now.append((start, node))
                    if (p := node.get("")) is not None and best[start] + self.score[p] > top:
                        top, piece = best[start] + self.score[p], p
            last.append(piece)
            best.append(top)
            reached.append(now)

    def ids(self, pieces: list[str]) -> tuple[int, ...]:
        out = []
        for p in pieces:
            i = self.id.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[b] for b in p.encode("utf-8", "replace"))
            else:
                out.append(self.unknown)
        return tuple(out)

    def _learn(self, words: set[str]) -> None:
        """Fill the cache. Of a BPE word with several marks in front, those before the last are merged apart.

        A full cache keeps the words that are met again, which frequent ones are in every batch.
        """
        if len(self.place) > self.cache:
            kept, flat, start, exact = [w for w in words if w in self.place], self.flat, self.start, self.exact
            self.flat, self.start, self.exact = array("i"), array("i", [0]), bytearray()
            for i in map(self.place.__getitem__, kept):
                self._add(flat[start[i] : start[i + 1]], exact[i])
            self.place = {w: i for i, w in enumerate(kept)}
        new = [w for w in words if w not in self.place]
        heads = {w: MARK + w.lstrip(MARK) for w in new if w.startswith(MARK + MARK)} if self.kind == BPE and self.simple else {}
        if not heads:
            for w, pieces in self.segment(sorted(new)):
                self._store(w, pieces)
            return
        found = dict(self.segment(sorted({heads.get(w, w) for w in new})))
        for w in new:
            pieces = found[heads.get(w, w)]
            if w in heads:
                marks = len(w) - len(heads[w]) + (pieces[0] == MARK)
                if marks not in self.runs:
                    self.runs[marks] = tuple(self.merged(MARK * marks))
                pieces = [*self.runs[marks], *pieces[pieces[0] == MARK :]]
            self._store(w, pieces)

    def _store(self, word: str, pieces: list[str]) -> None:
        ids = list(map(self.id.get, pieces))
        if None in ids:
            ids = self.ids(pieces)
        self.place[word] = len(self.exact)
        self._add(ids, b"".join(map(self.bytes.__getitem__, ids)) == word.replace(MARK, " ").encode("utf-8", "surrogatepass"))

    def _add(self, ids, exact: bool) -> None:
        self.flat.extend(ids)
        self.start.append(len(self.flat))
        self.exact.append(exact)

    def cut_words(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode_batch(self, texts: list[str | None]) -> tuple[pa.ListArray, list[bool | None]]:
        """The ids of each text, and whether they decode to it; words are encoded and decoded once."""
        cut = [None if t is None else self.cut_words(t) for t in texts]
        self._learn(set(chain.from_iterable(c for c in cut if c)))
        bare = np.concatenate([[0], np.cumsum([len(c or ()) for c in cut], dtype=np.int64)])
        places = np.fromiter(map(self.place.__getitem__, chain.from_iterable(c for c in cut if c)), np.int64, int(bare[-1]))
        none = pa.array([c is None for c in cut], pa.bool_())
        del cut
        start, flat = np.array(self.start, np.int64), np.array(self.flat, np.int32)
        first = start[places]
        long = start[places + 1] - first
        ends = np.concatenate([[0], np.cumsum(long)])
        at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], long)
        offsets, found = ends[bare], flat[at]
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()), mask=none)
        # texts of words that decode to themselves do so too; what is left is decoded as a whole
        odd = np.concatenate([[0], np.cumsum(np.frombuffer(bytes(self.exact), np.uint8)[places] == 0)])[bare]
        back = lambda i: self.decode(found[offsets[i] : offsets[i + 1]].tolist())
        # a mark in the text itself becomes a space
        same = [None if t is None else bool(odd[i] == odd[i + 1] and MARK not in t) or back(i) == t for i, t in enumerate(texts)]
        return ids, same

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        return self.encode_batch(texts)[0].to_pylist()

    def decode(self, ids: list[int] | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def load(path: str) -> dict:
    """The model as a value to broadcast; the file is on the driver and far below its memory."""
    with open(path, "rb") as f:
        return {"model": parse_model(f.read())}


def codec_of(held: dict) -> Codec:
    """The worker's codec: a reused worker keeps the broadcast value, and with it what the codec has learnt."""
    if "codec" not in held:
        held["codec"] = Codec(*held["model"])
    return held["codec"]


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """docs with ids array<int>, and round_trip: whether decoding gives the text back; columns so named are replaced.

    cache: the words that a worker keeps; fewer cost time, not results.
    """
    keep = quoted([c for c in docs.columns if c.lower() not in ("ids", "round_trip")])
    shared = docs.sparkSession.sparkContext.broadcast(load(model))
    rows = docs.select(F.struct(*keep).alias("row"), text_bytes(text_col).alias("bytes"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        codec.cache = cache
        for b in chain.from_iterable((big.slice(i, ROWS) for i in range(0, big.num_rows, ROWS)) for big in it):
            given = b.column(1).to_pylist()
            texts = [None if t is None else t.decode("utf-8", "replace") for t in given]
            ids, same = codec.encode_batch(texts)
            # bytes that are no UTF-8 have become U+FFFD
            same = [s and ("\ufffd" not in t or t.encode() == g) for s, t, g in zip(same, texts, given, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(same, pa.bool_())], names=["row", "ids", "round_trip"])

    kind = rows.schema["row"].dataType.simpleString()
    return map_arrow(rows, run, f"row {kind}, ids array<int>, round_trip boolean").select("row.*", "ids", "round_trip")


def decode(tokens: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """tokens with decoded string; a column so named is replaced."""
    keep = quoted([c for c in tokens.columns if c.lower() != "decoded"])
    shared = tokens.sparkSession.sparkContext.broadcast(load(model))
    rows = tokens.select(F.struct(*keep).alias("row"), F.col(ids_col).cast("array<int>").alias("codes"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(i) for i in b.column(1).to_pylist()], pa.string())], names=["row", "decoded"])

    kind = rows.schema["row"].dataType.simpleString()
    return map_arrow(rows, run, f"row {kind}, decoded string").select("row.*", "decoded")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")
