"""Words of texts written without spaces (T21, J14): a lattice of dictionary words, and the cheapest way through it.

A text is cut into runs of letters. All pieces of the distinct runs whose length some word has are joined with the
dictionary, which Spark broadcasts or shuffles by its size; what matches are the edges of a run's lattice. Edges of a run
arrive in order of their starts, so one pass keeps the best way to each place, whatever the length; a run has one state and
no run is held with another. Letters that no word covers are words of their own, at a price. Readings come with the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.scratch import cut

RUN = r"[\p{L}\p{M}\p{N}]+"
#: The price of a letter that no word covers.
UNKNOWN = 20
#: Pieces of one record batch.
PIECES = 1 << 16


def _pieces(lengths: list[int]):
    """(run, start, size, piece) of runs(run, text): a first row with start -1 and the whole text, then all pieces."""
    schema = pa.schema([("run", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("piece", pa.string())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in it:
            for run, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield run, -1, len(text), text
                for n in lengths:
                    for at in range(len(text) - n + 1):
                        yield run, at, n, text[at : at + n]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows(it):
            held.append(row)
            if len(held) == PIECES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return run


class Lattice:
    """The best way to each place of a run: least price, then fewest words, then the longest last word."""

    def __init__(self, text: str, unknown: int):
        self.text, self.unknown = text, unknown
        self.best: list[tuple | None] = [None] * (len(text) + 1)
        self.best[0] = (0, 0, 0, None)
        self.at = 0

    def _offer(self, start: int, end: int, price: int, reading: str | None) -> None:
        cost, n, *_ = self.best[start]
        new = (cost + price, n + 1, start, reading)
        if self.best[end] is None or new[:3] < self.best[end][:3]:
            self.best[end] = new

    def reach(self, place: int) -> None:
        """No edge that starts before `place` comes any more."""
        while self.at < place:
            self._offer(self.at, self.at + 1, self.unknown, None)
            self.at += 1

    def edge(self, start: int, size: int, price: int, reading: str | None) -> None:
        self.reach(start)
        self._offer(start, start + size, price, reading)

    def words(self) -> list[dict]:
        self.reach(len(self.text))
        out, end = [], len(self.text)
        while end:
            _, _, start, reading = self.best[end]
            out.append({"start": start, "word": self.text[start:end], "reading": reading})
            end = start
        return out[::-1]


def _ways(unknown: int):
    """(run, words) of edges(run, start, size, piece, price, reading) that are ordered by run and start."""
    schema = pa.schema([("run", pa.int64()), ("words", pa.list_(pa.struct([("start", pa.int32()), ("word", pa.string()), ("reading", pa.string())])))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lattice = None, None
        for b in it:
            done = []
            for run_, start, size, piece, price, reading in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if start < 0:
                    if lattice is not None:
                        done.append((now, lattice.words()))
                    now, lattice = run_, Lattice(piece, unknown)
                else:
                    lattice.edge(start, size, price, reading)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if lattice is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([lattice.words()], schema.field(1).type)], schema=schema)

    return run


def segment(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", unknown: int = UNKNOWN, fold: Column | None = None) -> DataFrame:
    """(key, place, start, word, reading): the words of texts(key, text) by dictionary(word, price, reading), in order of (place, start).

    place numbers the runs of a text, start a word's first letter in its run, both from 0. Of a word that the dictionary
    names more than once the cheapest counts, then the least reading. fold: what is looked up instead of the text, of
    equal length (lower case, say). Null and empty texts, and those without letters, have no words.
    """
    found = texts.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.col(text) if fold is None else fold, F.lit(RUN), F.lit(0))).alias("place", "run_text"))
    runs = cut(found.select("run_text").distinct().withColumn("run", F.monotonically_increasing_id()))
    words = dictionary.where("word <> ''").groupBy(F.col("word").alias("piece")).agg(F.min(F.struct(F.col("price").cast("int").alias("price"), "reading")).alias("w")).select("piece", "w.price", "w.reading")
    # one number for each length of a word
    lengths = sorted(r.n for r in words.select(F.length("piece").alias("n")).distinct().collect())
    pieces = runs.select("run", "run_text").mapInArrow(_pieces(lengths), "run long, start int, size int, piece string")
    inner = pieces.where("start >= 0").join(words, "piece").select("run", "start", "size", F.lit(None).cast("string").alias("piece"), "price", "reading")
    whole = pieces.where("start < 0").select("run", "start", "size", "piece", F.lit(0).alias("price"), F.lit(None).cast("string").alias("reading"))
    edges = whole.unionByName(inner).repartition("run").sortWithinPartitions("run", "start", "size")
    ways = edges.mapInArrow(_ways(unknown), "run long, words array<struct<start: int, word: string, reading: string>>")
    by_text = ways.join(runs, "run").select("run_text", "words")
    out = found.join(by_text, "run_text").select("key", "place", F.explode("words").alias("w"))
    return out.select(F.col("key").alias(key), "place", "w.start", "w.word", "w.reading")
