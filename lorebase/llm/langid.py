"""Operator 7: language identification by nearest centroid.

Texts become L2-normalised TF-IDF vectors of hashed byte n-grams (2, 3 and 4 bytes, ASCII case folded, other ASCII
characters than letters made spaces). Each language has several centroids, found by spherical k-means over a sample of
labelled rows; a text takes the language of the centroid of largest cosine. A text whose cosine is below the model's
limit for texts of its size is rejected: its distance from every language is far beyond that of the sample. Sizes are
classed by EDGES (bytes of letters); texts below the first, or in a class of which the sample has fewer than MIN_SAMPLES,
are labelled whatever their distance, for so few n-grams tell nothing.

The classifier is fitted on a bounded sample (PER_LANG rows a language, SAMPLE_MAX in all, those of smallest id
hash, of the LANGS most frequent labels); everything else covers all rows and whole texts. Prediction is one map over the scan, without a shuffle.

Null texts and texts without a letter are `und` with score 0 and rejected. With nothing to learn from, all are
`und`. A null doc_id counts as the empty string in the split. Ties between centroids go to the first language in
alphabetical order. Rows are kept one to one, repeated ones too; an empty table gives no rows. Very long texts are counted in
blocks of bounded size. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, map_arrow, quoted, text_bytes

DIM_BITS = 15
PER_LANG, SAMPLE_MAX = 400, 4000
#: Labels that are learnt, the most frequent ones: bounds the model, which every task holds.
LANGS = 200
CENTROIDS = 3
EDGES, MIN_SAMPLES = (50, 100, 200), 20
#: The limit is this share of the sample's cosine at the given quantile.
LIMIT_SHARE, LIMIT_QUANTILE = 0.6, 0.001

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BLOCK = 1 << 20


def ngram_counts(text: bytes) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams, and the number of letters (bytes that are no space after folding)."""
    folded = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    dim, shift = 1 << DIM_BITS, np.uint32(32 - DIM_BITS)
    counts = np.zeros(dim, np.int64)
    # blocks overlap by three bytes, so that memory doesn't grow with the text; each n-gram is counted where it begins
    for at in range(0, len(folded), _BLOCK):
        a = np.frombuffer(folded[at : at + _BLOCK + 3], np.uint8).astype(np.uint32)
        own = min(_BLOCK, len(folded) - at)
        h = a
        for n in (2, 3, 4):
            h = h[: len(a) - n + 1] * np.uint32(0x01000193) ^ a[n - 1 :]
            if len(h):
                counts += np.bincount(((h[:own] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> shift, minlength=dim)
    return counts, len(folded) - folded.count(b" ")


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray  # dim x (langs * CENTROIDS)
    limits: tuple[float, ...]  # by size class


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the normalised TF-IDF vector."""
    at = np.flatnonzero(counts)
    w = (1 + np.log(counts[at])) * idf[at]
    return at, w / max(float(np.sqrt(w @ w)), 1e-12)


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from rows far from each other."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(axis=1))))
    c = x[start]
    for _ in range(12):
        of = np.argmax(x @ c.T, axis=1)
        c = np.array([m / max(float(np.linalg.norm(m)), 1e-12) for m in (x[of == i].sum(axis=0) if (of == i).any() else c[i] for i in range(len(c)))])
    return np.concatenate([c, np.repeat(c[:1], k - len(c), axis=0)])


def fit(labels: list[str], rows: list[tuple[np.ndarray, np.ndarray]], sizes: list[int]) -> Model | None:
    """rows: places and counts of each sampled text."""
    if not rows:
        return None
    dim, langs = 1 << DIM_BITS, tuple(sorted(set(labels)))
    df = np.zeros(dim)
    for at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    own_rows = [np.flatnonzero(np.array(labels) == lang) for lang in langs]

    def dense(which: np.ndarray) -> np.ndarray:
        """The vectors of one language's rows; only these are held at a time, PER_LANG * 2^DIM_BITS floats at most."""
        out = np.zeros((len(which), dim), np.float32)
        for i, r in enumerate(which.tolist()):
            at, c = rows[r]
            w = (1 + np.log(c)) * idf[at]
            out[i, at] = w / max(float(np.sqrt(w @ w)), 1e-12)
        return out

    centroids = np.concatenate([_k_means(dense(which), CENTROIDS) for which in own_rows]).T.astype(np.float32)
    best = np.zeros(len(rows), np.float32)
    for which in own_rows:
        best[which] = (dense(which) @ centroids).max(axis=1)
    of = size_class(np.array(sizes))
    own = [best[of == i] for i in range(len(EDGES))]
    limits = tuple(LIMIT_SHARE * float(np.quantile(b, LIMIT_QUANTILE)) if len(b) >= MIN_SAMPLES else 0.0 for b in own)
    return Model(langs, idf.astype(np.float32), np.ascontiguousarray(centroids), limits)


def size_class(size):
    """The class of a text by its letters, -1 below all edges."""
    return np.searchsorted(EDGES, size, side="right") - 1


def _remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(4))


def learn(docs: DataFrame) -> Model | None:
    """Fit on labelled rows outside the held-out quarter."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (_remainder(F.col("doc_id")) != 2) & F.regexp(F.coalesce("text", F.lit("")), F.lit(r"\p{L}")))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS).collect()}
    if not sizes:
        return None
    per = max(1, min(PER_LANG, SAMPLE_MAX // len(sizes)))
    draw = F.xxhash64(F.col("doc_id"), F.lit(7))
    # about 1.5 times as many as wanted pass the hash limit; the window only sees those
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (1.5 * per + 20) / n))])
    near = usable.select("lang", text_bytes("text").alias("text"), draw.alias("draw")).where(F.col("draw").cast("double") / 2.0**64 + 0.5 < share[F.col("lang")])
    schema = pa.schema([("lang", pa.string()), ("draw", pa.int64()), ("at", pa.binary()), ("n", pa.binary()), ("size", pa.int64())])

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for lang, text, draw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                counts, size = ngram_counts(text)
                at = np.flatnonzero(counts)
                yield batch(schema, [lang], [draw], [at.astype(np.uint16).tobytes()], [counts[at].astype(np.uint32).tobytes()], [size])

    ranked = map_arrow(near, counted, "lang string, draw long, at binary, n binary, size long").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "at", "n"))).where(F.col("k") <= per)
    rows = ranked.orderBy("lang", "k").collect()
    return fit([r["lang"] for r in rows], [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.uint32).astype(np.float64)) for r in rows], [r["size"] for r in rows])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and rejected; columns so named are replaced."""
    keep = quoted([c for c in docs.columns if c.lower() not in ("lang_pred", "score", "rejected")])
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.langs, model.idf, model.centroids, model.limits))
    rows = docs.select(F.struct(*keep).alias("row"), text_bytes("text").alias("bytes"), F.coalesce(F.regexp("text", F.lit(r"\p{L}")), F.lit(False)).alias("letters"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs_of, idf, centroids, limits = shared.value or ((), None, None, ())
        for b in it:
            langs, scores, rejected = [], [], []
            for text, letters in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not letters or not langs_of:
                    langs.append("und"), scores.append(0.0), rejected.append(not letters)
                    continue
                counts, size = ngram_counts(text)
                at, w = vector(counts, idf)
                cosines = w.astype(np.float32) @ centroids[at]
                best = int(np.argmax(cosines))
                score = min(1.0, max(0.0, float(cosines[best])))
                langs.append(langs_of[best // CENTROIDS]), scores.append(score), rejected.append((at_class := int(size_class(size))) >= 0 and score < limits[at_class])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["row", "lang_pred", "score", "rejected"])

    kind = rows.schema["row"].dataType.simpleString()
    out = map_arrow(rows, run, f"row {kind}, lang_pred string, score double, rejected boolean")
    return out.select("row.*", "lang_pred", "score", "rejected")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = docs.select("doc_id", "text", (_remainder(F.col("doc_id")) == 2).alias("held_out"))
    return predict(held, learn(docs)).select("doc_id", "held_out", "lang_pred", "score", "rejected")
