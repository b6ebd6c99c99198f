"""Vector ranking (V1-V10, V14-V22, A7, A15, O1-O4): exact cosine with a tag boost, listings, bulk neighbours.

Filters run before scoring. A single query is one projection over the scan and a TakeOrderedAndProject; many queries
go block by block against partitions of the corpus in Arrow batches, each partition keeping its best n per query and
skipping groups of rows that can't be among them.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions import constants as K
from lorebase.scratch import scratch_dir, segments

from .filters import Filters, has_all_tags


def cosine(embedding: Column, query: list[float] | Column) -> Column:
    """Dot product in doubles; vectors are of unit length."""
    q = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(embedding, q, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def search(corpus: DataFrame, vector: list[float], n: int = 10, filters: Filters | None = None, ref_tags: list[str] | None = None, exclude: list[str] | None = None, boost: float = K.TAG_BOOST) -> DataFrame:
    """The n best rows by cosine + boost * Jaccard, ties in index order, with score and cosine."""
    kept = corpus.where(filters.predicate()) if filters else corpus
    if exclude:
        kept = kept.where(~F.col("url").isin(*exclude))
    scored = kept.withColumn("cosine", cosine(F.col("embedding"), vector))
    extra = F.lit(boost) * jaccard(F.array(*map(F.lit, sorted(set(ref_tags)))), F.col("tags")) if ref_tags else F.lit(0.0)
    return scored.withColumn("score", F.col("cosine") + extra).orderBy(F.desc("score"), "row_id").limit(n)


def vector_for(corpus: DataFrame, url: str) -> list[float]:
    row = corpus.where(F.col("url") == url).select("embedding").first()
    if row is None:
        raise KeyError(url)
    return list(row.embedding)


def like(corpus: DataFrame, seed_url: str, n: int = 10, filters: Filters | None = None) -> DataFrame:
    """More like a stored row: its vector and tags, without itself."""
    seed = corpus.where(F.col("url") == seed_url).select("embedding", "tags").first()
    if seed is None:
        raise KeyError(seed_url)
    return search(corpus, list(seed.embedding), n, filters, list(seed.tags), [seed_url])


#: Rows of a free-text answer, by default and at most.
ANSWER, ANSWER_MAX = 12, 40


def answer(corpus: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray] | None, n: int = ANSWER, category: str | None = None) -> tuple[DataFrame | None, str | None]:
    """(rows, None) for a page, or (None, why) where there is no text or no model; never more than ANSWER_MAX rows."""
    if not text.strip():
        return None, "the query is empty"
    if encode is None:
        return None, "no model is loaded"
    return query(corpus, text, encode, max(1, min(n, ANSWER_MAX)), Filters(categories=frozenset({category} if category else ()))), None


def query(corpus: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], n: int = 10, filters: Filters | None = None, parsed: tuple[str, set[str], Filters] | None = None) -> DataFrame:
    """Free text; what a parser found fills in what the caller left open (0 counts as open)."""
    text, tags, found = parsed or (text, set(), Filters())
    given = filters or Filters()
    merged = Filters(**{k: getattr(given, k) or getattr(found, k) for k in vars(given)})
    return search(corpus, encode([text])[0].tolist(), n, merged, sorted(given.require_tags | tags))


def similar(corpus: DataFrame, url: str | None, n: int = 12, category: str | None = None) -> DataFrame:
    """Neighbours for a page: empty for an unknown row, 40 at most."""
    seed = corpus.where(F.col("url") == url).select("embedding", "tags").first() if url else None
    if seed is None:
        return corpus.limit(0).withColumn("cosine", F.lit(0.0)).withColumn("score", F.lit(0.0))
    return search(corpus, list(seed.embedding), min(n, 40), Filters(categories=frozenset({category} if category else ())), list(seed.tags), [url])


def tag_listing(corpus: DataFrame, tags: list[str], n: int = 20, status: str | None = None, category: str | None = None) -> DataFrame:
    """Rows with all tags, by (overlap, year_month) descending, then index order; total counts them before the limit."""
    f = Filters(status=status, categories=frozenset({category} if category else ()))
    rows = corpus.where(f.predicate() & has_all_tags(tags))
    overlap = F.size(F.array_intersect("tags", F.array(*map(F.lit, sorted(set(tags))))))
    total = rows.agg(F.count("*").alias("total"))
    top = rows.withColumn("overlap", overlap).withColumn("score", F.lit(0.0)).orderBy(F.desc("overlap"), F.desc("year_month"), "row_id").limit(n)
    return top.crossJoin(F.broadcast(total))  # one row


def library_search(corpus: DataFrame, text: str | None = None, n: int = 30, downloaded_only: bool = False) -> DataFrame:
    from .filters import matches_text

    rows = corpus.where(matches_text(text)) if text else corpus
    rows = rows.where(F.col("file").isNotNull()) if downloaded_only else rows
    return rows.orderBy(F.desc("upload_date"), F.desc("title"), "row_id").limit(min(n, 100))


def top_tags(corpus: DataFrame, n: int = 18) -> DataFrame:
    """Most common tags; ties in the order they are met first."""
    each = corpus.select("row_id", F.posexplode("tags").alias("pos", "tag"))
    return each.groupBy("tag").agg(F.count("*").alias("n"), F.min(F.struct("row_id", "pos")).alias("first")).orderBy(F.desc("n"), "first").limit(min(n, 60)).select("tag", "n")


def top_per_category(corpus: DataFrame, n: int, *order: Column, by: str = "category") -> DataFrame:
    return corpus.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def demo_selection(corpus: DataFrame, n: int) -> DataFrame:
    """Displayable rows of each category: finished ones first, then the newest."""
    from .filters import displayable

    return top_per_category(corpus.where(displayable()), n, (F.col("status") != K.DONE).cast("int"), F.desc("upload_date"), F.col("url"))


def categories(corpus: DataFrame) -> DataFrame:
    return corpus.select("category").distinct().orderBy("category")


# --- many queries ---


#: Bytes of a block of queries and of its scores at a time; rows that are looked at together; of the sample.
QUERY_BYTES, SCORE_BYTES, CORPUS_BYTES, SAMPLE_BYTES = 8 << 20, 32 << 20, 32 << 20, 16 << 20
#: Centres that rows are grouped around; rounds of fitting them; rows found that a task keeps before it drops the worse ones.
CENTRES, ROUNDS, HELD = 64, 5, 1 << 20
#: Scores are compared to this many places, and bounds are wider by more than rounding can be.
PLACES, SLACK = 12, 1e-9


def fit_centres(x: np.ndarray, k: int = CENTRES) -> np.ndarray:
    """Centres of the rows, spread over them by steps and moved to their groups' means a few times."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(np.int64)]
    if not len(x):
        return centres
    for _ in range(ROUNDS):
        of = nearest(x, centres)
        sums, size = np.zeros_like(centres), np.bincount(of, minlength=len(centres))
        np.add.at(sums, of, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)


class Neighbours:
    """The n best rows of each query among those it is shown.

    Rows are grouped around centres. Of a group no row can score above query x centre + |query| x radius, so queries whose
    n-th best is better already skip it. least: scores that n rows are known to reach.
    """

    def __init__(self, q: np.ndarray, centres: np.ndarray, n: int, least: np.ndarray | None = None):
        self.q, self.centres, self.n = q, centres, n
        self.least = np.full(len(q), -np.inf) if least is None else least.copy()
        self.size, self.to_centre = np.linalg.norm(q, axis=1), q @ centres.T
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = self.asked = self.skipped = 0

    def show(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids):
            return
        of = nearest(x, self.centres)
        order = np.argsort(of, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else ():
            c = int(of[group[0]])
            radius = np.linalg.norm(x[group] - self.centres[c], axis=1).max()
            open_ = np.flatnonzero(self.to_centre[:, c] + self.size * radius + SLACK >= self.least)
            self.asked, self.skipped = self.asked + len(self.q), self.skipped + len(self.q) - len(open_)
            step = max(1, SCORE_BYTES // (8 * max(1, len(open_))))
            for at in range(0, len(group) if len(open_) else 0, step):
                rows = group[at : at + step]
                raw = self.q[open_] @ x[rows].T
                score = np.round(raw, PLACES)
                i, j = np.nonzero(score >= self.least[open_][:, None])
                self.found.append((open_[i], score[i, j], raw[i, j], ids[rows[j]]))
                self.held += len(i)
                if self.held > HELD:
                    self.best()
        self.best()

    def best(self) -> tuple[np.ndarray, ...]:
        """(query, score, raw score, id) of the n best so far; what is worse is forgotten."""
        none = np.zeros(0, np.int64)
        query, score, raw, ids = (np.concatenate(c) for c in zip((none, none.astype(float), none.astype(float), none), *self.found, strict=True))
        order = np.lexsort((ids, -score, query))
        first = np.searchsorted(query[order], np.arange(len(self.q)))
        order = order[np.arange(len(order)) - first[query[order]] < self.n]
        query, score, raw, ids = query[order], score[order], raw[order], ids[order]
        last = np.searchsorted(query, np.arange(len(self.q)), side="right") - 1
        full = np.bincount(query, minlength=len(self.q)) >= self.n
        self.least[full] = np.maximum(self.least[full], score[last[full]])
        self.found, self.held = [(query, score, raw, ids)], len(query)
        return self.found[0]


def knn_join(queries: DataFrame, corpus: DataFrame, n: int = 10, block: int | None = None) -> DataFrame:
    """(query_id, row_id, cosine, rank): the n nearest rows of each query(query_id, embedding), exactly, by blocks of queries.

    Queries are a stated set, taken in blocks of QUERY_BYTES (or so many). Every task groups its rows around centres and skips,
    query by query, groups that can't reach the n-th best so far; only rows among the best of a task are shuffled. Centres
    and first limits come from a bounded sample of the corpus: it decides what can be skipped, not what is found. With
    several blocks one is at work at a time: its rows are written before its vectors are dropped and the next one is read.
    """
    spark = corpus.sparkSession
    first = queries.select(F.size("embedding")).first()
    if first is None:
        return spark.createDataFrame([], "query_id long, row_id long, cosine double, rank int")
    block = block or max(1, QUERY_BYTES // (8 * max(1, first[0])))
    blocks = max(1, -(-queries.count() // block))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", PLACES)), "row_id")
    schema = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("cosine", pa.float64())])
    vectors = lambda rows: np.array([r.embedding for r in rows], np.float64).reshape(len(rows), first[0])
    sample = vectors(corpus.select("embedding").limit(max(n, SAMPLE_BYTES // (8 * max(1, first[0])))).collect())
    centres = fit_centres(sample)

    def scan(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, least = shared.value
            near = Neighbours(q, centres_of.value, n, least)
            for b in it:
                step = max(1, CORPUS_BYTES // (8 * q.shape[1]))
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    near.show(part.column(0).to_numpy(), np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1).astype(np.float64))
            query, _, raw, ids = near.best()
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(ids), pa.array(raw)], schema=schema)

        return run

    out = f"{scratch_dir(spark)}/knn-{uuid.uuid4().hex}"
    centres_of = spark.sparkContext.broadcast(centres)
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "embedding").orderBy("query_id").collect()
        if not rows:
            continue
        q = vectors(rows)
        known = Neighbours(q, centres, n)
        known.show(np.arange(len(sample)), sample)
        shared = spark.sparkContext.broadcast((np.array([r.query_id for r in rows], np.int64), q, known.least))
        found = corpus.select(F.col("row_id").cast("long"), "embedding").mapInArrow(scan(shared), "query_id long, row_id long, cosine double")
        best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)
        if blocks == 1:
            return best
        best.write.mode("append").parquet(out)
        shared.destroy()
    return spark.read.schema("query_id long, row_id long, cosine double, rank int").parquet(out)


# --- index ---


class HashingEncoder:
    """A deterministic encoder for tests and machines without a model: signed hashed character n-grams, unit length."""

    def __init__(self, dim: int = 64, name: str = "hashing", prefix: str = ""):
        self.dim, self.name, self.prefix = dim, f"{name}-{dim}", prefix

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for n in (1, 2, 3):
                for at in range(len(t) - n + 1):
                    h = int.from_bytes(hashlib.blake2b(t[at : at + n].encode(), digest_size=8).digest(), "little")
                    out[i, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def query(self, texts: list[str]) -> np.ndarray:
        return self([self.prefix + t for t in texts])


def encode_column(encoder: Callable[[list[str]], np.ndarray], batch: int = 32):
    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        parts = [encoder(text.iloc[i : i + batch].fillna("").tolist()) for i in range(0, len(text), batch)]
        return pd.Series([v for p in parts for v in p.astype(np.float32)], dtype=object)

    return run


def build_index(records: DataFrame, old: DataFrame | None, model: str, encoder: Callable[[list[str]], np.ndarray]) -> tuple[DataFrame, dict[str, int]]:
    """(index, counts): a vector is kept where model, url and hash are the same; gone urls go; nothing new needs no model."""
    from lorebase.functions.scalars import embed_text

    ordered = records.select("url", "content_hash", "upload_date", embed_text(*[F.col(c) for c in ("title", "tags", "one_liner", "synopsis", "excerpt")]).alias("text"))
    if old is None:
        joined = ordered.withColumn("embedding", F.lit(None).cast("array<float>"))
    else:
        joined = ordered.join(old.where(F.col("model") == model).select("url", "content_hash", "embedding"), ["url", "content_hash"], "left")
    counts = joined.agg(F.count("*").alias("total"), F.count_if(F.col("embedding").isNull()).alias("embedded")).first()
    if not counts.total:
        raise ValueError("the store is empty")
    fresh = joined.where("embedding is null")
    fresh = fresh.withColumn("embedding", encode_column(encoder)("text")) if counts.embedded else fresh
    both = joined.where("embedding is not null").unionByName(fresh)
    # the index row order is (upload_date, url): numbered range by range, without one task for all rows
    # ranges are cut by a sample, so they are written once: dealt again for their sizes, they would have other bounds
    ranged = segments(both, F.col("upload_date"), F.col("url")).withColumn("k", F.row_number().over(Window.partitionBy("_p").orderBy("upload_date", "url")))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("c"))
    offsets = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    index = ranged.join(offsets, "_p").select("url", (F.col("before") + F.col("k") - 1).alias("row_id"), "content_hash", F.lit(model).alias("model"), "embedding")
    return index, {"total": counts.total, "embedded": counts.embedded, "reused": counts.total - counts.embedded}


#: Numbers of the moments that are added up in one place.
MOMENTS = 1 << 16


def pca_map(index: DataFrame) -> DataFrame:
    """(row_id, x, y): centred rows on their two main directions, scaled to [-1, 1]; the largest loading is positive.

    Sums and the d x d second moments are added up on executors, a block of MOMENTS numbers a key; the driver sees d * d.
    """
    spark = index.sparkSession

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, m = 0, 0.0, 0.0
        for b in it:
            if b.num_rows:
                x = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1).astype(np.float64)
                n, s, m = n + len(x), s + x.sum(axis=0), m + x.T @ x
        if n:
            every = np.concatenate([[n], s, m.ravel()])
            blocks = [every[i : i + MOMENTS].tolist() for i in range(0, len(every), MOMENTS)]
            yield pa.RecordBatch.from_pydict({"block": list(range(len(blocks))), "v": blocks})

    def added(table: pa.Table) -> pa.Table:
        rows = np.array(table.column("v").to_pylist())
        return pa.table({"block": table.column("block")[:1].cast(pa.int64()), "v": [rows.sum(axis=0).tolist()]})

    # two levels: partial sums of a block meet under a salt first, so that no task takes those of all partitions
    parts = index.select("embedding").mapInArrow(moments, "block long, v array<double>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    half = parts.groupBy("block", "salt").applyInArrow(added, "block long, v array<double>")
    sums = half.groupBy("block").applyInArrow(added, "block long, v array<double>").orderBy("block").collect()
    if not sums:
        return spark.createDataFrame([], "row_id long, x double, y double")
    every = np.concatenate([r.v for r in sums])
    n, d = every[0], round((np.sqrt(4 * len(every) - 3) - 1) / 2)  # 1 + d + d * d numbers
    mean = every[1 : d + 1] / n
    cov = every[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2].T
    axes = np.array([a * np.sign(a[np.argmax(np.abs(a))]) for a in axes])
    dot = lambda a: cosine(F.col("embedding"), a.tolist()) - F.lit(float(mean @ a))
    raw = index.select("row_id", dot(axes[0]).alias("x"), dot(axes[1]).alias("y"))
    most = raw.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("most"))
    scaled = lambda c: F.round(F.col(c) / (F.col("most") + 1e-9), 4).alias(c)
    return raw.crossJoin(F.broadcast(most)).select("row_id", scaled("x"), scaled("y"))  # one row


def map_points(corpus: DataFrame, coords: DataFrame) -> DataFrame:
    return corpus.join(coords, "row_id").select("row_id", "url", "title", "category", F.slice("tags", 1, 3).alias("tags"), F.col("file").isNotNull().alias("downloaded"), "x", "y")


# --- language-model hooks ---

REPLY = "semantic_text string, tags array<string>, status string, min_chapters int, year_from int, year_to int"


def parse_reply(reply: str, text: str) -> tuple[str, set[str], Filters]:
    """(text, tags, filters) of the first JSON object in a reply; the input unchanged if there is none."""
    m = re.search(r"\{.*\}", reply or "", re.S)
    try:
        data = json.loads(m[0]) if m else None
    except ValueError:
        data = None
    if not isinstance(data, dict):
        return text, set(), Filters()
    whole = lambda k: data[k] if type(data.get(k)) is int else None
    status = data.get("status") if data.get("status") in (K.DONE, K.SERIAL) else None
    return str(data.get("semantic_text") or text), {str(t) for t in data.get("tags") or [] if t}, Filters(status=status, min_chapters=whole("min_chapters"), year_from=whole("year_from"), year_to=whole("year_to"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """The same for a column `reply`: fields as columns, null without a JSON object."""
    r = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), REPLY)
    return replies.withColumn("r", r).select(*replies.columns, "r.semantic_text", "r.tags", F.when(F.col("r.status").isin(K.DONE, K.SERIAL), F.col("r.status")).alias("status"), "r.min_chapters", "r.year_from", "r.year_to")


def rerank(ranked: DataFrame, order: DataFrame, top_k: int = 20) -> DataFrame:
    """ranked(rank from 0, ...) in the order of order(seq, i, reason): bad and repeated places are ignored, the rest follows."""
    first = order.where((F.col("i") >= 0) & (F.col("i") < top_k)).groupBy("i").agg(F.min_by("reason", "seq").alias("reason"), F.min("seq").alias("seq"))
    return ranked.drop("reason").join(first, F.col("rank") == F.col("i"), "left").drop("i").orderBy(F.coalesce("seq", F.lit(2**31)), "rank")


def explain_column(explain: Callable[[str, str], str], query_text: str, limit: int = 30):
    """A short reason for each row; empty where the function fails."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                return (explain(query_text, t) or "").strip()[:limit]
            except Exception:  # a model's failure must not fail the listing
                return ""

        return text.map(one)

    return run
