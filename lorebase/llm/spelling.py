"""Operator 13: spelling variants, by a symmetric-delete join of all words.

Words come from runs of letters (A-Z, a-z and U+00C0-U+00FF) of MIN_LENGTH or more code points, A-Z lower-cased. A word
emits itself and its distinct single deletions, as 64-bit hashes, with the range of places whose deletion gives the same.
Of two words that share a hash, one is a deletion of the other, or both lose a letter at the same place: there their
ranges meet. Such pairs come from one equi-join on the hash, whose condition holds kinds and ranges, so that two
words that lose letters at different places, most of what a key holds, make no pair. A key of length L has 90 letters at
L + 1 places as partners at most. Pairs meet their words again, by hash, and are verified to be at distance exactly one, so
words that share a hash cost a comparison and change nothing.

A word's form is its near word of largest n, if that is FACTOR times its own or more; ties go to the smallest in
code-point order. n grows by FACTOR with each form, so the forms of all words are chains of a few links, which joins of
roots with roots follow twice as far each time.

Null and empty texts have no words, nor has an empty table. Runs in rows of a null doc_id count like any others. Very
long words emit their deletions by prefix sums, in time and space linear in their length. Counts are summed where the
texts are before they are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, map_arrow, mix, save

LETTERS = "[A-Za-zÀ-ÿ]"
#: Least code points and occurrences of a word; what a form's n is at least, times its variant's.
MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15
#: Code points of words whose keys are made in one step.
STEP = 1 << 16
#: Rounds of following forms; each doubles the way, and n grows by FACTOR a link.
ROUNDS = 8


def lowered(run: Column) -> Column:
    """A-Z in lower case, and nothing else."""
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, _UPPER, _LOWER))


def runs_of(docs: DataFrame) -> DataFrame:
    """(doc_id, run): all runs of letters of at least MIN_LENGTH code points, lower-cased."""
    rows = docs.where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{MIN_LENGTH},}}"), F.lit(0))).alias("run"))
    return rows.select("doc_id", lowered(F.col("run")).alias("run"))


def misspelled(runs: DataFrame, every: int = 31) -> Column:
    """run, without one letter if `every` divides its hash with the doc_id: planted typing errors."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    k = (h % F.length("run")).cast("int")
    return F.when(h % every == 0, F.concat(F.substr("run", F.lit(1), k), F.substr("run", k + 2))).otherwise(F.col("run"))


def counted(words: DataFrame) -> DataFrame:
    """(word, n): words of at least MIN_LENGTH code points that occur at least MIN_COUNT times in the column `word`."""
    return words.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


KEY = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("from_", pa.int32()), ("to", pa.int32())])


def deletion_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """(key, id, from, to) of words and their distinct deletions; a word's own key is its id and has from = to = -1.

    The hash is a polynomial in the letters, so a deletion's comes from the sums before and behind it.
    """
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) for w in words], np.int64)
    end = np.cumsum(size)
    begin = end - size
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - begin[of]
    longest = int(size.max(initial=0))
    up = np.full(longest + 1, _BASE, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    term = points * up[place]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(term)])
    total = sums[end] - sums[begin]
    own = mix(total + size.astype(np.uint64))
    # of equal letters in a row the first deletion stands for all
    new = np.ones(len(points), bool)
    new[1:] = (points[1:] != points[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(points)) - 1
    w = of[first]
    before, behind = sums[first] - sums[begin[w]], sums[end[w]] - sums[first + 1]
    key = mix(before + behind * np.uint64(pow(_BASE, -1, 1 << 64)) + (size[w] - 1).astype(np.uint64))
    none = np.full(len(words), -1, np.int32)
    return np.concatenate([own, key]).view(np.int64), np.concatenate([own, own[w]]).view(np.int64), np.concatenate([none, place[first].astype(np.int32)]), np.concatenate([none, place[last].astype(np.int32)])


def _portions(words: list[str]) -> Iterator[list[str]]:
    """The words in order, about STEP code points at a time."""
    held, size = [], 0
    for word in words:
        if held and size + len(word) > STEP:
            yield held
            held, size = [], 0
        held.append(word)
        size += len(word)
    if held:
        yield held


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for words in _portions(b.column(0).to_pylist()):
            columns = deletion_keys(words)
            for at in range(0, len(columns[0]), STEP):
                yield batch(KEY, *(c[at : at + STEP] for c in columns))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all words(word, n) at distance one, both ways round."""
    keys = save(map_arrow(words.select("word"), _keys, "key long, id long, from_ int, to int"), "keys")
    own = keys.where("from_ < 0").select("key", "id")
    cut = keys.where("from_ >= 0")
    # a word that is another's deletion; two words that differ in one letter
    shorter = cut.join(own.withColumnRenamed("id", "other"), "key").select("id", "other")
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.from_") <= F.col("b.to")) & (F.col("b.from_") <= F.col("a.to"))
    changed = cut.alias("a").join(cut.alias("b"), met).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))
    pairs = shorter.union(changed).distinct()
    named = map_arrow(words.select("word", "n"), _named, "id long, word string, n long")
    left, right = named.select("id", "word", "n"), named.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    both = pairs.join(left, "id").join(right, "other").where(F.levenshtein("word", "other_word", 1) == 1)
    # words that share an id meet more than once
    both = save(both.select("word", "n", "other_word", "other_n").distinct(), "near")
    back = both.select(F.col("other_word").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return both.withColumnRenamed("other_word", "other").unionByName(back).distinct()


def _named(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their ids."""
    schema = pa.schema([("id", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
    for b in it:
        ids = [deletion_keys(words)[0][: len(words)] for words in _portions(b.column(0).to_pylist())]
        yield batch(schema, np.concatenate([np.zeros(0, np.int64), *ids]), b.column(0).cast(pa.string()), b.column(1))


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of forms(word, form): the end of each chain of forms."""
    way = forms.select("word", F.col("form").alias("root"))
    for step in range(ROUNDS):
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        # a word that stands for none of its own has no row
        way = save(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{step}")
        if way.where("moved").isEmpty():
            return way.select("word", "root")
        way = way.select("word", "root")
    raise RuntimeError(f"roots_of: forms still lead on after {ROUNDS} rounds")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words(word, n)."""
    words = save(words, "words")
    near = near_pairs(words)
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w")))
    found = near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    all_ = words.join(found, "word", "left")
    large = -F.col("best.m") >= FACTOR * F.col("n")
    all_ = save(all_.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.w")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n")), "forms")
    roots = roots_of(all_.where("form is not null").select("word", "form"))
    return all_.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), F.col("n").cast("long").alias("n"), "n_near", F.col("form_n").cast("long").alias("form_n"))


# The checksum is linear in the bytes but for the register's start: the SQL sums what each byte adds, by its distance from the end.
ORACLE = """
WITH RECURSIVE r AS (SELECT DISTINCT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
m AS (SELECT doc_id, run, sum(c) AS c, encode(doc_id || ':' || run) AS b FROM r GROUP BY ALL),
bits AS (SELECT range AS b, range AS v, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT b, v FROM bits WHERE k = 8),
far AS (SELECT b, v, 0 AS k FROM crc UNION ALL SELECT far.b, xor(far.v >> 8, crc.v), k + 1 FROM far JOIN crc ON crc.b = far.v & 255 WHERE k < (SELECT max(octet_length(b)) FROM m)),
start AS (SELECT 4294967295 AS v, 0 AS k UNION ALL SELECT xor(start.v >> 8, crc.v), k + 1 FROM start JOIN crc ON crc.b = start.v & 255 WHERE k < (SELECT max(octet_length(b)) FROM m)),
bytes AS (SELECT doc_id, run, octet_length(b) AS len, unnest(list_transform(range(0, octet_length(b)), lambda i: CAST('0x' || substr(hex(b), 2 * i + 1, 2) AS BIGINT))) AS b, unnest(range(0, octet_length(b))) AS i FROM m),
sums AS (SELECT doc_id, run, any_value(len) AS len, bit_xor(far.v) AS v FROM bytes JOIN far ON far.b = bytes.b AND far.k = len - 1 - i GROUP BY ALL),
h AS (SELECT doc_id, run, xor(xor(sums.v, start.v), 4294967295) AS h FROM sums JOIN start ON start.k = sums.len),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM h JOIN m USING (doc_id, run)),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
g AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM p),
e AS (SELECT x.word, y.word AS other FROM g x JOIN g y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT g.word, w.word FROM g JOIN w ON w.word = g.a || g.z UNION SELECT w.word, g.word FROM g JOIN w ON w.word = g.a || g.z),
f AS (SELECT e.word, e.other, o.n AS other_n, count(*) OVER (PARTITION BY e.word) AS n_near, row_number() OVER (PARTITION BY e.word ORDER BY o.n DESC, e.other) AS k FROM e JOIN w o ON o.word = e.other),
v AS (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM w LEFT JOIN f ON f.word = w.word AND f.k = 1),
q AS (SELECT word, word AS root FROM v UNION ALL SELECT q.word, v.form FROM q JOIN v ON v.word = q.root WHERE v.form IS NOT NULL)
SELECT v.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM v JOIN (SELECT q.word, q.root FROM q JOIN v ON v.word = q.root WHERE v.form IS NULL) USING (word)
"""


def query(spark, sf_dir: str) -> DataFrame:
    """The words of all whole documents, with planted errors, and what they are variants of."""
    runs = runs_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return variants(counted(runs.select(misspelled(runs).alias("word"))))
