"""Operator 1: exact n-gram Jaccard join with signature trees, and the groups its links form.

A document's set is its distinct k-word shingles. Two sets link when den * |a n b| >= num * |a u b|.

How it stays exact and bounded:

* Equal sets collapse to one set first (a set is named by a 64-bit hash of its tokens).
* Two linked sets share a token among the first (1-t)n+1 of any fixed global order, so sets meet in the
  postings of those tokens only. The order puts shingles of rare words first: a shingle's level is the sum of
  the logarithms of its words' counts over all documents. Only the COMMON_MAX most frequent words are told
  apart, all others count as rare; that list changes the cost, not the result.
* In each posting every set is compared with one of its sets, chosen as a likely original: token bitmaps and sizes
  first, what they can't exclude is verified exactly. Verified links are contracted to components, so that a group
  of m near copies costs about m checks and not m * m. STARS such rounds are made.
* Postings that still hold several components go to the signature trees: nodes carry the OR of their members'
  token bitmaps, size ranges and component ranges; a dual traversal drops node pairs whose largest possible
  overlap is too small, and node pairs of a single component. Large postings are cut into blocks; each pair of
  blocks is a task of its own. What survives is verified exactly.

Results: a null or wordless text has an empty set and links with nothing. A null doc_id takes part in no link
and has component_id null. Repeated rows are returned once each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, components, fresh, hash_each, map_arrow, quoted, raw_shingles, save, set_key, shingles, text_bytes

#: Words counted together before their counts are reported, and the least count that is.
CHUNK, LOCAL_MIN = 1_000_000, 4
#: Bound of the list of common words (12 bytes each).
COMMON_MAX = 1 << 17
#: Sets in a block of a large posting.
BLOCK = 1024
LEAF, FANOUT = 8, 8
#: Rounds in which postings are compared with one of their sets before the trees take over.
STARS = 2


def prefix_length(n: int, num: int, den: int) -> int:
    """Of n ordered tokens, so many suffice to meet every set that may link: n - ceil(n*num/den) + 1."""
    return n - (-(-n * num // den)) + 1


def _sets(k: int):
    """doc_id, key, n, bitmap of each row; and, with n = -count, the hashes of words that are common in a chunk."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCAL_MIN
            none = int(often.sum())
            return batch(schema, pa.nulls(none, pa.int64()), words[often].view(np.int64), -counts[often].astype(np.int64), pa.nulls(none, pa.binary()))

        for b in it:
            keys, sizes, maps = [], [], []
            for words in hash_each(b.column(1).to_pylist()):
                tokens = shingles(words, k)
                keys.append(set_key(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
                maps.append(_bitmap(tokens) if len(tokens) else None)
                held.append(words)
                size += len(words)
                if size >= CHUNK:
                    yield report()
                    held, size = [], 0
            yield batch(schema, b.column(0), keys, sizes, maps)
        if size:
            yield report()

    return run


def _prefixes(k: int, num: int, den: int, common):
    """(token, key) for the prefix of each set; common: (sorted word hashes, their levels)."""
    schema = pa.schema([("token", pa.int64()), ("key", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, levels = common.value
        for b in it:
            out_t, out_k = [], []
            for words in hash_each(b.column(0).to_pylist()):
                if not len(words):
                    continue
                raw = raw_shingles(words, k)
                at = np.argsort(raw)
                at = at[np.concatenate([[True], raw[at[1:]] != raw[at[:-1]]])]
                tokens = raw[at]
                p = prefix_length(len(tokens), num, den)
                level = np.zeros(len(tokens), np.int32)
                if len(names):
                    found = np.minimum(np.searchsorted(names, words), len(names) - 1)
                    of_word = np.where(names[found] == words, levels[found], 0).astype(np.int32)
                    for i in range(min(k, len(words))):
                        level += of_word[at + i]
                first = tokens[np.lexsort((tokens, level))[:p]]
                out_t.append(first.view(np.int64))
                out_k.append(np.full(p, set_key(tokens), np.int64))
            if out_t:
                yield batch(schema, np.concatenate(out_t), np.concatenate(out_k))

    return run


def _bitmap_bits(n: int) -> int:
    """Bits of a set's bitmap: the power of two from n to 2n, which its rows in all rounds carry."""
    return 1 << max(6, int(n - 1).bit_length())


def _fold(bits: int, width: int, to: int) -> int:
    """A bitmap of fewer bits: OR of its parts (bits are taken from the low end of the hash)."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def _bitmap(tokens: np.ndarray) -> bytes:
    """The OR bitmap, and behind it a bitmap with the parity of the tokens at each bit: of sets that differ in d tokens it
    differs in d bits at most, and in not many fewer, where the OR of shared tokens would hide some."""
    width = _bitmap_bits(len(tokens))
    flags = np.zeros(width, np.uint8)
    flags[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    odd = np.bincount(((tokens >> np.uint64(32)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(np.concatenate([flags, odd.astype(np.uint8)]), bitorder="little").tobytes()


def _parts(raw: bytes) -> tuple[int, int, int]:
    """(bits, width, parities) of what _bitmap has made."""
    cut = len(raw) // 2
    return int.from_bytes(raw[:cut], "little"), 8 * cut, int.from_bytes(raw[cut:], "little")


def _fold_odd(odd: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        odd = (odd >> width) ^ (odd & ((1 << width) - 1))
    return odd


def differing(x: int, x_width: int, y: int, y_width: int) -> int:
    """The parities that differ, of two sets' bitmaps brought to the smaller width."""
    to = min(x_width, y_width)
    return (_fold_odd(x, x_width, to) ^ _fold_odd(y, y_width, to)).bit_count()


class Node:
    """Members' sizes low to high, OR and AND of bitmaps, most tokens that share a bit (excess), range of components.

    A leaf also has its member's parities; a member is (key, comp, n, bits, (parities, their width)).
    """

    __slots__ = ("all", "bits", "c_high", "c_low", "excess", "high", "kids", "low", "member", "odd")

    def __init__(self, kids: list[Node] | None = None, member=None):
        self.kids, self.member, self.odd = kids, member, None
        if member is not None:
            _, comp, n, bits, self.odd = member
            self.low = self.high = n
            self.bits = self.all = bits
            self.excess, self.c_low, self.c_high = n - bits.bit_count(), comp, comp
            return
        self.low, self.high = min(x.low for x in kids), max(x.high for x in kids)
        self.excess = max(x.excess for x in kids)
        self.c_low, self.c_high = min(x.c_low for x in kids), max(x.c_high for x in kids)
        self.bits, self.all = 0, -1
        for x in kids:
            self.bits |= x.bits
            self.all &= x.all


def build_tree(members: list[tuple]) -> Node | None:
    """members: (key, comp, n, bits, parities) with bitmaps of one width. Neighbours in size and component share nodes."""
    level = [Node(member=m) for m in sorted(members, key=lambda m: (m[1], m[2], m[0]))]
    width = LEAF
    while len(level) > 1:
        level = [Node(level[i : i + width]) for i in range(0, len(level), width)]
        width = FANOUT
    return level[0] if level else None


def may_link(x: Node, y: Node, num: int, den: int) -> bool:
    """Whether some member of x and some member of y could reach the threshold, by the largest possible overlap.

    Shared tokens lie in shared bits, and at most `excess` more of them than bits; a bit that all of x have and none of
    y stands for a token of the difference, and so does, of two leaves, each parity in which they differ.
    """
    if den * x.high < num * y.low or den * y.high < num * x.low:
        return False
    apart = (x.all & ~y.bits).bit_count() + (y.all & ~x.bits).bit_count()
    if x.odd is not None and y.odd is not None:
        apart = max(apart, differing(*x.odd, *y.odd))
    most = min((x.high + y.high - apart) // 2, (x.bits & y.bits).bit_count() + min(x.excess, y.excess), x.high, y.high)
    return most * (num + den) >= num * (x.low + y.low)


def dual(x: Node, y: Node, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of keys of different components below x and y that the bounds can't exclude."""
    stack = [(x, y)]
    while stack:
        x, y = stack.pop()
        if x.c_low == x.c_high == y.c_low == y.c_high:
            continue
        if x is y:
            if x.kids:
                for i, a in enumerate(x.kids):
                    stack.extend((a, b) for b in x.kids[i:])
            continue
        if not may_link(x, y, num, den):
            continue
        if x.kids and (not y.kids or x.high - x.low >= y.high - y.low):
            stack.extend((a, y) for a in x.kids)
        elif y.kids:
            stack.extend((x, b) for b in y.kids)
        elif x.member[0] != y.member[0]:
            yield x.member[0], y.member[0]


def _tree_pairs(num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("part", "key", "comp", "n", "bitmap")), strict=True))
        width = min((_parts(r[4])[1] for r in rows), default=64)
        sides: dict[int, list] = {0: [], 1: []}
        for part, key, comp, n, raw in rows:
            bits, own, odd = _parts(raw)
            sides[part].append((key, comp, n, _fold(bits, own, width), (odd, own)))
        left, right = build_tree(sides[0]), build_tree(sides[1])
        found = {(min(p), max(p)) for p in dual(left, right or left, num, den)} if left else set()
        return pa.table([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], schema=schema)

    return run


def _possible(num: int, den: int):
    """The pairs whose sizes and bitmaps allow the threshold: the bound of two leaves."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b_in in it:
            out = []
            for a, b, na, nb, ma, mb in zip(*(b_in.column(i).to_pylist() for i in range(6)), strict=True):
                (xb, xw, xo), (yb, yw, yo) = _parts(ma), _parts(mb)
                w, apart = min(xw, yw), differing(xo, xw, yo, yw)
                if (na + nb - apart) // 2 * (num + den) < num * (na + nb):
                    continue
                if may_link(Node(member=(a, 0, na, _fold(xb, xw, w), None)), Node(member=(b, 0, nb, _fold(yb, yw, w), None)), num, den):
                    out.append((a, b))
            yield batch(schema, [p[0] for p in out], [p[1] for p in out])

    return run


def _verify(k: int, num: int, den: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for b_in in it:
            a_out, b_out = [], []
            ids, left = (b_in.column(i).to_pylist() for i in (0, 2))
            for a, b, ta, wb in zip(ids, b_in.column(1).to_pylist(), left, hash_each(b_in.column(3).to_pylist()), strict=True):
                if a != last:  # rows mostly come sorted by a
                    last, x = a, shingles(hash_each([ta])[0], k)
                y = shingles(wb, k)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (len(x) + len(y) - both):
                    a_out.append(a)
                    b_out.append(b)
            yield batch(schema, a_out, b_out)

    return run


def ngram_jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_id (name of the set), n_links.

    n_links counts verified links of the document's class that were needed to form its group.
    """
    sc = docs.sparkSession.sparkContext
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    found = save(map_arrow(narrow, _sets(k), "doc_id long, key long, n long, bitmap binary"), "sets")
    sets = found.where("n >= 0").select("doc_id", "key", "n")
    counted = found.where("n < 0").groupBy("key").agg(F.sum(-F.col("n")).alias("c")).orderBy(F.desc("c"), "key").limit(COMMON_MAX).orderBy("key").toArrow()
    names, counts = (counted.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(names.view(np.uint64))
    common = sc.broadcast((names.view(np.uint64)[order], np.round(4 * np.log2(np.maximum(counts[order], 1))).astype(np.uint8)))
    classes = sets.where("key is not null and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))

    # postings that hold two different sets, and the smallest set of each
    posting = save(map_arrow(narrow.where("doc_id is not null").select("text"), _prefixes(k, num, den, common), "token long, key long"), "prefixes")
    shared = posting.groupBy("token").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("token")
    met = posting.join(shared, "token").distinct()
    # a set that shares many of its rare tokens is likely what its neighbours are copies of
    met = save(met.join(met.groupBy("key").agg(F.count("*").alias("weight")), "key"), "postings")
    bitmaps = save(found.where("n > 0").join(met.select("key").distinct(), "key", "left_semi").select("key", "n", "bitmap").dropDuplicates(["key"]), "bitmaps")

    links = comp = None
    placed = met.withColumn("comp", F.col("key"))
    for step in range(STARS):
        pivot = placed.groupBy("token").agg(F.max(F.struct("weight", "key", "comp")).alias("p"))
        if step:  # from the second star on: the likeliest hub outside the component of the first
            pivot = placed.join(pivot.select("token", F.col("p.comp").alias("c")), "token").where("comp <> c").groupBy("token").agg(F.max(F.struct("weight", "key", "comp")).alias("p"))
        pairs = placed.join(pivot, "token").where("comp <> p.comp").select(F.col("p.key").alias("a"), F.col("key").alias("b")).distinct()
        new = save(_verified(save(_allowed(pairs, bitmaps, num, den), f"pairs-{step}"), classes, narrow, k, num, den), f"links-{step}")
        links = new if links is None else links.union(new)
        comp = components(links, name=f"groups-{step}").withColumnRenamed("node", "key")
        placed = met.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))

    # postings that still hold several components; of up to STARS + 1 sets each pair has been compared by now
    several = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where(f"lo < hi and size > {STARS + 1}").select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    left = placed.join(several, "token")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # the row of block i takes part in the tasks (i, j) for all j: (lower, higher) and on which side it stands
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(block, j).alias("i"), F.greatest(block, j).alias("j"), (block > j).cast("int").alias("part")))
    members = left.join(bitmaps, "key").withColumn("task", F.explode(tasks)).select("token", "task.i", "task.j", "task.part", "key", "comp", "n", "bitmap")
    more = save(members.groupBy("token", "i", "j").applyInArrow(_tree_pairs(num, den), "a long, b long").distinct(), "pairs-tree")
    if not more.isEmpty():
        links = links.union(save(_verified(more, classes, narrow, k, num, den), "links-tree"))
        comp = components(links, name="groups-tree").withColumnRenamed("node", "key")

    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    named = classes.join(comp, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_key = named.join(smallest, "comp").join(degree, "key", "left").select("key", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = sets.join(by_key, "key", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.col("key").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def without_sets(docs: DataFrame, gone: DataFrame, k: int) -> DataFrame:
    """docs without the rows whose set is listed for their doc_id in gone(doc_id, sets: array<long> of class_id)."""
    doc, listed = (fresh(c, docs.columns) for c in ("_doc", "_sets"))
    of = gone.select(F.col("doc_id").alias(doc), F.col("sets").alias(listed))
    rows = docs.join(of, F.col("doc_id") == F.col(doc)).select(F.struct(*quoted(docs.columns)).alias("row"), text_bytes("text").alias("bytes"), F.col(listed).alias("sets"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            stay = []
            for words, sets in zip(hash_each(b.column(1).to_pylist()), b.column(2).to_pylist(), strict=True):
                stay.append(not len(words) or set_key(shingles(words, k)) not in sets)
            yield b.select(["row"]).filter(pa.array(stay, pa.bool_()))

    rest = map_arrow(rows, run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
    return docs.join(of, F.col("doc_id") == F.col(doc), "left_anti").unionByName(rest)


def _allowed(pairs: DataFrame, bitmaps: DataFrame, num: int, den: int) -> DataFrame:
    side = lambda x: bitmaps.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}"))
    fits = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(fits).select("a", "b", "na", "nb", "ma", "mb")
    return map_arrow(both, _possible(num, den), "a long, b long")


def _texts_of(keys: DataFrame, classes: DataFrame, narrow: DataFrame, k: int) -> DataFrame:
    """(key, text) of one document of each set."""
    wanted = keys.join(classes, "key").select(F.col("rep").alias("doc_id"), F.col("key").alias("want"))
    schema = pa.schema([("key", pa.int64()), ("text", pa.binary())])

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in it:
            keys, texts = [], []
            all_texts = b.column(1).to_pylist()
            for want, text, words in zip(b.column(0).to_pylist(), all_texts, hash_each(all_texts), strict=True):
                # a doc_id may repeat with other texts, and with the same one
                if want != last and set_key(shingles(words, k)) == want:
                    keys.append(want)
                    texts.append(text)
                    last = want
            yield batch(schema, keys, texts)

    return map_arrow(narrow.join(wanted, "doc_id").select("want", "text"), keep, "key long, text binary").dropDuplicates(["key"])


def _verified(pairs: DataFrame, classes: DataFrame, narrow: DataFrame, k: int, num: int, den: int) -> DataFrame:
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = save(_texts_of(keys, classes, narrow, k), "texts")
    ta = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    tb = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")
    return map_arrow(both, _verify(k, num, den), "a long, b long")


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS grams FROM w
), classes AS (
  SELECT md5(array_to_string(list_sort(grams), chr(10))) AS key, min(doc_id) AS rep, any_value(grams) AS grams FROM s WHERE len(grams) > 0 GROUP BY 1
), tok AS (SELECT rep, unnest(grams) AS g, len(grams) AS n FROM classes),
pairs AS (
  SELECT a.rep AS x, b.rep AS y FROM tok a JOIN tok b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT rep AS node, rep AS root FROM classes UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.node),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN classes k ON k.key = md5(array_to_string(list_sort(s.grams), chr(10))) AND len(s.grams) > 0
LEFT JOIN comp c ON c.node = k.rep
"""


def query(spark, sf_dir: str) -> DataFrame:
    """3-word shingles at Jaccard 0.9 over all of documents."""
    return ngram_jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")
