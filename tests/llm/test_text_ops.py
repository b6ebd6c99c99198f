"""Operators 7 and 11 to 13, and odd tables for the others, against brute force on small fixtures, with nulls, empties, ties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorebase.llm import decontaminate, fill_in_middle, langid, ngram_join, quality, sentencepiece_codec, sharding, spelling, substring_dedup, warc
from lorebase.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(parts)


def words_of(text):
    return [w for w in SPACES.split(text or "") if w]


# --- op11 ---


def brute_repeats(rows, width):
    """(n_words, spans of removed words, kept) of each row; windows of other rows with the same doc_id don't count."""
    first_doc, out = {}, []
    for doc, text in rows:
        w = words_of(text)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            if doc is not None:
                first_doc[key] = min(first_doc.get(key, doc), doc)
    for doc, text in rows:
        w, seen, gone = words_of(text), set(), set()
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            if doc is not None and (first_doc[key] < doc or key in seen):
                gone.update(range(p, p + width))
            seen.add(key)
        spans = [(i, next(j for j in range(i, len(w) + 1) if j not in gone)) for i in sorted(gone) if i - 1 not in gone]
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone), spans))
    return out


def passages(seed, n=40, vocabulary=30):
    rng = random.Random(seed)
    shared = [[rng.choice("abcdefgh") + str(rng.randrange(vocabulary)) for _ in range(rng.randrange(3, 40))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(shared) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(9))]
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(words)))
    return rows


def found_repeats(spark, rows, width):
    got = substring_dedup.remove_repeats(frame(spark, rows), width).collect()
    return [(r.doc_id, r.n_words, r.n_removed, r.kept, [tuple(s) for s in r.spans]) for r in got]


@pytest.mark.parametrize(("seed", "width", "limit"), [(1, 20, 1 << 14), (2, 4, 1 << 14), (3, 5, 2), (4, 2, 1), (5, 7, 0)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, width, limit):
    # a limit of few suffixes splits the frequent prefixes; 0 splits all
    monkeypatch.setattr(substring_dedup, "LIMIT", limit)
    rows = passages(seed)
    assert sorted(found_repeats(spark, rows, width)) == sorted(brute_repeats(rows, width))


def test_repeats_in_many_small_sends_and_groups(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEND", 16)
    monkeypatch.setattr(substring_dedup, "SEND_BYTES", 2000)
    monkeypatch.setattr(substring_dedup, "STEP", 32)
    monkeypatch.setattr(substring_dedup, "LIMIT", 8)
    rows = [*passages(6), *((100 + i, "lorem " * 12 + "x" * (i % 3) + " ipsum" * 9) for i in range(30)), (200, "same " * 500)]
    assert sorted(found_repeats(spark, rows, 6)) == sorted(brute_repeats(rows, 6))


def test_repeats_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    text = " ".join(f"t{i}" for i in range(25))
    rows = [(None, text), (None, text), (1, None), (2, ""), (3, " \n\t "), (4, text), (4, text), (5, text + " more"), (5, "other " + text), (6, text.upper()), (7, long), (8, "a b c"), (9, "a b c"), (-1, "x " + text)]
    assert sorted(found_repeats(spark, rows, 20), key=str) == sorted(brute_repeats(rows, 20), key=str)
    empty = substring_dedup.remove_repeats(frame(spark, rows).limit(0))
    assert empty.collect() == [] and empty.columns == [*frame(spark, rows).columns, "n_words", "n_removed", "kept", "spans"]


def test_repeats_keep_extra_columns(spark):
    text = " ".join(f"t{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text, [1], "a"), (2, text, None, "b")], "doc_id int, text string, `odd.name` array<int>, KEPT string").withColumn("_doc", F.lit(5)).withColumn("tag", F.lit("t")).withColumn("wanted", F.lit("w"))
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "odd.name", "_doc", "tag", "wanted", "n_words", "n_removed", "kept", "spans"]
    assert {(r.doc_id, tuple(r["odd.name"] or ()), r._doc, r.tag, r.wanted, r.n_removed, r.kept) for r in got.collect()} == {(1, (1,), 5, "t", "w", 0, text), (2, (), 5, "t", "w", 25, "")}


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 6, 4000).astype(np.uint64)
    owner = np.sort(rng.integers(0, 20, 4000))
    place, key, low, high = substring_dedup.anchors_of(h, owner, 8)
    by_start = {p - d: (p, d, k) for p, k, lo, hi in zip(place.tolist(), key.tolist(), low.tolist(), high.tolist(), strict=True) for d in range(lo, hi + 1)}
    windows = {}
    for p in range(len(h) - 7):
        assert (p in by_start) == (owner[p] == owner[p + 7])
        if p in by_start:
            windows.setdefault(tuple(h[p : p + 8]), set()).add(by_start[p][1:])
    assert all(len(v) == 1 for v in windows.values()) and len(windows) < len(by_start)


def test_subtrees_compare_words_not_hashes():
    words = pa.array([b"a b c d", b"a b c e", b"a b c d", b"b c d e"], pa.large_binary())
    n = np.zeros(4, np.int64)
    marks = substring_dedup.subtree_marks(np.array([3, 2, 9, 1]), n, n, np.array([0, 0, 0, 1]), np.array([0, 0, 0, 1]), words, 4)
    assert marks.tolist() == [0, 0, 1, 0]


# --- empty tables and clashing names, for the operators of earlier rounds ---


def clashing(spark, rows):
    names = ["n_words", "KEPT", "key", "sets", "n", "host", "row", "bytes", "item_ids", "Distances", "comp", "class_id", "u", "v", "block", "draw", "shard"]
    return frame(spark, rows).select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in names])


def test_quality_of_empty_and_clashing_tables(spark):
    text = " ".join(f"w{i}" for i in range(70))
    docs = clashing(spark, [*((i, f"{text} {i}") for i in range(10, 30)), (2, "few words"), (3, None), (3, None)])
    got = [(r.doc_id, r.base_failed, r.kept) for r in quality.quality(docs).select("doc_id", "base_failed", "kept").collect()]
    assert sorted(got) == [(2, True, False), (3, True, False), (3, True, False), *((i, False, True) for i in range(10, 30))]
    assert quality.quality(docs.limit(0)).collect() == []


def test_decontamination_of_empty_and_clashing_tables(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away into the woods"
    docs = clashing(spark, [(1, f"before {passage} behind"), (2, "clean"), (3, None)])
    bench = spark.createDataFrame([(7, passage), (8, None), (None, passage), (9, "")], "item_id long, text string")
    got = {(r.doc_id, tuple(r.item_ids), r.host) for r in decontaminate.find_items(docs, bench).select("doc_id", "item_ids", "host").collect()}
    assert got == {(1, (7,), "host1"), (2, (), "host2"), (3, (), "host3")}
    assert {tuple(r.item_ids) for r in decontaminate.find_items(docs, bench.limit(0)).select("item_ids").collect()} == {()}
    assert decontaminate.find_items(docs.limit(0), bench).collect() == []


def test_joins_and_shards_of_clashing_tables(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = clashing(spark, [(1, text), (2, text + " more"), (3, "other"), (4, None)])
    assert {(r.doc_id, r.component_id) for r in ngram_join.ngram_jaccard_groups(docs, 3, 90, 100).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert sorted((r.doc_id, r.size) for r in sharding.shard_rows(docs).collect()) == [(1, len(text) + 16), (2, len(text) + 21), (3, 21), (4, 16)]
    assert sharding.shard_rows(docs.limit(0)).collect() == []


def test_archives_ignore_extra_columns(spark):
    pages = spark.createDataFrame([(1, "http://a/1", "same", "x"), (2, "http://a/2", "same", "y")], "page_id int, url string, html string, payload string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2)).withColumn("PAGE_id2", F.lit(3))
    path = new_path(spark, "warc")
    warc.write_warc(pages, path)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.page_records(warc.read_warc(spark, path)).collect()) == [(1, "response", None), (2, "revisit", 1)]


def test_one_word_of_many_characters(spark):
    word = "abcdefghij" * 30_000
    got = sentencepiece_codec.encode(frame(spark, [(1, word)])).first()
    assert got.round_trip and len(got.ids) > 1000


# --- op7, rebuilt ---


def slots_of(text):
    """Counts of hashed n-grams, one n-gram at a time."""
    folded = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in text.encode())
    folded = b" " + b" ".join(folded.split()) + b" "
    out = Counter()
    for n in (2, 3, 4):
        for i in range(len(folded) - n + 1):
            h = folded[i]
            for b in folded[i + 1 : i + n]:
                h = h * 0x01000193 % 2**32 ^ b
            out[(h + n) * 0x9E3779B1 % 2**32 >> 17] += 1
    return out, len(folded.replace(b" ", b""))


def unit(v):
    return v / max(np.linalg.norm(v), 1e-12)


def brute_language_model(rows):
    """idf, {lang: its centroids}, limits of rows (text, lang), by the definitions."""
    counts = [slots_of(t) for t, _ in rows]
    idf = np.log((1 + len(rows)) / (1 + np.bincount([s for c, _ in counts for s in c], minlength=1 << 15))) + 1

    def vec(c):
        v = np.zeros(1 << 15)
        for s, k in c.items():
            v[s] = (1 + np.log(k)) * idf[s]
        return unit(v)

    vectors, centres = [vec(c) for c, _ in counts], {}
    for lang in sorted({lang for _, lang in rows}):
        own = [v for v, (_, x) in zip(vectors, rows, strict=True) if x == lang]
        mean = sum(own) / len(own)
        at = [max(range(len(own)), key=lambda i: own[i] @ mean)]
        while len(at) < min(langid.CENTROIDS, len(own)):
            at.append(min(range(len(own)), key=lambda i: max(own[i] @ own[j] for j in at)))
        c = [own[i] for i in at]
        for _ in range(12):
            of = [max(range(len(c)), key=lambda k, v=v: v @ c[k]) for v in own]
            c = [unit(sum(v for v, o in zip(own, of, strict=True) if o == k)) if k in of else c[k] for k in range(len(c))]
        centres[lang] = c
    best = [max(v @ c for own in centres.values() for c in own) for v in vectors]
    limits = []
    for i, low in enumerate(langid.EDGES):
        high = langid.EDGES[i + 1] if i + 1 < len(langid.EDGES) else 10**9
        some = [b for b, (_, n) in zip(best, counts, strict=True) if low <= n < high]
        limits.append(langid.LIMIT_SHARE * np.quantile(some, langid.LIMIT_QUANTILE) if len(some) >= langid.MIN_SAMPLES else 0.0)
    return vec, centres, limits


def test_language_model_equals_its_definition(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if r.text and len(r.text) < 3000]
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang, "s", 0) for r in rows] + [(10**6, "1234 ... 99", "en", "s", 0), (10**6 + 1, None, "en", "s", 0), (10**6 + 2, "zqx vjk wqz xkv " * 40, None, "s", 0)], SCHEMA)
    learnt = [(r.text, r.lang) for r in rows if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and re.search(r"[^\W\d_]", r.text)]
    vec, centres, limits = brute_language_model(learnt)
    model = langid.learn(docs)
    assert model.langs == tuple(centres) and np.allclose(model.limits, limits, atol=1e-4) and any(limits)
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows) + 3
    for r in got:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        counts, size = slots_of(r.text)
        score, lang = max((max(vec(counts) @ c for c in own), lang) for lang, own in centres.items())
        at = int(np.searchsorted(langid.EDGES, size, side="right")) - 1
        assert r.lang_pred == lang and abs(r.score - score) < 1e-4
        assert at < 0 and not r.rejected or at >= 0 and (r.rejected == (score < limits[at]) or abs(score - limits[at]) < 1e-4)
    assert next(r for r in got if r.doc_id == 10**6 + 2).rejected


# --- op12 ---


def brute_middle(doc, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    hex_ = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(hex_[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_middles_equal_brute_force(spark):
    rng = random.Random(2)
    alphabet = ["a", "Bc", " ", "\n", "\r", "\0", "ä", "ß", "語", "😀", "́", "<", "P>", "<S", ">", "M", " ", "0"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [(401, "x<P>y"), (402, "<M>"), (403, "a" * 200_000), (404, "é" * 70_000 + "b" * 70_000 + "!"), (None, "no id here"), (405, None), (406, ""), (407, "twice the same"), (407, "twice the same")]
    got = fill_in_middle.transform(frame(spark, rows)).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter(brute_middle(*r) for r in rows)
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_middles_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, bytearray(b"a\xffb c"), 7, "x")], "doc_id int, raw binary, N int, _text string").withColumn("text", F.col("raw").cast("string")).drop("raw")
    got = fill_in_middle.transform(docs)
    assert got.columns == ["doc_id", "_text", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    row = got.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).first()
    assert (row.n, row["_text"], row.back) == (5, "x", "a�b c")
    assert fill_in_middle.transform(docs.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40), st.integers(1, 9))
def test_split_tokens_equal_the_pattern(text, size):
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(fill_in_middle.PATTERN), behavior="isolated")
    text = text.encode("utf-8", "replace").decode()
    want = [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
    assert fill_in_middle.token_ends(split, text, size).tolist() == fill_in_middle.token_ends(split, text).tolist() == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.é語", max_size=30), max_size=5), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_stand_at_ranked_tokens(texts, first, second):
    splitter = fill_in_middle.Splitter()
    for text in texts:
        ends = [0, *(m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text))]
        a, b = sorted((first % len(ends), second % len(ends)))
        assert splitter.cuts(text, first, second) == (len(ends) - 1, ends[a], ends[b])


# --- op13 ---


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [o for o in words if one_apart(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def misspelt(seed, n=60):
    rng = random.Random(seed)
    base = ["catalogue", "Überraschung", "aaaaaaaa", "spelling", "variants", "ÀÉÎõüþÿ", "naïvetés", "grouping"]

    def typo(w):
        i, c = rng.randrange(len(w)), rng.choice("aeàÿz")
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :] + w[i]])

    rows = []
    for d in range(n):
        words = [rng.choice(base) for _ in range(40)]
        words = [typo(w) if rng.random() < 0.08 else typo(typo(w)) if rng.random() < 0.05 else w for w in words]
        rows.append((d, rng.choice([" ", "7", "-", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rows = [*misspelt(seed), (None, "catalogue Catalogue"), (7, None), (8, ""), (9, "short"), (10, "spelling " * 300)]
    runs = spelling.runs_of(frame(spark, rows))
    words = spelling.counted(runs.select(spelling.misspelled(runs).alias("word")))
    assert {r.word: r.n for r in words.collect()} == brute_words(rows)
    got = spelling.variants(words).collect()
    want = brute_variants(brute_words(rows))
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want and len(got) == len(want)
    assert any(r.form for r in got) and any(r.n_near and not r.form for r in got)  # chains have a test of their own


def test_chains_of_forms_ties_and_long_words(spark):
    long = "q" * 3000 + "r" * 3000
    n = {"abcdefg": 100_000, "abcdefgh": 9_000, "abcdefghi": 800, "abcdefghij": 70, "abcdefghijk": 6, "zzzzzzz": 2, "zzzzzza": 20, "zzzzzzb": 20, "alonely": 3, long: 50, long[1:]: 5, long[:-1] + "s": 4}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"))
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == brute_variants(n)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    # all keys are one of 16: every pair becomes a candidate, and verification settles it
    real = spelling.deletion_keys

    def few(words):
        key, id_, from_, to = real(words)
        return key & 15, id_ & 15, from_ * 0 - (from_ < 0), np.where(from_ < 0, -1, 10**6).astype(np.int32)

    monkeypatch.setattr(spelling, "deletion_keys", few)
    words = {w: c for w, c in brute_words(misspelt(3, 12)).items()}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == brute_variants(words)
