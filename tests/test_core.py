"""The catalogue engine on small fixtures: semantics that whole-table queries don't pin."""

import gzip
import hashlib
import io
import json
import random
import re
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.functions import constants as K
from lorebase.functions import html, scalars, tags, text, urls
from lorebase.operators import graph, rank, reports, resolve, store, user, words
from lorebase.operators.filters import Filters, parse_categories, parse_year_range
from lorebase.plans import queries
from lorebase.plans.session import Session
from lorebase.sources import readers, writers
from lorebase.sources.schemas import CATALOG, RECORD, with_record_defaults
from lorebase.streaming import maintain, streams

SITE, CATS = "books.example", ["gl", "yanqing"]


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, float, type(None))) else F.lit(v))
    return df.select(column.alias("v")).first().v


def record(**kw):
    base = dict.fromkeys(RECORD.names)
    return tuple((base | {"tags": []} | kw).values())


def records(spark, rows):
    return with_record_defaults(spark.createDataFrame([record(**r) for r in rows], RECORD))


def corpus(spark):
    vec = lambda *v: [float(x) for x in np.array(v) / np.linalg.norm(v)]
    rows = [(0, "u0", "gl", "Moon One", "a", "完结", 10, None, "2020-01", ["x", "y"], vec(1, 0)), (1, "u1", "gl", "Moon Two", "b", "连载", None, 7, "2021-05", ["x"], vec(1, 1)), (2, "u2", "bl", "Sun", "a", "完结", None, None, "", [], vec(1, 1)), (3, "u3", "gl", "Moonlight", "c", "完结", 99, None, "2022-02", ["y", "x"], vec(0, 1)), (4, "u4", "gl", "Star", "c", "完结", 5, None, "2019-02", ["z"], vec(1, 1))]
    df = spark.createDataFrame(rows, "row_id long, url string, category string, title string, author string, status string, chapter_count int, page_count int, year_month string, tags array<string>, embedding array<float>")
    return df.withColumn("synopsis", F.lit("s\nt")).withColumn("file", F.when(F.col("row_id") != 1, "f")).withColumn("upload_date", F.col("year_month"))


# --- ranking and filters ---


def test_hybrid_score_ties_and_null_rejection(spark):
    c = corpus(spark)
    top = rank.search(c, [1.0, 0.0], 5).collect()
    assert [r.row_id for r in top] == [0, 1, 2, 4, 3]  # equal cosines keep index order
    boosted = {r.row_id: r for r in rank.search(c, [1.0, 0.0], 5, ref_tags=["x"]).collect()}
    assert boosted[0].score == pytest.approx(1 + 0.15 / 2) and boosted[1].score == pytest.approx(boosted[1].cosine + 0.15) and boosted[2].score == boosted[2].cosine
    ids = lambda f: sorted(r.row_id for r in c.where(f.predicate()).collect())
    assert ids(Filters(min_chapters=0)) == [0, 1, 3, 4] and ids(Filters(max_chapters=7)) == [1, 4]
    assert ids(Filters(year_from=2020)) == [0, 1, 3] and ids(Filters(year_from=2020, year_to=2021)) == [0, 1]
    assert ids(Filters(status="完结", categories=frozenset({"gl"}), exclude_authors=frozenset({"c"}))) == [0]
    assert ids(Filters(require_tags=frozenset({"x", "y"}))) == [0, 3]
    assert not Filters(min_chapters=0).active() and Filters(min_chapters=1).active()
    assert parse_year_range("2020..") == (2020, None) and parse_year_range("..2021") == (None, 2021) and parse_year_range("2020") == (2020, 2020)
    assert parse_categories(["gl,bl", "gl"], ["gl", "bl"]) == ["gl", "bl"] and parse_categories(["all"], ["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError, match="unknown"):
        parse_categories(["zz"], ["gl"])


def test_like_similar_query_and_session(spark):
    c = corpus(spark)
    assert [r.row_id for r in rank.like(c, "u0", 2).collect()] == [1, 2]
    assert rank.similar(c, "none").count() == 0 and rank.similar(c, "u0", category="bl").first().row_id == 2
    with pytest.raises(KeyError):
        rank.like(c, "none")
    enc = lambda texts: np.array([[0.0, 1.0]] * len(texts))
    assert rank.query(c, "t", enc, 1).first().row_id == 3
    parsed = rank.parse_reply('hm {"semantic_text": "q", "tags": ["x"], "status": "完结", "year_from": 2022, "min_chapters": "3"} end', "t")
    assert parsed[:2] == ("q", {"x"}) and parsed[2] == Filters(status="完结", year_from=2022)
    assert rank.parse_reply("no json", "t") == ("t", set(), Filters())
    assert [r.row_id for r in rank.query(c, "t", enc, 5, None, parsed).collect()] == [3]
    assert rank.parse_replies(spark.createDataFrame([('x {"tags": ["a"], "status": "?"} y',), ("none",)], "reply string")).collect()[0].tags == ["a"]
    s = Session(c, enc, 2)
    assert [r.row_id for r in s.do("like moon").collect()] == [1, 2]  # the shortest title that holds it, then the first
    assert [r.row_id for r in s.do("completed").collect()] == [2, 4] and s.do("more 2").count() == 2
    assert [r.row_id for r in s.do("tags y,x").collect()] == [3, 0] and s.do("any").count() == 2 and s.do("n 1").count() == 1
    ranked = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "rank int, url string")
    order = spark.createDataFrame([(0, 3, "good"), (1, 9, "bad"), (2, 3, "twice"), (3, 1, "")], "seq int, i int, reason string")
    assert [r.rank for r in rank.rerank(ranked, order, 4).collect()] == [3, 1, 0, 2, 4]


def test_listings(spark):
    c = corpus(spark)
    rows = rank.tag_listing(c, ["x"], 2).collect()
    assert [r.row_id for r in rows] == [3, 1] and rows[0].total == 3
    assert [tuple(r) for r in rank.top_tags(c, 3).collect()] == [("x", 3), ("y", 2), ("z", 1)]
    assert [r.row_id for r in rank.library_search(c, "MOON", downloaded_only=True).collect()] == [3, 0]
    assert rank.top_per_category(c, 1, F.col("row_id")).count() == 2


def test_bulk_neighbours_equal_single_queries(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(80, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, embedding array<float>").repartition(5)
    q = c.where("row_id < 9").withColumnRenamed("row_id", "query_id")
    got = {(r.query_id, r["rank"]): r.row_id for r in rank.knn_join(q, c, 4, block=4).collect()}
    f = v.astype(np.float32).astype(np.float64)
    want = {(i, k + 1): j for i in range(9) for k, j in enumerate(np.argsort(-(f @ f[i]), kind="stable")[:4])}
    assert got == want


def test_neighbours_skip_what_cannot_be_near(spark, monkeypatch):
    # rows around 40 far points: groups away from a query are skipped, and nothing is lost; equal rows tie by id
    rng = np.random.default_rng(9)
    points = rng.normal(size=(40, 16))
    x = points[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 0.05
    x[3000:3100] = x[:100]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = rank.fit_centres(x[::20])
    known = rank.Neighbours(x[:50], centres, 7)
    known.show(np.arange(300), x[::20])
    near = rank.Neighbours(x[:50], centres, 7, known.least)
    for at in range(0, 6000, 1500):
        near.show(np.arange(at, at + 1500), x[at : at + 1500])
    query, _, _, ids = near.best()
    s = np.round(x[:50] @ x.T, 12)
    want = np.array([np.lexsort((np.arange(6000), -s[i]))[:7] for i in range(50)])
    assert (ids.reshape(50, 7) == want).all() and (query.reshape(50, 7) == np.arange(50)[:, None]).all()
    assert near.skipped > 0.8 * near.asked
    monkeypatch.setattr(rank, "HELD", 100)
    monkeypatch.setattr(rank, "SCORE_BYTES", 4096)
    again = rank.Neighbours(x[:50], rank.fit_centres(x[:3]), 7)
    again.show(np.arange(6000), x)
    assert (again.best()[3].reshape(50, 7) == want).all()
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:300])], "row_id long, embedding array<float>")
    assert rank.knn_join(c.limit(0).withColumnRenamed("row_id", "query_id"), c).collect() == []
    assert rank.knn_join(c.limit(2).withColumnRenamed("row_id", "query_id"), c.limit(0)).collect() == []
    few = rank.knn_join(c.limit(2).withColumnRenamed("row_id", "query_id"), c.limit(3), 5).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(i, k) for i in range(2) for k in (1, 2, 3)]


def brute_way(run, prices, unknown):
    """Least price, fewest words, longest last words, over all ways."""
    ways = {0: [((), 0)]}
    for end in range(1, len(run) + 1):
        ways[end] = [((*way, run[s:end]), cost + p) for s in range(end) for way, cost in ways[s] if (p := prices.get(run[s:end], unknown if end - s == 1 else None)) is not None]
        if end - 1 in ways and run[end - 1 : end] in prices:
            ways[end] += [((*way, run[end - 1 : end]), cost + unknown) for way, cost in ways[end - 1]]
    return min(ways[len(run)], key=lambda w: (w[1], len(w[0]), [-len(x) for x in reversed(w[0])]))[0]


def test_words_without_spaces(spark):
    rng = random.Random(3)
    prices = {"".join(rng.choice("abc中") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 9) for _ in range(18)}
    runs = ["".join(rng.choice("abc中") for _ in range(rng.randrange(1, 10))) for _ in range(120)]
    rows = [(i, f"{r}, {runs[i - 1]}! ") for i, r in enumerate(runs)] + [(900, None), (901, " ., "), (902, "")]
    dictionary = spark.createDataFrame([(w, p, w.upper()) for w, p in prices.items()] + [(w, p + 1, "dear") for w, p in prices.items()], "word string, price int, reading string")
    got = {}
    for r in words.segment(spark.createDataFrame(rows, "doc_id int, text string"), dictionary, unknown=5).orderBy("doc_id", "place", "start").collect():
        got.setdefault((r.doc_id, r.place), []).append(r.word)
        assert r.reading in (None, r.word.upper())
    assert got == {(i, k): list(brute_way(r, prices, 5)) for i in range(120) for k, r in enumerate((runs[i], runs[i - 1]))}
    long = "abc中" * 20_000
    n = words.segment(spark.createDataFrame([(1, long)], "doc_id int, text string"), dictionary).agg(F.sum(F.length("word"))).first()[0]
    assert n == len(long)
    none = words.segment(spark.createDataFrame([(1, "ab")], "doc_id int, text string"), dictionary.limit(0)).collect()
    assert sorted((r.start, r.word, r.reading) for r in none) == [(0, "a", None), (1, "b", None)]


def test_closest_titles_equal_brute_force(spark):
    import difflib

    rng = random.Random(12)
    words = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyzäé") for _ in range(rng.randrange(2, 9)))) for _ in range(300)]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(4000)] + ["", "the moon rises", "the moon rise", "moon the rises", "the moons rise"]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(titles)] + [(None, -1)], "title string, row_id long")
    for query, n, cutoff in (("the moon rises", 3, 0.55), (titles[5], 1, 0.5), ("", 2, 0.5), (titles[9][::-1], 5, 0.3)):
        ratio = lambda t, q=query: difflib.SequenceMatcher(None, t, q).ratio()
        want = sorted(((ratio(t), t) for t in [*titles, ""] if ratio(t) >= cutoff), reverse=True)[:n]
        assert [(r.ratio, r.title) for r in resolve.closest(df, query, n, cutoff).collect()] == want
    assert resolve.able(df, "the moon rises", 3, 0.55).count() < 0.05 * len(titles)
    assert resolve.closest(df.limit(0), "x", 3, 0.5).collect() == []


def test_resolution_tiers(spark):
    c = corpus(spark)
    title = lambda q: [r.title for r in resolve.resolve_title(c, q).collect()]
    assert title(" moon two ") == ["Moon Two"] and title("moon") == ["Moon One"] and title("Moan Twa") == ["Moon Two"] and title("zzzzqq") == []
    assert resolve.resolve_target(c, "Sun") == ("u2", None)
    url, many = resolve.resolve_target(c, "Moon ")
    assert url is None and [r.title for r in many.collect()] == ["Moon One", "Moon Two", "Moonlight"]
    assert resolve.resolve_target(c, "Moon Two", downloaded_only=True)[0] is None
    landing = lambda u: urls.is_landing(u, SITE, CATS)
    assert resolve.resolve_target(c, "https://books.example/gl/a.html", landing) == ("https://books.example/gl/a.html", None)
    assert resolve.resolve_target(c, "https://x.example/gl/a.html", landing) == (None, None)
    nid = one(spark, urls.nid_encode(F.lit("https://a/b.html")))
    ids = spark.createDataFrame([("gl/a",), ("gl/a.txt",), ("raw/x.txt",), (nid,), ("?",)], "id string")
    slugs, paths = spark.createDataFrame([("gl/a", "U")], "slug string, url string"), spark.createDataFrame([("raw/x.txt",)], "path string")
    assert {r.id: (r.url, r.kind) for r in resolve.resolve_ids(ids, slugs, paths).collect()} == {"gl/a": ("U", "slug"), "gl/a.txt": ("U", "slug"), "raw/x.txt": ("raw/x.txt", "path"), nid: ("https://a/b.html", "nid"), "?": (None, None)}
    clash = spark.createDataFrame([("s", "u2", 2), ("s", "u1", 1), (None, "u3", 0)], "slug string, url string, load_order int")
    assert [tuple(r) for r in resolve.slug_index(clash).collect()] == [("s", "u1")]


# --- store ---


def test_upsert_is_a_sequential_fold(spark):
    rng = random.Random(1)
    old = [{"url": f"u{i}", "source": rng.choice(["meta", "full"]), "content_hash": str(rng.randrange(3))} for i in range(6)]
    new = [{"url": f"u{rng.randrange(9)}", "source": rng.choice(["meta", "full", "odd"]), "content_hash": str(rng.randrange(3)), "title": str(k)} for k in range(80)]
    held, added, updated = {r["url"]: r for r in old}, 0, 0
    for r in new:
        have, level = held.get(r["url"]), lambda x: K.SOURCE_RANK.get(x["source"], 0)
        if have is None:
            added += 1
        elif level(r) > level(have) or level(r) == level(have) and r["content_hash"] != have["content_hash"]:
            updated += 1
        else:
            continue
        held[r["url"]] = r
    rows = records(spark, new).collect()
    order = {r.title: i for i, r in enumerate(rows)}
    seq = spark.createDataFrame([(t, i) for t, i in order.items()], "title string, seq long")
    hot = [{"url": "hot" if rng.random() < 0.8 else f"h{rng.randrange(30)}", "source": rng.choice(["meta", "full"] if k < 900 else ["full"]), "content_hash": rng.choice([None, "a", "b"]), "seq": k} for k in range(4000)]
    want = {}
    for r in hot:
        have, rank = want.get(r["url"]), K.SOURCE_RANK.get(r["source"], 0)
        if have is None:
            want[r["url"]] = (rank, r["content_hash"], r["seq"], 0)
        elif rank > have[0] or rank == have[0] and r["content_hash"] != have[1]:
            want[r["url"]] = (rank, r["content_hash"], r["seq"], have[3] + 1)
    many = spark.createDataFrame([tuple(r.values()) for r in hot], "url string, source string, content_hash string, seq long").repartition(7)
    got, changed = store.upsert(many.limit(0).withColumn("v", F.col("seq")).drop("seq"), many.withColumn("v", F.col("seq")))
    assert {r.url: (r.v, r.updated, r.added) for r in got.join(changed, "url").collect()} == {u: (w[2], w[3], 1) for u, w in want.items()}
    after, changes = store.upsert(records(spark, old), records(spark, new).join(seq, "title").withColumn("seq", F.col("title").cast("long")))
    assert {r.url: (r.source, r.content_hash, r.title) for r in after.collect()} == {u: (r["source"], r["content_hash"], r.get("title", "")) for u, r in held.items()}
    totals = changes.agg(F.sum("added"), F.sum("updated")).first()
    assert tuple(totals) == (added, updated)


def test_incremental_index(spark):
    rows = [{"url": f"u{i}", "title": f"t{i}", "upload_date": f"2020-0{9 - i}"} for i in range(5)]
    calls = []
    enc = rank.HashingEncoder(8)
    first, counts = rank.build_index(records(spark, rows), None, enc.name, enc)
    assert counts == {"total": 5, "embedded": 5, "reused": 0}
    assert [r.url for r in first.orderBy("row_id").collect()] == ["u4", "u3", "u2", "u1", "u0"] and sorted(r.row_id for r in first.collect()) == list(range(5))
    rows[1]["title"] = "new"
    again, counts = rank.build_index(records(spark, rows[1:] + [{"url": "u9"}]), first, enc.name, enc)
    assert counts == {"total": 5, "embedded": 2, "reused": 3} and "u0" not in {r.url for r in again.collect()}
    assert rank.build_index(records(spark, rows), first, "other", enc)[1]["reused"] == 0 and not calls
    with pytest.raises(ValueError, match="empty"):
        rank.build_index(records(spark, []), None, "m", enc)
    delta = store.index_delta(records(spark, rows).select("url", "content_hash"), first)
    assert {r.url: r.action for r in delta.collect()} == {"u0": "reuse", "u1": "embed", "u2": "reuse", "u3": "reuse", "u4": "reuse"}
    assert np.allclose(np.linalg.norm(enc(["a b c", "语言"]), axis=1), 1)


def test_index_rows_are_numbered_without_gaps(spark):
    """Ranges that are cut twice, for the rows and for their sizes, may have other bounds or numbers each time."""
    rows = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("h").alias("content_hash"), F.sha1(F.col("id").cast("string").cast("binary")).alias("upload_date"), F.lit("t").alias("title"), F.array(F.lit("x")).alias("tags"), *[F.lit("").alias(c) for c in ("one_liner", "synopsis", "excerpt")])
    enc = rank.HashingEncoder(2)
    index, _ = rank.build_index(rows, None, enc.name, enc)
    assert "RepartitionByExpression" not in index._jdf.queryExecution().analyzed().toString()
    dates = {r.url: r.upload_date for r in rows.collect()}
    assert [r.row_id for r in sorted(index.collect(), key=lambda r: dates[r.url])] == list(range(3000))


def test_stores_round_trip(spark, tmp_path):
    rows = records(spark, [{"url": "b", "category": "gl", "upload_date": "1", "tags": ["x"]}, {"url": "a", "category": "gl", "upload_date": "1"}, {"url": "c", "category": "bl", "title": "T", "content_hash": "kept"}])
    path = str(tmp_path / "store")
    for _ in range(2):  # written twice: the second replaces the first
        writers.write_records(rows, path)
    back = readers.load_records(spark, [path, str(tmp_path / "missing")])
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert readers.load_records(spark, [str(tmp_path / "none")]).count() == 0
    (tmp_path / "x.jsonl").write_text('{"url": "c", "title": "old", "more": 1}\n\n{"url": "c", "title": "later"}\n')
    merged = {r.url: r.title for r in readers.load_records(spark, [path, str(tmp_path / "x.jsonl")]).collect()}
    assert merged == {"a": "", "b": "", "c": "later"}
    enc = rank.HashingEncoder(4)
    index, _ = rank.build_index(rows, None, enc.name, enc)
    assert readers.load_index(spark, str(tmp_path / "ix")) is None
    writers.write_index(index, str(tmp_path / "ix"), enc.name, "now")
    loaded = readers.load_index(spark, str(tmp_path / "ix"))
    assert readers.load_engine(loaded, rows).count() == 3
    with pytest.raises(ValueError, match="without a record"):
        readers.load_engine(loaded, rows.where("url <> 'a'"))
    cat = tmp_path / "c.json"
    cat.write_text(json.dumps([{"url": "a"}, {"url": "b", "fetch_status": "not_found"}]))
    both, live = readers.load_catalogue(spark, str(cat))
    assert (both.count(), live.count()) == (2, 1)
    cat.write_text(json.dumps([{"url": "a"}, {"url": "a"}]))
    with pytest.raises(ValueError, match="repeated"):
        readers.load_catalogue(spark, str(cat))


def test_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """No list of names passes through the driver, and no folder is made for each file."""
    rows = spark.range(500).select(F.concat(F.col("id") % 3, F.lit("/t"), "id", F.lit(".txt")).alias("file"), F.when(F.col("id") != 7, F.concat(F.lit("a\n\n"), "id", F.when(F.col("id") % 2 == 0, "\n").otherwise(""))).alias("text")).repartition(8)
    monkeypatch.setattr(type(rows), "toLocalIterator", None)
    long = "名" * 84
    for _ in range(2):
        writers.write_texts(rows, str(tmp_path / "a"))
    found = {str(p.relative_to(tmp_path / "a")): p.read_text() for p in (tmp_path / "a").rglob("*") if p.is_file()}
    assert found == {f"{i % 3}/t{i}.txt": "\n" if i == 7 else f"a\n\n{i}\n" for i in range(500)}
    writers.write_texts(spark.createDataFrame([(long, "x")], "file string, text string"), str(tmp_path / "b"))
    assert [p.name for p in (tmp_path / "b").iterdir()] == [long]


def test_user_state_is_a_file_a_user(spark, tmp_path):
    path = str(tmp_path / "s")
    assert readers.load_user_state(spark, path, "n long, x string").count() == 0
    state = lambda rows: spark.createDataFrame(rows, "user string, n long, x string")
    writers.write_user_state(state([("user-a", i, None) for i in range(3)] + [("user-b", 9, "old\n"), ("user-c", 5, "")]).repartition(4), path)
    writers.write_user_state(state([("user-b", 1, "é")]), path)
    assert sorted(tuple(r) for r in readers.load_user_state(spark, path, "n long, x string").select("user", "n", "x").na.fill("-").collect()) == [("user-a", 0, "-"), ("user-a", 1, "-"), ("user-a", 2, "-"), ("user-b", 1, "é"), ("user-c", 5, "")]
    assert sorted(p.name for p in (tmp_path / "s").rglob("*") if p.is_file()) == ["user-a.json", "user-b.json", "user-c.json"]
    with pytest.raises(ValueError, match="user name"):
        writers.write_user_state(state([("../a", 1, None)]), path)


def test_worklists(spark):
    nodes = spark.createDataFrame([("old", "ok"), ("new", "ok"), ("dead", "not_found"), ("done", None), ("bare", "ok")], "url string, fetch_status string")
    meta = spark.createDataFrame([("old", "2020年"), ("new", "2025年")], "url string, upload_date string")
    todo = store.pending(nodes, spark.createDataFrame([("done",)], "url string"))
    assert [r.url for r in store.worklist(todo, meta).collect()] == ["bare", "old", "new"]
    assert [r.url for r in store.worklist(todo, meta, 1, forward=True).collect()] == ["new"]
    sample = store.oldest_and_sample(meta.withColumn("category", F.lit("x")), 1, 1, 1, "category")
    assert sample.count() == 2 and store.oldest_and_sample(meta, 1, 5, 1).count() == 2


# --- graph ---


def nodes(spark, rows):
    full = [(u, "gl", u, "", d, s, p, n, [], True) for u, d, s, p, n in rows]
    return spark.createDataFrame(full, CATALOG)


def test_chains_cycles_and_joins(spark):
    g = nodes(spark, [("a", "1", "ok", None, "b"), ("b", "2", "ok", "a", "x"), ("x", "3", "not_found", "b", "c"), ("c", "4", "ok", "x", "d"), ("d", "5", "ok", "c", "zz"), ("p", "6", "ok", "q", "q"), ("q", "5", "ok", "p", "p"), ("m", "7", "ok", None, "n"), ("n", "8", "ok", "k", None), ("k", "9", None, None, None)])
    kinds = {r.url: r.kind for r in graph.boundaries(g, "next").collect()}
    assert kinds == {"a": "connected", "b": "confirmed_404", "c": "connected", "d": "missing_from_catalogue", "p": "connected", "q": "connected", "m": "non_reciprocal", "n": "chain_end", "k": "chain_end"}
    c = graph.chains(g)
    assert [(r.urls, r.is_cycle, r.start_boundary.kind, r.end_boundary.kind) for r in c.orderBy("chain_number").collect()] == [(["a", "b"], False, "chain_end", "confirmed_404"), (["c", "d"], False, "confirmed_404", "missing_from_catalogue"), (["q", "p"], True, "cycle", "cycle"), (["m"], False, "chain_end", "non_reciprocal"), (["n"], False, "non_reciprocal", "chain_end"), (["k"], False, "chain_end", "chain_end")]
    d = [(r.start_url, r.parts, r.novel_count) for r in graph.display_chains(c).orderBy("display_number").collect()]
    assert d == [("a", [1, 2], 4), ("q", [3], 2), ("m", [4], 1), ("n", [5], 1), ("k", [6], 1)]
    counted = graph.chain_counters(c).first()
    assert (counted.chains, counted.novels, counted.cycles, counted.longest) == (6, 9, 1, 2)
    assert reports_text(c).startswith("Catalogue chains")


def reports_text(c):
    return reports.chain_table(c)


def brute_reach(rows, seeds, limit):
    """Least depths by relaxing every link until nothing falls."""
    held, depth = {r[0]: r for r in rows}, dict.fromkeys(seeds, 0)
    todo = list(seeds)
    while todo:
        url = todo.pop()
        _, prev, nxt, recs = held.get(url, (url, None, None, []))
        for to, d in [*((u, 0) for u in (prev, nxt) if u), *((u, depth[url] + 1) for u in recs)]:
            if d <= limit and d < depth.get(to, limit + 1):
                depth[to] = d
                todo.append(to)
    return {u: (d, "seed" if u in seeds else "rec" if d else "chain") for u, d in depth.items()}


WEB = "url string, prev_url string, next_url string, rec_urls array<string>"


def test_frontier_takes_the_cheaper_way(spark):
    # the long way by links reaches Y at depth 1, the short one by recommendations at 2
    links = {"A": (None, "B", ["R"]), "B": ("A", "C", []), "C": ("B", None, ["Y"]), "R": (None, None, ["Y"]), "Y": (None, None, ["Z1"]), "Z1": (None, None, ["Z2"]), "Z2": (None, None, ["Z3"]), "Z3": (None, None, [])}
    web = spark.createDataFrame([(u, *x) for u, x in links.items()], WEB)
    got = {r.url: r.depth for r in graph.frontier(web, spark.createDataFrame([("A",)], "url string"), 4).collect()}
    assert got == {"A": 0, "B": 0, "C": 0, "R": 1, "Y": 1, "Z1": 2, "Z2": 3, "Z3": 4}
    assert graph.frontier(web, spark.createDataFrame([], "url string"), 4).collect() == []


def test_frontier_equals_relaxation_on_random_graphs(spark):
    # 200 graphs side by side: links that answer each other, links that don't, rings, self-links, unknown urls
    rng = random.Random(11)
    rows, seeds = [], []
    for g in range(200):
        names = [f"{g}:{i}" for i in range(rng.randrange(3, 14))]
        prev, nxt = dict.fromkeys(names), dict.fromkeys(names)
        for a, b in zip(names, names[1:] + names[:1], strict=True):
            if rng.random() < 0.5:
                nxt[a], prev[b] = b, a
        for n in names:
            if rng.random() < 0.2:
                (prev if rng.random() < 0.5 else nxt)[n] = rng.choice([*names, f"{g}:gone", ""])
        rows += [(n, prev[n], nxt[n], [rng.choice(names) for _ in range(rng.choice([0, 0, 1, 1, 2]))]) for n in names]
        seeds.append(rng.choice(names))
    for limit in (1, 3):
        got = graph.frontier(spark.createDataFrame(rows, WEB), spark.createDataFrame([(s,) for s in seeds], "url string"), limit)
        assert {r.url: (r.depth, r.via) for r in got.collect()} == brute_reach(rows, seeds, limit)


def test_long_chain_and_frontier(spark):
    n = 70
    g = nodes(spark, [(f"{i:03}", "1", "ok", f"{i - 1:03}" if i else None, f"{i + 1:03}" if i < n - 1 else None) for i in range(n)])
    assert [len(r.urls) for r in graph.chains(g).collect()] == [n]
    web = spark.createDataFrame([("s", None, None, ["r1"]), ("r1", None, None, ["r2"]), ("r2", None, "c1", ["r3"]), ("c1", "r2", None, ["e1"]), ("e1", None, None, ["e2"]), ("e2", None, None, [])], "url string, prev_url string, next_url string, rec_urls array<string>")
    seed = spark.createDataFrame([("s",)], "url string")
    assert {r.url: (r.depth, r.via) for r in graph.frontier(web, seed, 2).collect()} == {"s": (0, "seed"), "r1": (1, "rec"), "r2": (0, "chain"), "c1": (0, "chain"), "r3": (1, "rec"), "e1": (1, "rec"), "e2": (2, "rec")}
    assert {r.url for r in graph.frontier(web, seed, 1).collect()} == {"s", "r1"}
    pages = spark.createDataFrame([("u", i) for i in (2, 3, 7, 8, 13)] + [("v", 7)], "url string, page_no int")
    assert sorted((r.url, r.page_no) for r in graph.probed_pages(pages).collect()) == [("u", 2), ("u", 3), ("u", 7), ("u", 8)]


# --- urls and scalars ---


def test_url_ids_are_worked_out_once(spark):
    """Every use of an id used to be another fold over its digits, 18 for two steps; a plan shows each twice."""
    plan = spark.range(1).select(F.lit("https://b.example/a/b/0z.html").alias("url")).select(urls.step_url_id(F.col("url"), 1), urls.step_url_id(F.col("url"), -1))._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") == 8
    url = F.lit("https://b.example/a/b/zz.html")
    assert one(spark, urls.step_url_id(url, 1)) == "https://b.example/a/b/100.html" and one(spark, urls.step_url_id(url, -3843)) == "https://b.example/a/b/00.html" and one(spark, urls.step_url_id(url, -3844)) is None
    assert one(spark, urls.base62_encode(F.lit(0), 4)) == "0000" and one(spark, urls.base62_decode(F.lit("a-b"))) is None


def test_urls(spark):
    landing = lambda u: one(spark, urls.is_landing(F.lit(u), SITE, CATS))
    good = ["https://www.books.example/gl/01_b/ab1.html", "http://u:p@books.example:8080/gl/x.html?q#f"]
    bad = ["https://evilbooks.example/gl/x.html", "ftp://books.example/gl/x.html", "https://books.example/x.html", "https://books.example/gl/index_2.html", "https://books.example/gl/x_12.html", "https://books.example/zz/x.html", "https://books.example/gl/x.htm", "https://books.example/gl/.html"]
    assert all(map(landing, good)) and not any(map(landing, bad))
    valid = lambda pages: one(spark, urls.page_urls_valid(F.lit("https://books.example/gl/x.html"), F.array(*map(F.lit, pages)), SITE))
    assert valid(["https://www.books.example/gl/x_2.html", "https://books.example/gl/x_13.html"]) and not valid(["https://books.example/gl/x_2.html", "https://books.example/gl/y_3.html"])
    assert one(spark, urls.page_url_ok(F.lit("https://books.example/gl/"), F.lit("anything"), SITE))
    step = lambda u, d: one(spark, urls.step_url_id(F.lit(u), d))
    assert step("https://a/gl/b/0z.html", 1) == "https://a/gl/b/10.html" and step("https://a/zz.html", 1) == "https://a/100.html" and step("https://a/00.html", -1) is None and step("https://a/b-c.html", 1) is None
    for n in (0, 1, 61, 62, 3843, 62**9):
        code = one(spark, urls.base62_encode(F.lit(n), 3))
        assert len(code) >= 3 and one(spark, urls.base62_decode(F.lit(code))) == n
    assert one(spark, urls.base62_decode(F.lit("a-b"))) is None
    assert one(spark, urls.nid_decode(urls.nid_encode(F.lit("https://a/é?x=1")))) == "https://a/é?x=1"
    assert one(spark, urls.absolute_url(F.lit("../b.html"), F.lit("https://a/x/y/z.html"))) == "https://a/x/b.html"
    assert one(spark, urls.page_urls(F.lit("https://a/x.html"), F.lit(2))) == ["https://a/x_2.html", "https://a/x_3.html"]
    assert tuple(one(spark, urls.url_parts(F.lit("https://a/gl/02_b/x.html")))) == ("gl", "02_b", "x")


def test_scalars(spark):
    doc = scalars.embed_text(F.lit("T"), F.array(F.lit("a"), F.lit("b")), F.lit(""), F.lit("语"), F.lit("e" * 2000))
    want = "T\na b\n语\n" + "e" * 1500
    assert one(spark, doc) == want and one(spark, scalars.content_hash(doc)) == hashlib.sha1(want.encode()).hexdigest()
    assert tuple(one(spark, scalars.parse_heading(F.lit(" 书_名_人【完结】tail ")))) == ("书", "名_人", "完结")
    assert one(spark, scalars.title_to_filename(F.lit('a:b "c'), F.lit("x y"), F.lit(""))) == "ab_c_x_y.txt"
    assert one(spark, scalars.nonspace_chars(F.lit("a　b\xa0 \n语"))) == 3
    names = {"《测试书》 - 某作者 (完结)": ("测试书", "某作者", "完结"), "公主病_鱼霜": ("公主病", "鱼霜", ""), "【GL】难缠": ("难缠", "", ""), "plain name": ("plain name", "", ""), "A - B": ("A", "B", "")}
    for stem, parts in names.items():
        assert tuple(one(spark, scalars.parse_filename(F.lit(stem)))) == parts
    assert one(spark, scalars.safe_filename(F.lit("../a:b?.txt"))) == "a_b_.txt" and one(spark, scalars.safe_filename(F.lit("..."))) == "untitled"
    assert one(spark, scalars.human_size(F.lit(1536))) == "1.5 KB" and one(spark, scalars.watch_size(F.lit(10))) == "10 B" and one(spark, scalars.kb_size(F.lit(2048.0))) == "2.00 MB"
    assert [one(spark, scalars.result_similarity(F.lit(x))) for x in (0.005, 0.015, -1.0, 2.0)] == [0, 2, 0, 100]
    payload = {"text": 'a "q"\n语', "voice": "v", "rate": "+0%", "volume": "x", "pitch": "p"}
    cols = [F.lit(payload[k]) for k in ("text", "voice", "rate", "volume", "pitch")]
    assert one(spark, scalars.chunk_hash(*cols)) == hashlib.sha1(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:16]
    verdict = lambda e, s, b: one(spark, scalars.response_verdict(F.lit(e).cast("string"), F.lit(s), F.lit(b)))
    assert [verdict(None, 429, "article-content"), verdict(None, 503, "article-content"), verdict(None, 200, "Just a moment"), verdict(None, 404, ""), verdict(None, 200, ""), verdict("x", 200, ""), verdict(None, 500, None)] == ["rate_limited", "ok", "challenged", "not_found", "challenged", "error", "error"]
    assert [one(spark, scalars.backoff_seconds(F.lit(i))) for i in range(5)] == [5, 10, 20, 40, 60]
    up = spark.createDataFrame([("Dup", 1), ("Dup", 2), ("New", 3)], "stem string, seq int")
    got = writers.upload_names(up, spark.createDataFrame([("Dup",)], "stem string"))
    assert sorted(r.file for r in got.collect()) == ["Dup_2.txt", "Dup_3.txt", "New.txt"]


# --- text ---


def blocks_by_hand(s, limit):
    out, cur, size = [], [], 0
    for line in [*s.strip().split("\n"), None]:
        if line is None or len(line) > limit or size >= limit:
            out += [b] if (b := "\n".join(cur).strip()) else []
            cur, size = [], 0
        if line is not None and len(line) > limit:
            out += [line[i : i + limit] for i in range(0, len(line), limit)]
        elif line is not None:
            cur, size = [*cur, line], size + len(line) + 1
    return out


def test_blocks_and_fallback(spark):
    rng = random.Random(2)
    texts = ["\n".join("字 " * rng.randrange(30) for _ in range(rng.randrange(30))) for _ in range(60)] + ["", "x" * 95, "  \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.b for r in df.select("doc_id", text.text_blocks(F.col("text"), 40).alias("b")).collect()}
    assert got == {i: blocks_by_hand(t, 40) for i, t in enumerate(texts)}
    parts = one(spark, text.fallback_chapters(F.lit("a" * 4017)))
    assert [p.title for p in parts] == ["Part 01", "Part 02", "Part 03"] and max(len(p.body) for p in parts) == 2000
    assert one(spark, text.fallback_chapters(F.lit(" "))) == []


def test_chapter_numbers(spark):
    cases = {"第1章 x": 1, "第五章": 5, "第十五章": 15, "第二十三章": 23, "第一百零三回": 103, "Chapter 7": 7, "12归来": 12, "楔子": None, "番外": None, "ch. 4 x": 4}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.chapter_number(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def chapters(spark, body, patterns=None, preamble=True):
    df = spark.createDataFrame([(0, body)], "doc_id int, text string")
    return [(r.title, r.body) for r in text.book_chapters(df, patterns, preamble).orderBy("chapter").collect()]


def test_chapters_by_headings(spark):
    assert chapters(spark, "intro\n第1章 One\nFirst\nbody\n第2章 Two\nx") == [("Front matter", "intro"), ("第1章 One", "First\nbody"), ("第2章 Two", "x")]
    assert chapters(spark, "chapter 1\na\nCHAPTER 2\nb", preamble=False) == [("chapter 1", "a"), ("CHAPTER 2", "b")]
    assert chapters(spark, "第1章 One\nx") == [("Part 01", "第1章 One\nx")]  # one heading is none
    assert chapters(spark, "1重生\na\n2归来\nb", [r"^\s*\d+\S.*$"]) == [("1重生", "a"), ("2归来", "b")]
    long = "\n".join(["行" * 99] * 100)
    c = chapters(spark, f"第1章\ns\n第2章\ns\n第3章\n{long}\n第10章\ns\n第11章\ns")
    assert [t for t, _ in c][:3] == ["第1章", "第2章", "第3章"] and "第3章 (2)" in dict(c) and c[-1][0] == "第11章"
    assert "\n".join(b for t, b in c if t.startswith("第3章")) == long
    assert len(chapters(spark, f"第1章\ns\n第2章\n{long}\n第3章\ns")) == 3
    early = chapters(spark, f"{long}\n第16章\ns\n第17章\ns")
    assert early[0][0] == "Front matter" and early[1][0] == "Front matter (2)"


def test_saved_file(spark, tmp_path):
    rule = "═" * 40
    saved = f"标题：书\n作者：人\n状态：完结\n上传时间：2024年11月11日 20:09:06\n章节数：2\n完整性：完整\n\n上一篇：—\n        URL:  https://books.example/gl/p.html\n        文件: —\n\n来源：https://books.example/gl/x.html\n\n内容标签： 甜 虐、书\n一句话简介：好\n正经简介。\n\n{rule}\n\n第1章 One\n\nFirst body\n\n{rule}\n\n第2章 Two\n\nmore [页面获取失败: https://u/2.html]\n"
    (tmp_path / "2024-11").mkdir()
    (tmp_path / "2024-11" / "x.txt").write_text(saved)
    files = readers.text_files(spark, str(tmp_path)).withColumn("url", readers.source_url(F.col("text")))
    r = readers.parse_saved(files, str(tmp_path)).first()
    assert (r.url, r.title, r.author, r.status, r.year_month, r.chapter_count, r.tags, r.one_liner, r.synopsis, r.category) == ("https://books.example/gl/x.html", "书", "人", "完结", "2024-11", 2, ["甜", "虐"], "好", "正经简介。", "gl")
    assert r.excerpt.startswith("First body\nmore") and r.file == "2024-11/x.txt" and r.source == "full"
    row = files.select(readers.is_complete(F.col("text")).alias("ok"), readers.navigation(F.col("text")).alias("nav"), reports.failed_page_urls(F.col("text")).alias("bad"), text.local_synopsis(F.col("text")).alias("syn")).first()
    assert row.ok and row.nav.prev_url == "https://books.example/gl/p.html" and row.nav.next_url is None and row.bad == ["https://u/2.html"] and row.syn.startswith("内容标签") and row.syn.endswith("正经简介。")
    assert readers.incomplete_files(files).count() == 1 and [x.url for x in reports.incomplete_urls(files).collect()] == ["https://books.example/gl/x.html"]
    got = [(x.title, x.body) for x in text.local_chapters(files).orderBy("chapter").collect()]
    assert got[0] == ("第1章 One", "First body") and len(got) == 2 and "═" not in got[1][1]
    page = files.withColumn("text", F.concat(F.lit("来源：u\nhead\n"), F.lit(rule), F.lit("\none\n"), F.lit(rule), F.lit("\ntwo")))
    assert [x.body for x in text.local_chapters(page, ["^none$"]).collect()] == ["one\n\ntwo"]
    assert [x.body for x in text.local_chapters(page.withColumn("text", F.lit("x\n来源：u\nalone")), ["^none$"]).collect()] == ["alone"]
    assert one(spark, text.local_synopsis(F.lit("来源：u\nsyn without divider"))) is None
    assert readers.file_facts(spark, str(tmp_path)).first().bytes == len(saved.encode())
    nav = {s: (F.lit("前_人【完结】"), F.lit("https://u")) for s in ("prev", "next")}
    arr = F.array(F.struct(F.lit(None).cast("string").alias("header"), F.lit("pre").alias("body")), F.struct(F.lit("第1章").alias("header"), F.lit("b").alias("body")))
    out = one(spark, writers.render_text(F.lit("书"), F.lit("人"), F.lit("完结"), F.lit("d"), F.lit("https://s"), nav, arr, F.lit(0), F.lit("now")))
    assert out.startswith("标题：书\n作者：人") and "章节数：1\n完整性：完整" in out and "        文件: 前_人_完结.txt" in out and out.endswith(f"来源：https://s\n\npre\n\n{rule}\n\n第1章\n\nb\n")
    patched = one(spark, writers.patch_navigation(F.lit(out), "上一篇：", F.lit("新$1"), F.lit("https://n"), F.lit("f.txt")))
    assert "上一篇：新$1\n        URL:  https://n\n        文件: f.txt\n" in patched and "下一篇：前" in patched


def odd_files(tmp_path):
    names = ["a b/中文 #1%.txt", "e%20c/x.txt", "k=1/_v=2/y.txt", "_k/n.txt", ".k/n.txt", "_n.txt", ".n.txt", "m.md", "deep/er/and/z.txt", "全\u3000角.txt", "n._COPYING_", "{b}.txt"]
    for i, name in enumerate(names):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xef\xbb\xbf\xff\n%d" % i)
    (tmp_path / "empty.txt").touch()
    (tmp_path / "p.txt.gz").write_bytes(gzip.compress(b"packed"))
    (tmp_path / "k=1" / "link").symlink_to(tmp_path / "a b")
    roots = [str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/{{a b,deep}}", f"{tmp_path}/m.md"]
    return [*((root, "*.txt") for root in roots), (roots[0], "*"), (roots[0], "[m-z]*.{md,txt,gz}")]


def test_texts_are_listed_and_read_by_tasks(spark, tmp_path):
    for root, glob in odd_files(tmp_path):
        got = readers.text_files(spark, root, glob)
        assert got.inputFiles() == []  # the driver has no list of them
        want = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select("_metadata.file_path", F.hex("value"))
        assert sorted(map(tuple, got.select("path", F.hex("text")).collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(FileNotFoundError):
        readers.text_files(spark, str(tmp_path / "none"))


def test_facts_are_listed_by_tasks(spark, tmp_path):
    for root, glob in odd_files(tmp_path):
        got = readers.file_facts(spark, root, glob)
        assert got.inputFiles() == []  # the driver has no list of them
        want = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "modificationTime", "length")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tag_extraction(spark):
    raw = "《书》作者：人【完结】　【文案】　很好看\n内容标签： 甜文　虐，HE\xa0番外\n搜索关键字：主角：林 ┃ 其它：刑侦、推理\n一句话简介：亲完\n立意：向上\n本书简介：心机\n====\n文案\n\n\n\n尾\n所属专题： 校园 / 系统\n人 钓系\n\n甜文\n开始阅读\n不要"
    got = tags.extract(raw, "书[刑侦]校园", "人")
    assert got == {"tags": ["甜文", "虐", "HE", "推理", "系统", "钓系"], "one_liner": "亲完", "intent": "向上", "synopsis": "很好看\n心机\n\n尾"}
    assert one(spark, tags.extract_tags(F.lit(raw), F.lit(None).cast("string"), F.lit("人"))).tags[0] == "甜文"
    assert one(spark, text.split_tags(F.lit(" a、b　完结 ／ccccccccccccc;d "))) == ["a", "b", "d"]


def test_split_tags_query_reads_whole_texts(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    spark.createDataFrame([(1, " ".join(words)), (2, "a、b")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.tags for r in queries.split_tags(spark, str(tmp_path)).collect()}
    assert got == {1: "|".join(words), 2: "a|b"}


def test_pages(spark):
    page = '<html><article class="article-content"><p>One <b>x</b><p>传送门：ad<br></p>Two<br>Three<script>s</script><div class="paginate">9</div><button>b</button></article></html>'
    assert html.reading_page(page, K.AD_MARKERS) == ("One x\n\nTwo\n\nThree", True)
    assert html.reading_page('<div id="nr1">a</div>', ()) == ("a", False) and html.reading_page("<p>no</p>", ()) == ("", False)
    assert html.paragraphs_only(page, K.AD_MARKERS) == "One x"
    landing = '<h1 class="article-title big"> 书_人【完结】 </h1><time class="muted">2024</time><ul class="list"><li class="mulu"><a href="x_2.html">1</a><li class="mulu"><a href="x_2.html">again</a><a href="/gl/x_3.html">2</a></ul><nav class="article-nav"><span class="article-nav-prev"><a href="/gl/p.html">P</a></span><span class="article-nav-next"><a href="/bl/n.html">N</a></span></nav><div class="related-posts"><a href="/gl/r.html">r</a><a href="/gl/r.html">r</a><a href="/zz/q.html">q</a></div>'
    url = "https://books.example/gl/x.html"
    assert html.landing_page(landing, url, SITE) == {"h1": "书_人【完结】", "upload_date": "2024", "chapter_urls": ["https://books.example/gl/x_2.html", "https://books.example/gl/x_3.html"], "prev_url": "https://books.example/gl/p.html", "prev_title": "P", "next_url": None, "next_title": None}
    assert html.related_links(landing, url, SITE, ("gl",)) == ["https://books.example/gl/r.html"]
    p = spark.createDataFrame([("u", 1, "pre\n\n第1章 a\n\nx"), ("u", 2, "  "), ("u", 3, "y\n\n第2章 b")], "url string, page_no int, text string")
    assert [(r.header, r.body) for r in text.chapters_from_pages(p).orderBy("order").collect()] == [(None, "pre"), ("第1章 a", "x\n\ny"), ("第2章 b", "")]
    assert tuple(text.first_chapter_preview(p).first()) == ("u", "第1章 a\n\nx\n\ny", False)
    assert tuple(text.first_chapter_preview(p, 1).first()) == ("u", "第1章 a\n\nx", True)


def test_bytes_and_books(spark, tmp_path):
    raw = ["语言".encode(), "﻿语".encode(), "语言文字".encode("gb18030"), b"\xff\xff\xff a", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, b binary")
    assert [r.t for r in df.select("i", readers.decode_text("b").alias("t")).orderBy("i").collect()] == ["语言", "语", "语言文字", "��� a", None]
    assert [one(spark, text.detect_language(F.lit(s))) for s in ("语言 ab", "a b c 语", "")] == ["zh", "en", "zh"]
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        z.writestr("O/c.opf", '<package xmlns="urn:p"><manifest><item id="a" href="a.xhtml"/><item id="b" href="t/b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("O/a.xhtml", "<p>First</p><script>no</script><p>line <i>two</i></p>")
        z.writestr("O/t/b.xhtml", "<h1>Head</h1>")
    (tmp_path / "b.epub").write_bytes(box.getvalue())
    (tmp_path / "bad.epub").write_bytes(b"no zip")
    got = {r.path.rpartition("/")[2]: (r.text, r.error is None) for r in readers.read_epubs(spark, str(tmp_path)).collect()}
    assert got == {"b.epub": ("Head\n\nFirst\n\nline two", True), "bad.epub": (None, False)}
    (tmp_path / "dir").mkdir()
    (tmp_path / ".hid").write_text("")
    rows = readers.list_dir(spark, str(tmp_path)).collect()
    assert [(r.name, r.kind) for r in rows] == [("dir", "dir"), ("b.epub", "doc"), ("bad.epub", "doc")]
    with pytest.raises(ValueError, match="leaves"):
        readers.safe_join(str(tmp_path / "dir"), "../b.epub")


def test_speech_and_windows(spark):
    chunks = one(spark, text.split_speech(F.lit("One. Two. Three.\n\nFour."), 12))
    assert len(chunks) >= 2 and max(map(len, chunks)) <= 12 and "".join(chunks).replace("\n", "").replace(" ", "") == "One.Two.Three.Four."
    assert one(spark, text.split_speech(F.lit("aaa bbb ccc ddd longlonglong"), 8)) == ["aaa bbb", "ccc ddd", "longlonglong"]
    lines = spark.createDataFrame([(0, i, f"l{i}") for i in range(1, 12)], "doc_id int, line_no int, line string")
    w = text.context_windows(lines, 4, 2, 3)
    assert sorted(r.line_no for r in w.where("commit").collect()) == list(range(1, 12))
    assert sorted(r.line_no for r in w.where("window = 2").collect()) == list(range(3, 12))
    breaks = spark.createDataFrame([(0, 3, "l3"), (0, 5, "x")], "doc_id int, line_no int, snippet string")
    assert [r.line_no for r in text.stale_breaks(lines, breaks).collect()] == [5]
    assert [r.line for r in text.insert_breaks(lines, breaks).orderBy("at").collect()][2:5] == ["* * *", "l3", "l4"]
    assert one(spark, text.plain_tokens(F.lit("a\n\nb"))) == ["a", "\n", "\n", "b"]
    assert one(spark, text.trim_synopsis(F.lit("a\nb\n第1章\nc"), F.lit("第1章"))) == "a\nb"
    arr = F.array(*[F.struct(F.lit(f"t{i}").alias("title"), F.lit(f"b{i}").alias("body")) for i in range(3)])
    assert one(spark, text.copy_payload(F.lit("syn"), arr, F.lit(0), F.lit(1))) == "syn\n\nt0\n\nb0" and one(spark, text.copy_payload(F.lit("syn"), arr, F.lit(1), F.lit(9))) == "t1\n\nb1\n\nt2\n\nb2"


def test_packing_is_linear(spark):
    # a million lines, and a long paragraph of short words
    lines = [f"line {i}" * (1 + i % 3) for i in range(1_000_000)]
    began = time.time()
    got = one(spark, F.size(text.text_blocks(F.concat(*[F.lit("\n".join(lines[i : i + 250_000]) + "\n") for i in range(0, 1_000_000, 250_000)]))))
    assert got == len(blocks_by_hand("\n".join(lines), 2000))
    words = ["word"] * 400_000
    chunks = one(spark, text.split_speech(F.lit(" ".join(words)), 99))
    assert len(chunks) == 400_000 // 20 + 0 and set(map(len, chunks)) == {99}
    assert time.time() - began < 60


def test_saved_pages_are_split_by_dividers(spark):
    d = "═" * 40
    body = lambda s: [one(spark, x) for x in text.local_body(F.lit(s))]
    assert body(f"来源：u\nhead\n{d}\np1\n\n{d}\n  \n{d} x\np2\np3") == ["来源：u\nhead\np1\n\n  \np2\np3", "p1\n\n\np2\np3"]
    assert body(f"{d}\na\r\nb\n{d}") == ["a\r\nb", "a\r\nb"] and body(f"x\n{d}") == ["x", ""] and body("来源：u\n a \nb ") == ["来源：u\n a \nb ", "a \nb"]


def test_heading_patterns(spark):
    kinds = {"第十2回 x": 1, "第 1章": 5, "CHAPTER one": 2, "chapter1 x": 5, "Act": 2, "１２ a": 3, "二、x": 4, "正文 12 重生": 5, "a.b 3 c": 5}
    parts = {1: r"\s*第[零一二三四五六七八九十百千万亿两〇0-9]+[章回卷节部篇折]\s*.*", 2: r"\s*(?:chapter|prologue|epilogue|interlude|part|volume|book|act)\b.{0,98}", 3: r"\s*\d+\s*(?:[、.)）]\s*)?\S.{0,98}", 4: r"\s*[零一二三四五六七八九十百千万亿两〇]+\s*(?:[、.)）]\s*)?\S.{0,98}"}
    for example, kind in kinds.items():
        label = re.escape(re.match(r"\D*", example)[0].strip())
        assert text._series(example) == parts.get(kind, rf"\s*{label}\s*\d+\s*\S.{{0,98}}")
    with pytest.raises(ValueError):
        text.infer_pattern("no number")
    p = text.infer_pattern("1重生\n2 归来\n003、终章")
    assert one(spark, text.pattern_matches(F.lit("1重生\nnope\r\n 12 x \n"), p)) == ["1重生", "12 x"]
    assert text.infer_pattern("正文 12 重生").startswith("^") and "|" in text.infer_pattern("第1章 a\n12 b")
    assert text.infer_pattern("第1章 a\n12 b") == r"^(?:(?:\s*第[零一二三四五六七八九十百千万亿两〇0-9]+[章回卷节部篇折]\s*.*)|(?:\s*\d+\s*(?:[、.)）]\s*)?\S.{0,98}))$"
    for good in (r"^(?:a|b)+x"[:-2] + "x", r"^第\d+章(?:x)?", r"^[ab]{2,5}(c|d)?$", r"^\s*\bact\b.{0,98}$"):
        assert text.validate_pattern(f" {good} ") == good
    for bad in (r"^(?:ab)+$", r"^(?:ab|c){2}", r"^(?i:a)", r"^(?P<n>a)", r"^(?<!a)b", r"^(?>a)", r"^\d+(x*)*"):
        with pytest.raises(ValueError):
            text.validate_pattern(bad)
    for bad in (r"\d+title", r"^(a+)+$", r"^(a)\1$", r"^(?=a)", "^[", "^" + "a" * 300, ""):
        with pytest.raises(ValueError):
            text.validate_pattern(bad)
    got = text.effective_patterns({"english-standard": {"label": "E"}, "mine": {"pattern": "^x"}}, ["chinese-standard"])
    assert [(x["id"], x["label"], x["builtin"]) for x in got] == [("english-standard", "E", True), ("mine", "mine", False)]
    assert one(spark, text.tone_marks(F.lit("ni3 hao3 lv4 lu:4 xue2 gou3 de5 x"))) == "nǐ hǎo lǜ lu:4 xué gǒu de x"
    assert one(spark, text.to_simplified(F.lit("書裏頭發"), {"書": "书", "頭發": "头发", "裏": "里"})) == "书里头发"


def test_word_edges_are_ascii_where_asked(spark):
    lines = "Anêe x\nAn x\nanother\nAN"
    assert one(spark, text.pattern_matches(F.lit(lines), r"^an\b.*$", ascii_words=True)) == ["Anêe x", "An x", "AN"]
    assert one(spark, text.pattern_matches(F.lit("a\\b\naé"), r"^a\\b$", ascii_words=True)) == ["a\\b"]
    books = spark.createDataFrame([(1, lines)], "doc_id long, text string")
    assert [r.title for r in text.chapters_from_patterns(books, [r"^an\b"], ascii_words=True).orderBy("order").collect()] == ["Anêe x", "An x", "AN"]


def test_dictionary_and_logs(spark):
    lines = spark.createDataFrame([(1, "# x"), (2, "書 书 [shu1] /book/letter/"), (3, "好 好 [hao3] /good/"), (4, "好 好 [hao4] /to like/"), (5, "書好 书好 [shu1 hao3] /test/")], "line_no int, line string")
    d = readers.dictionary(lines, text.tone_marks)
    got = {r.word: r for r in user.define(spark.createDataFrame([("书好",), ("好",), ("好x",), ("?",)], "word string"), d).collect()}
    assert [e.pinyin for e in got["好"].entries] == ["hǎo", "hào"] and got["好"].per_char == []
    assert [c.char for c in got["书好"].per_char] == ["书", "好"] and [c.pinyin for c in got["好x"].per_char] == ["hǎo"] and got["?"].entries == []
    log = spark.createDataFrame([("f", 1, "ok 12p"), ("f", 2, "https://a/x"), ("f", 3, "3p"), ("f", 4, "https://a/x"), ("f", 5, "9p")], "file string, line_no int, line string")
    assert [tuple(r) for r in readers.page_counts(log).collect()] == [("https://a/x", 12)]


# --- reports ---


def test_reports(spark):
    cats = spark.createDataFrame([("gl",), ("none",)], "category string")
    files = spark.createDataFrame([("gl", 1024), ("gl", 512)], "category string, bytes long")
    r = reports.size_report(cats, files)
    assert {x.category: (x.files, x.bytes, x.average) for x in r.collect()} == {"gl": (2, 1536, 768.0), "none": (0, 0, 0.0), "TOTAL": (2, 1536, 768.0)}
    shown = reports.size_table(r).split("\n")
    assert shown[0] == "Downloaded library size" and shown[-1].split() == ["TOTAL", "2", "1.5", "KB", "768", "B"]
    cat = spark.createDataFrame([("gl", "ok"), ("gl", "not_found"), ("gl", None)], "category string, fetch_status string")
    meta = spark.createDataFrame([("gl", "f"), ("gl", None)], "category string, file string")
    assert tuple(reports.catalogue_report(cats, cat, meta).where("category = 'gl'").first()) == ("gl", 0, 3, 2, 1, 2, 1)
    bad = spark.createDataFrame([("gl", "[页面获取失败: a] [页面获取失败: b]"), ("gl", "fine")], "category string, text string")
    assert {x.category: (x.novels, x.failed_pages) for x in reports.incomplete_report(cats, bad).collect()} == {"gl": (1, 2), "none": (0, 0), "TOTAL": (1, 2)}
    ramp = lambda *rows: reports.recommended_delay(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "step int, delay double, clean boolean")).first().delay
    assert ramp((3.0, True), (1.5, True), (0.2, False), (0.1, True)) == 3.0 and ramp((2.0, True), (0.5, True), (0.2, False)) == 2.0
    assert ramp((2.0, True), (0.1, True)) == 1.0 and ramp((3.0, True), (2.5, True)) == 2.5 and ramp((1.0, False), (0.5, True)) == 5.0 and ramp() == 5.0
    asked = [(1, i, v, 1.0) for i, v in enumerate(["ok", "error", "ok"])] + [(2, i, v, float(i)) for i, v in enumerate(["ok", "not_found", "challenged", "ok", "rate_limited"])] + [(3, 0, "not_found", 1.0)]
    bursts = {r.burst: (r.n, r.ok, r.challenged, r.rate_limited, r.error, r.mean_latency, r.aborted, r.clean) for r in reports.burst_stats(spark.createDataFrame(asked, "burst int, seq int, verdict string, latency double")).collect()}
    assert bursts == {1: (3, 2, 0, 0, 1, 1.0, False, False), 2: (3, 1, 1, 0, 0, 1.0, True, False), 3: (1, 0, 0, 0, 0, 1.0, False, True)}


def test_pages_are_counted_without_their_texts(spark):
    # the plan has one Python step, which gives two numbers a page; they equal the counts of the texts
    spaces = "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    page = "<html><article><p>a {0} b\U00020000</p>c{0}d<br>e<script>x</script><p>传送门：x</p></article></html>"
    found = ["&#13;", " ", spaces, "\u200b\u180e", "\x00\x85"]
    rows = [(i, page.format(x)) for i, x in enumerate(found)] + [(90, None), (91, ""), (92, "<p>no article</p>"), (93, "<article><p>z" * 300)]
    df = spark.createDataFrame(rows * 60, "page_id int, html string").coalesce(1)  # more than HELD rows in a batch
    read = df.select("page_id", html.page_chars_udf(any_page=True)("html").alias("c")).select("page_id", "c.*")
    texts = df.select("page_id", scalars.nonspace_chars(html.page_text_udf(any_page=True)("html")["text"]).cast("long"), scalars.nonspace_chars(html.old_text_udf(any_page=True)("html")).cast("long"))
    got = [tuple(r) for r in read.collect()]
    assert got == [tuple(r) for r in texts.collect()] and len(got) == 540 and (90, 0, 0) in got and (0, 6, 3) in got
    for name in ("loss_audit", "page_losses"):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("EvalPython") == 1 and "new_chars" in plan and "has_br" not in plan


# --- reader state ---

LOG = "user string, url string, seq int, position int, line int, anchor_version int, force boolean, title string, total int, updated string"


def marks(spark, *events):
    rows = [("u", "b", i, e[0], e[1], e[2] if len(e) > 2 else None, e[3] if len(e) > 3 else None, None, None, str(i)) for i, e in enumerate(events)]
    batch = user.bookmarks(spark.createDataFrame(rows, LOG)).first()
    state = None
    for r in spark.createDataFrame(rows, LOG).collect():
        state = streams.fold_mark(state, r)
    assert state[:3] == (batch.position, batch.line, batch.anchor_version)
    return batch.position, batch.line, batch.anchor_version


def test_bookmarks(spark):
    assert marks(spark, (5, None), (2, None)) == (5, None, None)
    assert marks(spark, (3, 18), (3, 7)) == (3, 18, 2) and marks(spark, (3, 18), (3, 7, 2, True)) == (3, 7, 2)
    assert marks(spark, (3, 80, 1), (3, 40, 2)) == (3, 40, 2) and marks(spark, (0, None), (0, 0)) == (0, 0, 2)
    assert marks(spark, (-4, -2)) == (0, 0, 2) and marks(spark, (2, 9), (1, None, 2, True)) == (1, None, None)
    log = spark.createDataFrame([("u", "b", 1, 5), ("u", "b", 2, -3), ("u", "c", 1, 5), ("u", "c", 2, None)], "user string, url string, seq int, position int")
    assert [tuple(r) for r in user.cli_bookmarks(log).collect()] == [("u", "b", 0)]
    m = spark.createDataFrame([("a", 9, 3, 5), ("b", 2, 3, 5), ("c", 9, 1, None)], "url string, position int, line int, total int")
    assert {r.url: (r.position, r.line) for r in user.clamp_progress(m).collect()} == {"a": (4, None), "b": (2, 3), "c": (9, 1)}


def test_bookmarks_of_a_hot_key_are_a_sequential_fold(spark):
    # one reader's events lie in all ranges; forced ones, anchors and lines without number among them
    rng = random.Random(8)
    rows, held = [], {}
    for i in range(6000):
        key = ("u", "hot") if rng.random() < 0.7 else (f"u{rng.randrange(20)}", "b")
        rows.append((*key, i, rng.randrange(-1, 4), rng.choice([None, *range(-1, 9)]), rng.choice([None, 1, 2, 3, 4]), rng.choice([True] + [None, False] * 400), rng.choice([None, "t", f"t{i}"]), rng.choice([None, i]), rng.choice([None, str(i)])))
    log = spark.createDataFrame(rows, LOG).repartition(5)
    for r in sorted(log.collect(), key=lambda r: r.seq):
        held[r.user, r.url] = streams.fold_mark(held.get((r.user, r.url)), r)
    assert {(r.user, r.url): tuple(r)[2:] for r in user.bookmarks(log).collect()} == {k: v[:6] for k, v in held.items()}


def test_bookmark_stream_folds_batches_natively_and_goes_on(spark, tmp_path, monkeypatch):
    # later batches hold earlier seqs, forced events, anchors, empty titles and keys without a name
    rng = random.Random(11)
    schema = "user string, url string, position int, line int, anchor_version int, force boolean, title string, total int, updated string, seq long"
    files, held = [], {}
    for f in range(4):
        seqs = rng.sample(range(2000), 150)
        files.append([(rng.choice([None, f"u{rng.randrange(12 + f * 5)}"]), rng.choice(["a", "b", None]), rng.randrange(-1, 5), rng.choice([None, *range(-1, 6)]), rng.choice([None, 1, 2, 3]), rng.choice([True] + [None, False] * 6), rng.choice([None, "", f"t{i}"]), rng.choice([None, 0, i]), rng.choice([None, str(i)]), i) for i in seqs])
        for r in sorted(spark.createDataFrame(files[f], schema).collect(), key=lambda r: r.seq):
            held[r.user, r.url] = streams.fold_mark(held.get((r.user, r.url)), r)
    want = {(*k, *v) for k, v in held.items()}

    def boom(*_):
        raise AssertionError("an event was folded on its own")

    monkeypatch.setattr(streams, "fold_mark", boom)
    for new in (files[:2], files[2:], []):  # the last start finds nothing new
        for part in new:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = {tuple(r) for r in streams.bookmark_stream(live, str(tmp_path / "marks"), 3).collect()}
    assert got == want and len({m[2:5] for m in want}) > 10


def test_shelf_and_settings(spark):
    ops = [("u", "x", "add", "1"), ("u", "x", "add", "2"), ("u", "y", "add", "3"), ("u", "y", "remove", None), ("u", "y", "remove", None), ("u", "z", "remove", None), ("u", "z", "add", "4"), ("v", "x", "remove", None)]
    log = spark.createDataFrame([(a, b, c, d, "t", "novel", i) for i, (a, b, c, d) in enumerate(ops)], "user string, id string, op string, url string, title string, kind string, seq int")
    s = user.shelf_state(log)
    assert {(r.user, r.id): (r.on_shelf, r.removed, r.url) for r in s.collect()} == {("u", "x"): (True, False, "1"), ("u", "y"): (False, True, None), ("u", "z"): (True, False, "4"), ("v", "x"): (False, True, None)}
    read = spark.createDataFrame([("u", "x"), ("u", "y"), ("u", "w")], "user string, id string")
    assert {(r.id, r.origin) for r in user.shelf(s.where("on_shelf"), read, s.where("removed")).collect()} == {("x", "shelf"), ("z", "shelf"), ("w", "progress")}
    old = spark.createDataFrame([("u", {"theme": "a"}, {"theme": "m"})], "user string, desktop map<string,string>, mobile map<string,string>")
    put = spark.createDataFrame([("u", "desktop", {"theme": "b", "odd": "x"}, 1), ("w", None, {"pinyin": "1"}, 2)], "user string, profile string, values map<string,string>, seq int")
    assert {r.user: (r.desktop, r.mobile) for r in user.merge_settings(old, put).collect()} == {"u": ({"theme": "b"}, {"theme": "m"}), "w": ({"pinyin": "1"}, {})}


class Crash(Exception):
    pass


def test_a_maintained_store_goes_on_where_it_was_stopped(spark, tmp_path):
    rng = random.Random(4)
    schema, files = "url string, category string, source string, content_hash string, seq long", 6
    rows = [[(f"u{rng.randrange(40)}", rng.choice(["meta", "full"]), rng.choice("abc"), f * 100 + k) for k in range(60)] for f in range(files)]
    rows = [[(u, f"c{int(u[1:]) % 4}" if int(u[1:]) % 4 else "", s, h, k) for u, s, h, k in part if f != 3 or int(u[1:]) % 4 == 1] for f, part in enumerate(rows)]

    def add(path, which):
        for f in which:
            spark.createDataFrame(rows[f], schema).coalesce(1).write.mode("append").parquet(str(path))

    def start(source, target, after_batch=None):
        live = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        out = maintain.maintain(live, str(target), F.col("category"), after_batch=after_batch)
        return sorted(tuple(r) for r in out.collect()), sorted(tuple(r) for r in maintain.changes(spark, str(target)).collect())

    add(tmp_path / "a", range(files))
    whole = start(tmp_path / "a", tmp_path / "whole")
    all_rows = spark.createDataFrame([r for part in rows for r in part], schema)
    after, changed = store.upsert(all_rows.drop("seq").limit(0), all_rows)
    assert whole == (sorted((r.url, r.category, r.source, r.content_hash, f"p-{r.category}") for r in after.collect()), sorted(tuple(r) for r in changed.collect()))

    def crash(batch):
        if batch == 2:
            raise Crash  # its rows are written, the stream has not noted it

    add(tmp_path / "b", range(4))
    with pytest.raises(Exception, match="Crash"):
        start(tmp_path / "b", tmp_path / "cut", crash)
    # half of a write that was cut off: data without a commit, and a commit that is done again
    spark.createDataFrame([("zz", "c1", "full", "x", "p-c1")], "url string, category string, source string, content_hash string, part string").write.partitionBy("part").parquet(str(tmp_path / "cut/data/batch=7"))
    add(tmp_path / "b", range(4, files))
    assert start(tmp_path / "b", tmp_path / "cut") == whole
    assert start(tmp_path / "b", tmp_path / "cut") == whole  # nothing new
    batches = lambda p: {(r.part, r.batch) for r in maintain.commits(spark, str(tmp_path / p)).collect()}
    assert batches("cut") == batches("whole") and {p for p, b in batches("cut") if b == 3} == {"p-c1"}
    gone = maintain.remove_old(spark, str(tmp_path / "cut"))
    assert 0 in gone and start(tmp_path / "b", tmp_path / "cut")[0] == whole[0]


def test_streams_go_on_from_a_named_folder(spark, tmp_path):
    schema = "path string, bytes long, modified string, poll long"
    scans = [[("a", 1, "t", 0), ("b", 5, "t", 0)], [("a", 1, "t", 1), ("b", 6, "t", 1)], [("a", 1, "t", 2), ("b", 6, "t", 2)]]
    got = []
    for part in scans:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(str(tmp_path / "in"))
        got.append({(r.path, r.poll, r.batch) for r in streams.run_to_files(streams.stable_files(live), "update", str(tmp_path / "at")).collect()})
    assert got == [set(), {("a", 1, 1)}, {("a", 1, 1), ("b", 2, 2)}]


def test_streams(spark, tmp_path):
    scans = [("a", 1, "t", 0), ("a", 2, "t", 1), ("a", 2, "t", 2), ("a", 2, "t", 3), ("b", 5, "t", 1), ("b", 5, "t", 3), ("b", 5, "t", 4), ("a", 2, "t", 6), ("a", 2, "t", 7)]
    df = spark.createDataFrame(scans, "path string, bytes long, modified string, poll long")
    want = {("a", 2), ("a", 7), ("b", 4)}
    assert {(r.path, r.poll) for r in streams.stable_files_batch(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "scans"))
    live = spark.readStream.schema(df.schema).parquet(str(tmp_path / "scans"))
    assert {(r.path, r.poll) for r in streams.run_to_files(streams.stable_files(live), "update").collect()} == want
    lines = spark.createDataFrame([("j", "2024-01-01 00:00:01", "[ 1/3] x"), ("j", "2024-01-01 00:00:02", "[ 3/3]"), ("k", "2024-01-01 00:00:02", "none")], "job string, ts string, line string")
    lines.write.parquet(str(tmp_path / "lines"))
    out = streams.run_to_files(streams.progress_lines(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "lines"))), "update").collect()
    assert [(r.job, r.done, r.total, r.expired) for r in out] == [("j", 3, 3, False)]


def test_entry_survives_without_llm(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "like_topk" in e.queries()
    assert e.entry(spark).count() == 10


def test_uploads_and_annotation(spark):
    from lorebase.operators import uploads

    files = spark.createDataFrame([(1, "《测试书》 - 某作者 (完结).txt", bytearray("序\n第1章 a\nx\n第2章 b\ny".encode("gb18030"))), (2, "Dup.txt", bytearray(b"One two\n\nthree")), (3, "Dup.md", bytearray(b""))], "upload int, filename string, content binary")
    d = uploads.detect(files)
    got = {r.upload: (r.title, r.author, r.status, r.language, r.chapter_count, r.synopsis) for r in d.collect()}
    assert got == {1: ("测试书", "某作者", "完结", "zh", 3, "序"), 2: ("Dup", "", "", "en", 1, "One two three"), 3: ("Dup", "", "", "zh", 0, "")}
    saved = uploads.to_records(d, spark.createDataFrame([], "stem string"))
    assert sorted(r.file for r in saved.collect())[:2] == ["uploads/Dup.txt", "uploads/Dup_2.txt"]
    f = text.annotate(lambda line: line.split(" "), lambda w: w.upper() + "!")
    assert [(x.text, x.reading) for x in one(spark, f(F.lit("语 a\nb")))] == [("语", "语!"), ("a", None), ("\n", None), ("b", None)]
