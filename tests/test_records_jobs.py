"""History, runs, times, colours, collections, ingest and streams."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from pagetrawl.functions import colour as C
from pagetrawl.functions import times as M
from pagetrawl.functions.text import falsy
from pagetrawl.operators import collections as L
from pagetrawl.operators import history as H
from pagetrawl.operators.extract import extract_pages, page_links
from pagetrawl.operators.index import read_appended_index
from pagetrawl.operators.search import rank
from pagetrawl.plans import skew
from pagetrawl.plans.ingest import ingest_batch, stored_images, stored_links, stored_pages
from pagetrawl.plans.lineage import new_folder
from pagetrawl.schemas import HASH_COLOURS, HISTORY, RAW_PAGES, RUN_LOG
from pagetrawl.sources.tables import read_batches, stream_raw, stream_table
from pagetrawl.streaming.jobs import history_stream, ingest_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(params=["cold", "hot"])
def heat(request, monkeypatch):
    if request.param == "hot":
        monkeypatch.setattr(skew.hot_of, "__defaults__", (1,))
        monkeypatch.setattr(skew.hot_keys, "__defaults__", (1,))


# --- History and runs ----------------------------------------------------------------------


@pytest.fixture
def history(spark):
    data = [(f"{i:02}", "s", f"q{i % 12}", float(i)) for i in range(25)] + [("x", "t", "q", None)]
    return spark.createDataFrame(data, HISTORY)


def test_recent_history(history):
    got = H.recent_history(history)
    assert [r.query for r in got.filter("session_id = 's'").orderBy("rank").collect()] == [f"q{i % 12}" for i in range(24, 4, -1)]
    assert got.filter("session_id = 't'").first().timestamp == 0.0


def test_mru_queries(history):
    got = H.mru_queries(history).filter("session_id = 's'").orderBy("rank")
    assert [r.query for r in got.collect()] == [f"q{i}" for i in range(11, 1, -1)]


def test_clear_history(spark, heat, history):
    sessions = spark.createDataFrame([("s",), ("s",), ("u",)], "session_id string")
    assert rows(H.clear_history(history, sessions).select("id")) == [("x",)]
    assert rows(H.cleared_counts(history, sessions)) == [("s", 25), ("u", 0)]


def test_append_history(spark, history):
    path = new_folder(spark, "history")
    for batch in (0, 1, 1):
        H.append_history(history.drop("id"), path, batch)
    stored = read_batches(spark, HISTORY, path)
    assert stored.count() == 52 == stored.select("id").distinct().count()
    assert H.history_rows(spark.createDataFrame([("s", "q")], "session_id string, query string")).first().timestamp > 1.7e9


def test_runs(spark):
    batch = spark.createDataFrame([("u",), ("",), (None,)], "url string")
    run = H.run_row(batch, "http://s/", "test", 0.0).first()
    assert (run.pages_crawled, run.errors, run.time_str, run.status) == (1, 2, "1970-01-01 00:00:00", "completed")
    path = new_folder(spark, "runs")
    for now in range(20):
        H.append_run_log(batch, path, now, "s", "t", now)
    for _ in range(2):
        H.append_run_log(batch, path, 20, "s", "t", 99)
    recent = H.recent_runs(read_batches(spark, RUN_LOG, path))
    assert [r.timestamp for r in recent.collect()] == [99.0, *map(float, range(19, 5, -1))]
    empty = spark.createDataFrame([("i",) + (None,) * 7], RUN_LOG)
    assert rows(H.project_runs(empty)) == [("i", "N/A", "unknown", 0, 0, "unknown", 0.0, "")]


# --- Times, colours, defaults ---------------------------------------------------------------


def test_times_are_utc_in_any_session(spark):
    epochs = [0.0, 1780710480.5, 1709164800.0, 951782400.0]
    df = spark.createDataFrame([(e,) for e in epochs], "e double").select("e", M.asctime("e").alias("a"), M.calendar_text("e").alias("c"))
    for e, a, c in df.collect():
        assert a == time.asctime(time.gmtime(e)) and c == time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(e))
    back = df.select("e", M.parse_time("a"), M.parse_time("c"))
    assert all(x == y == e // 1 for e, x, y in back.collect())
    texts = ["Tue Jun  6 01:48:00 2026", "2026-06-06", " 2026-06-06 01:02:03 ", "junk", "", None, "32 Foo"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(M.parse_time("t"))
    assert [r[0] for r in got.collect()] == [1780710480.0, 1780704000.0, 1780707723.0, None, None, None, None]


def test_next_run(spark):
    df = spark.createDataFrame([(True, "daily"), (True, "weekly"), (False, "daily")], "e boolean, i string")
    got = df.select(M.next_run("e", "i", F.lit(0.0)))
    assert [r[0] for r in got.collect()] == ["1970-01-02 00:00:00", "1970-01-08 00:00:00", "N/A"]
    blank = spark.createDataFrame([(None, None, "", None, 0.0)], "enabled boolean, interval string, start_url string, last_run string, updated_at double")
    assert rows(H.schedule_rows(blank)) == [(False, "daily", "https://news.ycombinator.com", "N/A", 0.0, "N/A")]


def test_colours(spark):
    names = [("scattered", "red"), ("video of a carrot", "orange"), ("a video", "black"), ("Cherry red", "pink")]
    df = spark.createDataFrame(names, "t string, c string")
    assert all(r[0] == r[1] for r in df.select("c", C.dominant_colour("t", F.lit(None), F.lit(""))).collect())
    urls = [f"http://i/{i}" for i in range(50)]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(C.dominant_colour(F.lit(""), F.lit(""), "u"), C.colour_bucket("u"))
    for u, (name, bucket) in zip(urls, got.collect()):
        assert bucket == int(hashlib.md5(u.encode()).hexdigest(), 16) % 11 and name == HASH_COLOURS[bucket]


def test_topics_and_defaults(spark):
    df = spark.createDataFrame([("A FLOWER cat",), ("galaxy",), ("",)], "q string")
    assert [r[0] for r in df.select(C.query_topic("q")).collect()] == ["flower", "nature", "nature"]
    assert [r[0] for r in df.select(C.query_topic("q", wide=True)).collect()] == ["flower", "space", "nature"]
    chain = spark.createDataFrame([(None, "b"), ("", ""), ("a", "b")], "a string, b string")
    assert [r[0] for r in chain.select(falsy("a", F.col("b"), "end")).collect()] == ["b", "end", "a"]
    casts = spark.createDataFrame([("7",), ("x",), (None,)], "v string").select(M.to_number("v"), M.to_number("v", "bigint"))
    assert [tuple(r) for r in casts.collect()] == [(7.0, 7), (None, None), (None, None)]


# --- Collections ----------------------------------------------------------------------------


@pytest.fixture
def nested(spark):
    page = "array<struct<id string, url string, title string, snippet string>>".replace(" string", ":string")
    data = [("c1", "Web", None, [("p1", "u1", "Fox", ""), ("p2", "u2", "Dog", "den")]),
            ("c2", "fox news", "d", [("p3", "u3", "Cat", "")]), ("c3", "none", "", [])]
    return spark.createDataFrame(data, f"id string, name string, description string, pages {page}")


@pytest.mark.parametrize("q, kept", [
    (" FOX ", [("c1", "p1"), ("c2", "p3")]), ("", [("c1", "p1"), ("c1", "p2"), ("c2", "p3")]),
    ("web", [("c1", "p1"), ("c1", "p2")]), ("zzz", []), ("den", [("c1", "p2")])])
def test_filter_collections(heat, nested, q, kept):
    flat = L.flatten(nested)
    assert rows(L.filter_collections(nested, flat, q).select("collection_id", "page_id")) == kept
    assert rows(L.flatten(L.filter_collections_nested(nested, q)).select("collection_id", "page_id")) == kept
    assert rows(L.collection_total(L.filter_collections(nested, flat, q))) == [(len(kept),)]
    assert rows(L.collection_total_nested(L.filter_collections_nested(nested, q))) == [(len(kept),)]


def test_change_collections(spark, heat, nested):
    flat = L.flatten(nested)
    more = spark.createDataFrame([("c1", "p9", "u1", "", ""), ("c3", "p8", "u8", "", ""), ("c3", "p7", "u8", "", "")],
                                 "collection_id string, page_id string, url string, title string, snippet string")
    assert rows(L.add_pages(flat, more).select("collection_id", "page_id")) == [("c3", "p7")]
    known = F.struct(F.lit("p9").alias("id"), F.lit("u1").alias("url"), F.lit("").alias("title"), F.lit("").alias("snippet"))
    assert rows(L.collection_total_nested(L.add_page_nested(nested, "c1", known))) == [(3,)]
    assert rows(L.collection_total_nested(L.add_page_nested(nested, "c2", known))) == [(4,)]
    assert rows(L.collection_total_nested(L.remove_page_nested(nested, "c1", "p1"))) == [(2,)]
    gone = spark.createDataFrame([("c1", "p1"), ("c2", "p1")], "collection_id string, page_id string")
    assert rows(L.remove_pages(flat, gone).select("page_id")) == [("p2",), ("p3",)]
    ids = spark.createDataFrame([("c1",)], "id string")
    assert rows(L.remove_collections(nested, ids).select("id")) == [("c2",), ("c3",)]
    named = spark.createDataFrame([("n1", " WEB ", ""), ("n2", " ", ""), ("n3", " New ", None), ("n4", "new", "")],
                                  "id string, name string, description string")
    assert rows(L.add_collections(nested, named)) == [("n3", "New", "")]
    pages = spark.createDataFrame([("i1", "u1"), ("i9", "u9")], "id string, url string")
    assert rows(L.saved_in(pages, flat).select("id", "saved")) == [("i1", True), ("i9", False)]
    assert rows(L.saved_pairs(pages, flat)) == [("i1", "c1")]


# --- Ingest and streams ----------------------------------------------------------------------


def tables(spark, root):
    return [
        rows(stored_pages(spark, root).select("url", "title", "content", "snippet", "backlinks")),
        rows(stored_links(spark, root).select("id", "source_url", "target_url")),
        rows(stored_images(spark, root).select("id", "url", "dominant_color")),
        rows(read_batches(spark, RUN_LOG, f"{root}/runs").select("pages_crawled", "errors")),
        rows(rank(read_appended_index(spark, f"{root}/index"), ["th"], None)),
    ]


def test_ingest_is_repeatable(spark, sf):
    raw = spark.read.schema(RAW_PAGES).parquet(f"{sf}/pages.parquet")
    root = new_folder(spark, "ingest")
    ingest_batch(raw.filter("url like 'https:%'"), root, 0)
    ingest_batch(raw.unionByName(raw), root, 1)
    once = tables(spark, root)
    ingest_batch(raw.unionByName(raw), root, 1)
    assert tables(spark, root) == once
    assert len(once[0]) == raw.count() and once[3][0] == (100, 0)
    links = page_links(extract_pages(raw)).filter("source_url <> target_url")
    assert len(once[1]) == links.select("source_url", "target_url").distinct().count()


def test_known_pages_are_skipped_or_refreshed(spark):
    def raw(title, link):
        html = f"<title>{title}</title><body>x<a href='{link}'><img src='{link}.png'>"
        return spark.createDataFrame([(1, "http://h/", html), (2, "", "x"), (3, None, "x")], RAW_PAGES)

    root = new_folder(spark, "ingest")
    ingest_batch(raw("old", "/a"), root, 0, index=False, now=1.0)
    ingest_batch(raw("new", "/b"), root, 1, index=False, now=2.0)
    assert rows(stored_pages(spark, root).select("title", "indexed_time")) == [("old", 1.0)]
    assert rows(stored_links(spark, root).select("target_url")) == [("http://h/a",)]
    ingest_batch(raw("new", "/b"), root, 2, index=False, now=3.0, refresh=True)
    assert rows(stored_pages(spark, root).select("title", "indexed_time")) == [("new", 3.0)]
    assert rows(stored_links(spark, root).select("target_url")) == [("http://h/a",), ("http://h/b",)]
    assert stored_images(spark, root).count() == 2
    indexed = new_folder(spark, "ingest")
    ingest_batch(raw("old words", "/a"), indexed, 0, now=1.0)
    ingest_batch(raw("new words", "/b"), indexed, 1, now=2.0, refresh=True)
    index = read_appended_index(spark, f"{indexed}/index")
    assert [rank(index, [t], field="title").count() for t in ("old", "new", "words")] == [0, 1, 1]
    ingest_batch(spark.createDataFrame([(4, "http://h/b", "")], RAW_PAGES), root, 3, index=False)
    assert rows(stored_pages(spark, root).filter("url like '%b'").select("backlinks", "title")) == [(1, "http://h/b")]


def test_stream_is_batch(spark, sf):
    raw = spark.read.schema(RAW_PAGES).parquet(f"{sf}/pages.parquet")
    arriving, root, whole = new_folder(spark, "arriving"), new_folder(spark, "stream"), new_folder(spark, "batch")
    raw.repartition(3).write.parquet(arriving)
    stream = stream_raw(spark, arriving, files=1)
    ingest_stream(stream, root, f"{root}/checkpoint").awaitTermination()
    ingest_batch(raw, whole, 0)
    streamed, batch = tables(spark, root), tables(spark, whole)
    assert streamed[:3] == batch[:3] and [i for i, _ in streamed[4]] == [i for i, _ in batch[4]]
    assert sum(r[0] for r in streamed[3]) == raw.count() and len(streamed[3]) == 3
    ingest_stream(stream, root, f"{root}/checkpoint").awaitTermination()
    assert tables(spark, root) == streamed
    ingest_stream(stream, root, f"{root}/another-checkpoint").awaitTermination()
    assert tables(spark, root)[:3] == streamed[:3]


def test_history_stream(spark, history):
    arriving, path = new_folder(spark, "arriving"), new_folder(spark, "history")
    history.drop("id").repartition(2).write.parquet(arriving)
    stream = stream_table(spark, history.drop("id").schema, arriving)
    for _ in range(2):
        history_stream(stream, f"{path}/table", f"{path}/checkpoint").awaitTermination()
    stored = read_batches(spark, HISTORY, f"{path}/table")
    assert rows(stored.select("session_id", "query", "timestamp")) == rows(history.select("session_id", "query", "timestamp"))
    assert stored.select("id").distinct().count() == 26
