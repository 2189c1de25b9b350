"""Links, seeds and insert-if-absent on small tables, also with every key treated as hot."""

import pytest
from pyspark.sql import functions as F

from pagetrawl.functions.urls import link_id, url_id
from pagetrawl.operators import graph as G
from pagetrawl.operators import seeds as S
from pagetrawl.operators import store as T
from pagetrawl.plans import skew


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(params=["cold", "hot"])
def heat(request, monkeypatch):
    """Runs a test as it is and with salting of every key."""
    if request.param == "hot":
        monkeypatch.setattr(skew.hot_of, "__defaults__", (1,))
        monkeypatch.setattr(skew.hot_keys, "__defaults__", (1,))
    return request.param


@pytest.fixture
def pages(spark):
    data = [("a", "u1", "One", 10.0), ("b", "u2", "", 20.0), ("c", "u3", "Three", 30.0), ("d", "u4", None, 40.0)]
    return spark.createDataFrame(data, "id string, url string, title string, indexed_time double")


@pytest.fixture
def links(spark):
    data = [("u1", "u2", 5.0), ("u3", "u2", 25.0), ("u1", "u3", 5.0), ("u2", "x", 5.0), ("x", "u1", 5.0), ("u4", "", 5.0)]
    return spark.createDataFrame(data, "source_url string, target_url string, created_at double")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, heat, how):
    facts = spark.range(500).select((F.col("id") % 7 % 3).cast("string").alias("k"), "id")
    facts = facts.unionByName(spark.createDataFrame([(None, 900), ("z", 901)], "k string, id long"))
    dim = spark.createDataFrame([("0", "zero"), ("2", "two"), ("9", "nine")], "k string, name string")
    assert rows(skew.salted_join(facts, dim, "k", how, "id")) == rows(facts.join(dim, "k", how))


def test_salting_spreads_and_is_bounded(spark, heat):
    facts = spark.range(2000).select(F.lit("hub").alias("k"), "id")
    assert rows(skew.hot_keys(facts, "k", 100)) == [("hub", 20)]
    assert rows(skew.hot_keys(facts, "k", 2000)) == []
    many = spark.range(6000).select((F.col("id") % 2000).cast("string").alias("k"))
    assert skew.hot_keys(many, "k", 2).count() == 2000
    assert {r[0] for r in skew.hot_keys(many, "k", 2).select("_salts").collect()} == {2}


def test_backlinks_and_nodes(heat, pages, links):
    assert rows(G.backlink_counts(links)) == [("u1", 1), ("u2", 2), ("u3", 1), ("x", 1)]
    nodes = {r.url: r for r in G.pages_with_backlinks(pages, links).collect()}
    assert [nodes[u].backlinks for u in ("u1", "u2", "u3", "u4")] == [1, 2, 1, 0]
    assert nodes["u2"].title == "u2" and nodes["u4"].title == "u4" and nodes["u2"].size == 9


def test_node_size_is_clamped(spark):
    df = spark.createDataFrame([(0,), (5,), (100,)], "b long")
    assert rows(df.select(G.node_size("b"))) == [(15,), (30,), (5,)]


def test_edges_and_stats(heat, pages, links):
    assert rows(G.resolve_edges(links, pages)) == [("a", "b"), ("a", "c"), ("c", "b")]
    assert rows(G.graph_stats(pages, links)) == [(4, 3, 1)]
    assert G.graph_stats(pages, links).first().total_links == G.resolve_edges(links, pages).count()


def test_unknown_target_keeps_count_of_unknown_sources(heat, pages, links):
    """u1 has a link from an unknown page: not an edge, but u1 is not isolated."""
    assert ("d",) in rows(G.pages_with_backlinks(pages, links).filter("backlinks = 0").select("id"))
    assert G.graph_stats(pages, links).first().isolated_pages == 1


def test_backlinks_as_of(heat, pages, links):
    assert rows(G.backlinks_as_of(pages, links)) == [("a", 1), ("b", 1), ("c", 1), ("d", 0)]


def test_frontier_and_reachable(spark, heat, pages, links):
    assert rows(G.frontier(links.filter("target_url <> ''"), pages)) == [("x",)]
    seeds = spark.createDataFrame([("u4",), ("x",)], "url string")
    assert rows(G.reachable(links.filter("target_url <> ''"), seeds, 2)) == [
        ("u1", 1), ("u2", 2), ("u3", 2), ("u4", 0), ("x", 0)]


def test_edge_match(heat, spark, pages):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("a", "gone")], "source string, target string")
    nodes = pages.withColumn("title", F.coalesce("title", F.lit("")))
    assert rows(G.edge_match(edges, nodes, " E ")) == [("a", "b", "one"), ("a", "c", "both"), ("b", "d", "none")]
    assert {r.match for r in G.edge_match(edges, nodes, " ").collect()} == {"idle"}
    assert G.graph_search(nodes, "  ").count() == 0 and G.graph_search(nodes, "ONE ").count() == 1


def test_add_backlinks(spark):
    links = spark.createDataFrame([("s", "s"), ("s", "t"), ("s", "t"), ("s", "v")], "source_url string, target_url string")
    known = spark.createDataFrame([("s", "v")], "s string, t string").select(link_id("s", "t").alias("id"))
    added = T.add_backlinks(known, links)
    assert [(r.source_url, r.target_url) for r in added.collect()] == [("s", "t")]
    assert T.add_backlinks(known.unionByName(added.select("id")), links).count() == 0


def page(url, title, time):
    return (url, title, "c", "s", "", time, 0)


def page_table(spark, data):
    df = spark.createDataFrame(data, "url string, title string, content string, snippet string, indexed_at string, "
                                     "indexed_time double, backlinks long")
    return df.select(url_id("url").alias("id"), "*")


def test_upsert_pages(spark):
    current = page_table(spark, [page("u1", "old", 1.0), page("u2", "kept", 1.0), page("u3", "newer", 9.0)])
    incoming = page_table(spark, [page("u1", "mid", 2.0), page("u1", None, 3.0), page("u3", "late", 5.0), page("u4", "n", 3.0)])
    after = T.upsert_pages(current, incoming)
    assert rows(after.select("url", "title", "status")) == [
        ("u1", None, "updated"), ("u2", "kept", "unchanged"), ("u3", "newer", "updated"), ("u4", "n", "indexed")]
    again = T.upsert_pages(after.drop("status"), incoming)
    assert rows(again.drop("status")) == rows(after.drop("status"))


def test_image_colour_is_inferred_when_absent(spark):
    images = spark.createDataFrame(
        [("u/1", "sky", "t", None), ("u/2", "sky", "t", ""), ("u/3", "sky", "scattered", "black")],
        "url string, alt_text string, title string, dominant_color string")
    images = images.withColumn("source_url", F.lit("s")).withColumn("indexed_at", F.lit(""))
    assert [r.dominant_color for r in T.prepare_images(images).orderBy("url").collect()] == ["blue", "blue", "black"]


def test_known_keys_and_page_detail(spark, pages):
    known = spark.createDataFrame([("a",), ("z",)], "id string")
    assert rows(T.known_keys(pages, known, "id")) == [(3, 1)]
    assert T.page_detail(pages, "zz").count() == 0
    assert rows(T.page_detail(pages, ["a", "c"]).select("id")) == [("a",), ("c",)]


def test_seeds(spark):
    urls = ["http://a.b:80/x", "https://a.b:80", "http://a_b_80/", "no", "http://c/"]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    domains = S.distinct_domains(pages)
    assert rows(domains) == [("a.b:80",), ("a_b_80",), ("c",)]
    none = S.empty_seeds(spark)
    assert rows(S.add_seeds(none, domains).select("id", "domain")) == [("a_b_80", "a.b:80"), ("c", "c")]
    assert rows(S.seed_summary(domains, none)) == [(2, 3, 1)]
    stored = S.add_seeds(none, domains)
    assert S.add_seeds(stored, domains).count() == 0
    assert rows(S.seed_summary(domains, stored)) == [(0, 3, 3)]
    assert S.default_seeds(none).count() == 3 and S.default_seeds(stored).count() == 0
    assert S.startup_seeds(none, pages).count() == 2
    assert rows(S.startup_summary(none, pages.filter("url = 'no'"))) == [(0, 3, 3)]
