"""URLs that are stored in several versions, with other HTML."""

import duckdb
import pytest

import __spark_entry__ as contract
from pagetrawl.operators import extract as E
from test_at_size import repeated  # noqa: F401
from test_registered import tidy

QUERIES, SQL = contract.queries(), contract.oracle_sql()

#: Queries as their SQL, and the columns to compare where an order that the SQL leaves open decides another.
AS_SQL = {
    "page_links": ["source_url", "target_url"],
    "flatten_collections": ["collection_id", "page_id", "url"],
    "filter_collections_nested": None,
    "graph_stats": None,
    "likes": None,
    "top_liked": None,
    "field_terms": None,
    "match_field": None,
    "node_details": None,
    "page_detail_or": None,
    "pages_absent": None,
    "pages_keyed": None,
    "page_lookup": None,
    "stream_links": None,
}


@pytest.mark.parametrize("name", AS_SQL)
def test_versions_as_sql(spark, repeated, name):  # noqa: F811
    folder, con = repeated
    df, result = QUERIES[name](spark, folder), con.sql(SQL[name])
    columns = AS_SQL[name] or sorted(df.columns)
    assert sorted(df.columns) == sorted(result.columns)
    order = [result.columns.index(c) for c in columns]
    assert sorted(tuple(tidy(r[c]) for c in columns) for r in df.collect()) == sorted(
        tuple(tidy(r[i]) for i in order) for r in result.fetchall())


def test_links_of_a_url_are_those_of_all_versions(spark):
    """Places are counted among all hrefs of a version, also those that lead to no page."""
    a = "<a href='/p.png'></a><a href='/x'></a><a href='/y'></a><a href='/x'></a>"
    raw = spark.createDataFrame(
        [("http://h/1", a), ("http://h/1", "<a href='/y'></a><a href='/b'></a>"), ("http://h/2", "<a href='/x'></a>"),
         ("", "<a href='/x'></a>"), ("http://h/3", None)], "url string, html string")
    found = sorted((r.source_url, r.position, r.target_url) for r in E.url_links(raw).collect())
    assert found == [("http://h/1", 0, "http://h/y"), ("http://h/1", 1, "http://h/b"), ("http://h/1", 2, "http://h/x"),
                     ("http://h/2", 0, "http://h/x")]


def test_match_field_takes_each_version(spark, tmp_path):
    """A URL with the term in the titles of two versions is found twice, not left out."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT * FROM (VALUES (0, 'http://h/1', '<title>Th one</title>'), (1, 'http://h/1', '<title>th th</title>'),
        (2, 'http://h/1', '<title>two</title>'), (3, 'http://h/2', '<title>th</title>')) p(page_id, url, html))
        TO '{tmp_path}/pages.parquet' (FORMAT parquet)""")
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    found = sorted(r.id for r in QUERIES["match_field"](spark, str(tmp_path)).collect())
    assert len(found) == 3 and found == sorted(r[0] for r in con.sql(SQL["match_field"]).fetchall())
