"""Saved page collections, as two flat tables and in their nested form.

The flat form is the one to use at scale: ``collections(id, name, description)``
and ``saved(collection_id, position, page_id, url, title, snippet)``. A nested
collection keeps its pages in an array, which must fit in one row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrawl.functions.text import contains_text
from pagetrawl.plans.skew import salted_join


def flatten(collections: DataFrame) -> DataFrame:
    """Nested collections as rows ``collection_id, position, page_id, url, title, snippet``."""
    return collections.select(
        F.col("id").alias("collection_id"), F.posexplode("pages").alias("position", "page"),
    ).select(
        "collection_id", "position", F.col("page.id").alias("page_id"),
        "page.url", "page.title", "page.snippet")


def _page_matches(q: str) -> Column:
    return contains_text("title", q) | contains_text("snippet", q) | contains_text("url", q)


def _name_matches(q: str) -> Column:
    return contains_text("name", q) | contains_text("description", q)


def filter_collections(collections: DataFrame, saved: DataFrame, q: str) -> DataFrame:
    """Saved pages of the collections that match ``q``, with the collection's name.

    A collection stays if its name, description or any page matches. Its pages
    are reduced to the matching ones if there are any. A blank ``q`` keeps all.
    """
    q = q.strip()
    flagged = saved.withColumn("_m", _page_matches(q) if q else F.lit(True))
    any_match = flagged.groupBy("collection_id").agg(F.max("_m").alias("_any"))
    kept = (
        collections.join(any_match.withColumnRenamed("collection_id", "id"), "id", "left")
        .filter(F.coalesce("_any", F.lit(False)) | (_name_matches(q) if q else F.lit(True)))
        .select(F.col("id").alias("collection_id"), "name", "_any")
    )
    joined = salted_join(flagged, kept, "collection_id", salt_by="page_id")
    return joined.filter(F.col("_m") | ~F.col("_any")).drop("_m", "_any")


def filter_collections_nested(collections: DataFrame, q: str) -> DataFrame:
    """:func:`filter_collections` for nested collections."""
    q = q.strip()
    if not q:
        return collections

    def matches(p: Column) -> Column:
        return contains_text(p.title, q) | contains_text(p.snippet, q) | contains_text(p.url, q)

    hits = F.filter("pages", matches)
    kept = collections.filter((F.size(hits) > 0) | _name_matches(q))
    return kept.withColumn("pages", F.when(F.size(hits) > 0, hits).otherwise(F.col("pages")))


def add_pages(saved: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages to append: those whose URL the collection does not hold yet.

    Of several new pages with one URL in a collection the first by id is kept.
    """
    wanted = pages.groupBy("collection_id", "url").agg(
        F.min(F.struct("page_id", "title", "snippet")).alias("_p"))
    fresh = wanted.join(saved.select("collection_id", "url"), ["collection_id", "url"], "left_anti")
    return fresh.select("collection_id", "_p.page_id", "url", "_p.title", "_p.snippet")


def add_page_nested(collections: DataFrame, collection_id: str, page: Column) -> DataFrame:
    """Nested form of :func:`add_pages` for one page given as a struct column."""
    present = F.exists("pages", lambda p: p.url == page.url)
    grown = F.when((F.col("id") == collection_id) & ~present, F.array_append("pages", page))
    return collections.withColumn("pages", F.coalesce(grown, F.col("pages")))


def add_collections(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The collections to append: named, and with a name not in use in any case."""
    named = incoming.withColumn("name", F.trim("name")).filter("name <> ''").withColumn(
        "description", F.trim(F.coalesce("description", F.lit(""))))
    key = F.lower("name")
    first = named.groupBy(key.alias("_key")).agg(F.min(F.struct("id", "name", "description")).alias("_c"))
    used = current.select(F.lower("name").alias("_key")).distinct()
    return first.join(used, "_key", "left_anti").select("_c.id", "_c.name", "_c.description")


def remove_collections(collections: DataFrame, ids: DataFrame) -> DataFrame:
    """Collections without those listed in ``id``."""
    return collections.join(ids.select("id").distinct(), "id", "left_anti")


def remove_pages(saved: DataFrame, removed: DataFrame) -> DataFrame:
    """Saved pages without the listed pairs ``collection_id, page_id``."""
    keys = ["collection_id", "page_id"]
    return saved.join(removed.select(*keys).distinct(), keys, "left_anti")


def remove_page_nested(collections: DataFrame, collection_id: str, page_id: str) -> DataFrame:
    """Nested form of :func:`remove_pages` for one page."""
    shrunk = F.when(F.col("id") == collection_id, F.filter("pages", lambda p: p.id != page_id))
    return collections.withColumn("pages", F.coalesce(shrunk, F.col("pages")))


def saved_in(pages: DataFrame, saved: DataFrame) -> DataFrame:
    """Pages with a flag ``saved`` that tells whether any collection holds their URL."""
    urls = saved.select("url", F.lit(True).alias("saved")).distinct()
    return pages.join(urls, "url", "left").withColumn("saved", F.coalesce("saved", F.lit(False)))


def saved_pairs(pages: DataFrame, saved: DataFrame) -> DataFrame:
    """``id, collection_id`` of every page in every collection that holds its URL."""
    held = saved.select("collection_id", "url").distinct()
    return salted_join(held, pages.select("id", "url"), "url", salt_by="collection_id").select(
        "id", "collection_id")


def collection_total(saved: DataFrame) -> DataFrame:
    """One row ``pages``: saved pages over all collections."""
    return saved.agg(F.count(F.lit(1)).alias("pages"))


def collection_total_nested(collections: DataFrame) -> DataFrame:
    """:func:`collection_total` for nested collections."""
    return collections.agg(F.coalesce(F.sum(F.size("pages")), F.lit(0)).alias("pages"))
