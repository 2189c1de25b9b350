"""Upserts and insert-if-absent over append-only tables.

Tables are logs: a write appends rows and a read takes the latest row per key.
No path is read and overwritten in the same job.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrawl.functions.colour import dominant_colour
from pagetrawl.functions.text import falsy
from pagetrawl.functions.urls import url_id
from pagetrawl.operators.extract import as_link_rows
from pagetrawl.plans.skew import latest, salted_join


def page_detail(pages: DataFrame, ids) -> DataFrame:
    """Pages by id, given as one id, a list, or a table with an ``id`` column."""
    if isinstance(ids, DataFrame):
        return pages.join(ids.select("id").distinct(), "id", "left_semi")
    wanted = [ids] if isinstance(ids, str) else list(ids)
    return pages.filter(F.col("id").isin(wanted))


def page_detail_or(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """Details of hits, taken from the hit itself where the page is not stored."""
    stored = pages.select(
        "id", F.lit(True).alias("_found"),
        *(F.col(c).alias(f"_{c}") for c in ("url", "title", "snippet", "content", "backlinks", "indexed_at")))
    joined = hits.join(stored, "id", "left")
    found = F.coalesce(F.col("_found"), F.lit(False))

    def pick(name, fallback):
        return F.when(found, F.col(f"_{name}")).otherwise(fallback).alias(name)

    return joined.select(
        "id",
        pick("url", F.col("url")), pick("title", F.col("title")), pick("snippet", F.col("snippet")),
        pick("content", F.col("snippet")),
        pick("backlinks", F.coalesce(F.col("backlinks"), F.lit(0))),
        pick("indexed_at", F.col("indexed_at")),
    )


def _row_hash(df: DataFrame) -> Column:
    """A narrow sort key that orders rows which are equal in all else."""
    return F.xxhash64(*df.columns)


def latest_pages(log: DataFrame) -> DataFrame:
    """The current pages of an append log: the newest whole row per id."""
    return latest(log, "id", [F.desc("indexed_time"), _row_hash(log)])


def upsert_status(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """``id, status`` of incoming pages: ``updated`` if known before, else ``indexed``.

    Only keys are read from both sides.
    """
    known = current.select("id", F.lit(True).alias("_known")).distinct()
    return incoming.select("id").distinct().join(known, "id", "left").select(
        "id", F.when(F.col("_known"), F.lit("updated")).otherwise(F.lit("indexed")).alias("status"))


def upsert_pages(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pages after an upsert, with the status of each: the newest whole row wins.

    Every field is replaced, also by null. Pages that were not sent again are
    ``unchanged``; on equal times the incoming row wins.
    """
    columns = current.columns
    log = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    newest = latest(log, "id", [F.desc("indexed_time"), F.desc("_new"), _row_hash(log)]).drop("_new")
    status = upsert_status(current, incoming)
    return newest.join(status, "id", "left").select(
        *columns, F.coalesce("status", F.lit("unchanged")).alias("status"))


def prepare_images(images: DataFrame) -> DataFrame:
    """Image rows with their key and a colour; an empty colour is inferred."""
    return images.select(
        url_id("url").alias("id"), "url", "alt_text", "source_url", "title",
        falsy("dominant_color", dominant_colour("title", "alt_text", "url")).alias("dominant_color"),
        "indexed_at",
    )


def upsert_images(current: DataFrame, incoming: DataFrame, order: str = "indexed_time") -> DataFrame:
    """Images after a set-by-URL: the newest row per id in full."""
    log = current.withColumn("_new", F.lit(0)).unionByName(
        incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    ties = [F.desc("_new"), _row_hash(log)]
    first = [F.desc(order)] if order in log.columns else []
    return latest(log, "id", first + ties).drop("_new")


def new_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Crawled items whose URL is not stored yet."""
    keyed = items if "id" in items.columns else items.withColumn("id", url_id("url"))
    return keyed.join(pages.select("id"), "id", "left_anti")


def add_backlinks(current: DataFrame, links: DataFrame, created_at=None) -> DataFrame:
    """The links to append: keyed, without self links, repeats and known links."""
    created = F.lit(None).cast("double") if created_at is None else created_at
    rows = as_link_rows(links).dropDuplicates(["id"])
    return rows.join(current.select("id"), "id", "left_anti").withColumn("created_at", created)


def known_keys(incoming: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Counts of an insert-if-absent or delete: ``added, already_present``."""
    known = current.select(key, F.lit(True).alias("_known")).distinct()
    flagged = incoming.select(key).distinct().join(known, key, "left")
    present = F.count_if(F.col("_known"))
    return flagged.agg(
        (F.count(F.lit(1)) - present).alias("added"), present.alias("already_present"))


def without_keys(df: DataFrame, keys: DataFrame, key: str, salt_by: str) -> DataFrame:
    """Rows whose key is not listed, with hot keys of ``df`` spread out."""
    return salted_join(df, keys.select(key).distinct(), key, "left_anti", salt_by)
