"""Ingest of raw pages: extract once, drop what is known, append to all tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl.functions.times import asctime, epoch_now
from pagetrawl.functions.urls import url_id
from pagetrawl.operators.current import BUCKETS, current_rows, lookup, write_keyed
from pagetrawl.operators.extract import as_link_rows, extract_pages, page_images, page_links, require_url
from pagetrawl.operators.graph import backlink_counts
from pagetrawl.operators.history import run_row
from pagetrawl.operators.index import append_index, fold_index_statistics
from pagetrawl.operators.known import absent, fold_keys, write_keys
from pagetrawl.operators.store import prepare_images
from pagetrawl.plans.deltas import Counts
from pagetrawl.plans.skew import latest
from pagetrawl.schemas import BACKLINKS, IMAGES, LINK_COUNTS, PAGES, RUN_LOG
from pagetrawl.sources.tables import read_batches, write_batch


def stored_pages(spark: SparkSession, root: str) -> DataFrame:
    """The current pages below ``root``: the newest row of each, read where it is stored."""
    return current_rows(spark, f"{root}/pages", PAGES)


def stored_page_detail(spark: SparkSession, root: str, ids: list[str]) -> DataFrame:
    """Some of the current pages below ``root`` by id; only their buckets are read."""
    return lookup(spark, f"{root}/pages", PAGES, ids)


def link_counts(root: str) -> Counts:
    """``target_url, backlinks`` of the links below ``root``, kept by batch."""
    return Counts(f"{root}/link_counts", LINK_COUNTS, ["target_url"])


def stored_links(spark: SparkSession, root: str) -> DataFrame:
    """All links below ``root``."""
    return read_batches(spark, BACKLINKS, f"{root}/backlinks")


def stored_images(spark: SparkSession, root: str) -> DataFrame:
    """The images below ``root``: the row of the last batch for each."""
    log = read_batches(spark, IMAGES, f"{root}/images", keep_batch=True)
    return latest(log, "id", [F.desc("batch_id")]).drop("batch_id")


def fold_tables(spark: SparkSession, root: str, upto: int, index: bool = True) -> None:
    """Known keys, link counts and index statistics of all batches up to ``upto``, each as one table.

    Run it between batches, now and then: later batches and reads then meet one table for all that is folded.
    """
    for keys in ("pages", "backlinks"):
        fold_keys(spark, f"{root}/known/{keys}", upto)
    link_counts(root).fold(spark, upto)
    if index:
        fold_index_statistics(spark, f"{root}/index", upto)


def ingest_batch(raw: DataFrame, root: str, batch: int, refresh: bool = False, index: bool = True,
                 same_host: bool = False, max_links: int | None = None, max_images: int | None = None,
                 start_url: str = "N/A", triggered_by: str = "batch", now: float | None = None,
                 buckets: int = BUCKETS, all_links: bool = False) -> None:
    """One batch of raw pages appended to the tables below ``root``.

    Repeats of a URL within the batch give one page, the one whose HTML has the least SHA-256; with ``all_links``
    the links of the others are stored as well. Known pages are dropped by their keys
    before their HTML is moved or parsed; with ``refresh`` they are stored again
    as a newer row, also in the index. Known pages and links are found through Bloom
    filters, and the backlinks of a page are the counts of its URL that earlier batches
    left, so a batch neither reads all stored keys nor counts stored links. The parsed batch is stored once with the
    tables, where a lost executor does not take it away. All links and images
    are kept unless ``max_links`` or ``max_images`` is given. All reads see earlier batches only
    and every write replaces the folder of this batch, so a batch that is run
    again leaves the tables as they were.
    """
    spark = raw.sparkSession
    parsed = f"{root}/parsed/batch_id={batch}"
    time = epoch_now() if now is None else F.lit(float(now))
    version = F.coalesce(F.sha2("html", 256), F.lit(""))
    keyed = require_url(raw).select("url", url_id("url").alias("id"), version.alias("hash"))
    fresh = keyed if refresh else absent(keyed, f"{root}/known/pages", before=batch)
    once = latest(fresh, "id", [F.asc("hash")]).select("url", "hash")
    rows = require_url(raw).withColumn("hash", version)
    if all_links:
        rows = rows.join(once.withColumnRenamed("hash", "least"), "url").withColumn("kept", F.col("hash") == F.col("least"))
    else:
        rows = rows.join(once, ["url", "hash"], "left_semi").withColumn("kept", F.lit(True))
    read = extract_pages(rows, same_host=same_host, max_links=max_links, max_images=max_images, keep=("hash", "kept"))
    read.dropDuplicates(["url", "hash"]).write.mode("overwrite").parquet(parsed)
    versions = spark.read.parquet(parsed)
    extracted = versions.filter("kept")

    counts = link_counts(root)
    stamped = extracted.select(
        url_id("url").alias("id"), "url", "title", "content", "snippet",
        asctime(time).alias("indexed_at"), time.alias("indexed_time"))
    linked = counts.read_for(stamped.select(F.col("url").alias("target_url")), before=batch).withColumnRenamed("target_url", "url")
    pages = stamped.join(linked, "url", "left").withColumn("backlinks", F.coalesce("backlinks", F.lit(0)))
    write_keyed(pages, f"{root}/pages", batch, PAGES, buckets=buckets)
    written = spark.read.schema(PAGES).parquet(f"{root}/pages/batch_id={batch}")
    write_keys(written, f"{root}/known/pages", batch)

    found = as_link_rows(page_links(versions)).dropDuplicates(["id"])
    links = absent(found, f"{root}/known/backlinks", before=batch).withColumn("created_at", time)
    write_batch(links.select(*BACKLINKS.fieldNames()), f"{root}/backlinks", batch)
    added = spark.read.schema(BACKLINKS).parquet(f"{root}/backlinks/batch_id={batch}")
    write_keys(added, f"{root}/known/backlinks", batch)
    counts.write(backlink_counts(added), batch)

    images = latest(
        page_images(extracted).select(url_id("url").alias("id"), "*"), "id",
        [F.xxhash64("source_url", "alt_text", "title")])
    images = images.withColumn("dominant_color", F.lit(None).cast("string")).withColumn("indexed_at", asctime(time))
    write_batch(prepare_images(images).select(*IMAGES.fieldNames()), f"{root}/images", batch)

    runs = run_row(raw, start_url, triggered_by, now)
    write_batch(runs.select(*RUN_LOG.fieldNames()), f"{root}/runs", batch)
    if index:
        append_index(written, f"{root}/index", batch)
