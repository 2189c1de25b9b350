"""Crawl seeds from the domains of stored pages."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl.functions.urls import domain_key, domain_url, netloc
from pagetrawl.schemas import DEFAULT_SEEDS, SEEDS


def distinct_domains(pages: DataFrame) -> DataFrame:
    """``domain`` of all page URLs that have one, each once."""
    return pages.select(netloc("url").alias("domain")).filter("domain is not null").distinct()


def seed_rows(domains: DataFrame) -> DataFrame:
    """Seeds of domains; domains that share a key give one seed."""
    keyed = domains.groupBy(domain_key("domain").alias("id")).agg(F.min("domain").alias("domain"))
    return keyed.select("id", domain_url("domain").alias("url"), "domain", F.lit("discovered").alias("source"))


def add_seeds(current: DataFrame, domains: DataFrame) -> DataFrame:
    """The seeds to append: those whose key is not stored yet."""
    return seed_rows(domains).join(current.select("id"), "id", "left_anti")


def default_seeds(current: DataFrame) -> DataFrame:
    """The default seeds if ``current`` is empty, else no row."""
    spark: SparkSession = current.sparkSession
    rows = spark.createDataFrame(DEFAULT_SEEDS, "url string, domain string, source string")
    return rows.where(~current.exists()).select(
        F.replace(F.col("domain"), F.lit("."), F.lit("_")).alias("id"), "url", "domain", "source")


def seed_summary(domains: DataFrame, current: DataFrame) -> DataFrame:
    """One row ``added, total_discovered, already_present`` of a discovery.

    A domain whose key another domain of the same run has taken counts as
    present.
    """
    known = current.select("id", F.lit(1).alias("_known")).distinct()
    per_key = domains.distinct().groupBy(domain_key("domain").alias("id")).agg(
        F.count(F.lit(1)).alias("_domains"))
    joined = per_key.join(known, "id", "left")
    added = F.count_if(F.col("_known").isNull())
    total = F.coalesce(F.sum("_domains"), F.lit(0))
    return joined.agg(
        added.alias("added"), total.alias("total_discovered"), (total - added).alias("already_present"))


def startup_seeds(current: DataFrame, pages: DataFrame) -> DataFrame:
    """The seeds a start appends: discovered ones, and defaults if there is still none."""
    discovered = add_seeds(current, distinct_domains(pages))
    after = current.select("id").unionByName(discovered.select("id"))
    return discovered.unionByName(default_seeds(after))


def startup_summary(current: DataFrame, pages: DataFrame) -> DataFrame:
    """One row ``added_from_pages, added_defaults, total_added``."""
    added = startup_seeds(current, pages)
    from_pages = F.count_if(F.col("source") == "discovered")
    return added.agg(
        from_pages.alias("added_from_pages"),
        (F.count(F.lit(1)) - from_pages).alias("added_defaults"),
        F.count(F.lit(1)).alias("total_added"))


def empty_seeds(spark: SparkSession) -> DataFrame:
    """A seed table without rows."""
    return spark.createDataFrame([], SEEDS)
