"""Raw pages to structured pages, links and images in one scan."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrawl.functions import html as H
from pagetrawl.functions.text import strip
from pagetrawl.functions.urls import is_page_link, link_id


def require_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows that have a URL."""
    return df.filter(F.col(url).isNotNull() & (F.col(url) != ""))


def extract_pages(raw: DataFrame, drop_script_style: bool = False, same_host: bool = False,
                  max_links: int | None = None, max_images: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``url, title, content, snippet, links, images`` of raw pages ``url, html``.

    All links and images are kept unless a limit is given. ``keep`` names more columns of the raw pages that
    go along, behind the URL.
    """
    read = require_url(raw).select(
        "url", *keep,
        H.extract_content("html", drop_script_style).alias("content"),
        H.markup("html").alias("_markup"),
    ).withColumn("_title", H.title_in("_markup"))
    parsed = read.select(
        "url", *keep, "_title", "content",
        H.description_in("_markup").alias("_description"),
        H.links_in("url", "_markup", same_host, max_links).alias("links"),
        H.images_in("url", "_markup", "_title").alias("images"),
    )
    return parsed.select(
        "url", *keep,
        F.when(F.col("_title") != "", F.col("_title")).otherwise(F.col("url")).alias("title"),
        "content",
        H.snippet_of("_description", "content").alias("snippet"),
        "links",
        H.filter_images("images", max_images).alias("images"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """One row per page link: ``source_url, position, target_url``."""
    return pages.select(
        F.col("url").alias("source_url"),
        F.posexplode("links").alias("position", "target_url"),
    )


def url_links(raw: DataFrame) -> DataFrame:
    """One row per page link of a URL, ``source_url, position, target_url``, over all its versions in ``raw``.

    A target counts once, at the first place that it has among the hrefs of any version; equal places go by target.
    """
    placed = require_url(raw).select(
        F.col("url").alias("source_url"), F.posexplode(H.resolved_hrefs("url", "html")).alias("place", "target_url"))
    first = placed.filter(is_page_link("target_url")).groupBy("source_url", "target_url").agg(F.min("place").alias("place"))
    order = Window.partitionBy("source_url").orderBy("place", "target_url")
    return first.select("source_url", (F.row_number().over(order) - 1).alias("position"), "target_url")


def links_from_lists(lists: DataFrame) -> DataFrame:
    """Links from comma-separated lists ``source_url, links``."""
    return lists.select("source_url", F.explode(H.split_links("links")).alias("target_url"))


def page_images(pages: DataFrame) -> DataFrame:
    """One row per page image: ``url, alt_text, source_url, title``."""
    return pages.select(F.inline("images"))


def as_link_rows(links: DataFrame) -> DataFrame:
    """Links with their key; links of a page to itself are dropped."""
    tidy = links.withColumn("target_url", strip("target_url"))
    return tidy.filter((F.col("source_url") != F.col("target_url")) & (F.col("target_url") != "")).select(
        link_id("source_url", "target_url").alias("id"), "source_url", "target_url")


def text_stats(pages: DataFrame, text: str = "content") -> DataFrame:
    """``id, characters, words`` of every page; missing text counts as empty."""
    content = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.trim(content), r"\s+"), lambda w: w != "")
    return pages.select("id", F.length(content).alias("characters"), F.size(words).alias("words"))
