"""Image search by keyword, colour facets and result projection."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrawl.functions.colour import dominant_colour, image_terms
from pagetrawl.functions.text import falsy
from pagetrawl.plans.skew import hot_of, salted_join, top_n
from pagetrawl.schemas import (
    DEFAULT_IMAGE_NAME, DEFAULT_IMAGE_SOURCE, IMAGE_LIMIT, PALETTE,
)

GRAM = 3


def scan_images(images: DataFrame, cap: int | None = None) -> DataFrame:
    """All images, or the first ``cap`` by id (``IMAGE_SCAN_CAP`` is the usual one)."""
    return images.orderBy("id").limit(cap) if cap else images


def _texts() -> list[Column]:
    return [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("alt_text", "title", "url")]


def image_match(images: DataFrame, q: str) -> DataFrame:
    """Images with any keyword of ``q`` in alt text, title or URL."""
    terms = image_terms(F.lit(q))
    alt, title, url = _texts()
    return images.filter(F.exists(
        terms, lambda k: alt.contains(k) | title.contains(k) | url.contains(k)))


def _grams(df: DataFrame, text: str, sizes: str) -> DataFrame:
    """``df`` with one row per substring ``gram`` of ``text``, for an array of sizes."""
    sized = df.withColumn("_size", F.expr(f"explode({sizes})")).filter(f"length({text}) >= _size")
    placed = sized.withColumn("_at", F.expr(f"explode(sequence(1, length({text}) - _size + 1))"))
    return placed.withColumn("gram", F.expr(f"substr({text}, _at, _size)")).drop("_size", "_at")


def image_match_batch(images: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, id`` of every image that matches a query ``query_id, q``.

    A keyword can only occur in a text that holds all its three-letter pieces
    (or the keyword as a whole, if it is shorter). Images meet a keyword through
    its rarest piece and are then tested in full, so no image is paired with a
    keyword it has nothing in common with. An empty query matches every image.
    """
    asked = queries.select("query_id", F.explode(image_terms("q")).alias("keyword")).distinct()
    keywords = asked.select("keyword").distinct()
    pieces = _grams(
        keywords.filter("keyword <> ''"), "keyword", f"array(least(length(keyword), {GRAM}))").distinct()
    wanted = pieces.select("gram").distinct()

    # One text per image; the separator occurs in no keyword.
    texts = images.select("id", F.concat_ws("\x01", *_texts()).alias("_text"))
    sizes = f"sequence(1, {GRAM})"
    grams = _grams(texts, "_text", sizes).join(wanted, "gram", "left_semi").distinct()

    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (
        pieces.join(counts, "gram", "left").groupBy("keyword")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("_r"))
        .select("keyword", F.col("_r.gram").alias("gram"))
    )
    met = salted_join(grams, rarest, "gram", salt_by="id", hot=hot_of(counts, "gram", "_n"))
    matched = met.filter(F.col("_text").contains(F.col("keyword"))).select("keyword", "id")
    # An empty query has the empty keyword, which every image holds.
    has_blank = asked.filter("keyword = ''").exists()
    everything = images.where(has_blank).select(F.lit("").alias("keyword"), "id")
    found = salted_join(matched.unionByName(everything), asked, "keyword", salt_by="id")
    return found.select("query_id", "id").distinct()


def project_images(images: DataFrame) -> DataFrame:
    """Image results with their fallbacks and a colour."""
    named = images.select(
        "id", "url",
        falsy("alt_text", F.col("title"), F.lit(DEFAULT_IMAGE_NAME)).alias("alt_text"),
        falsy("source_url", F.lit(DEFAULT_IMAGE_SOURCE)).alias("source_url"),
        falsy("title", F.col("alt_text"), F.lit(DEFAULT_IMAGE_NAME)).alias("title"),
        "dominant_color",
    )
    colour = falsy("dominant_color", dominant_colour("title", "alt_text", "url"))
    return named.withColumn("dominant_color", colour)


def image_search(images: DataFrame, q: str, limit: int = IMAGE_LIMIT,
                 cap: int | None = None) -> DataFrame:
    """The first ``limit`` matches by id among the scanned images, projected."""
    found = image_match(scan_images(images, cap), q).orderBy("id").limit(limit)
    return project_images(found)


def image_search_batch(images: DataFrame, queries: DataFrame, limit: int = IMAGE_LIMIT) -> DataFrame:
    """``query_id, id, rank``: the first ``limit`` matches by id of every query."""
    return top_n(image_match_batch(images, queries), ["query_id"], [F.asc("id")], limit)


def colour_filter(images: DataFrame, colour: str | None) -> DataFrame:
    """Images of one colour, all images without one."""
    return images.filter(F.col("dominant_color") == colour) if colour else images


def colour_facets(images: DataFrame) -> DataFrame:
    """``facet, images`` for ``all`` and each colour of the palette, zeros included."""
    measures = [F.count(F.lit(1)).alias("all")]
    measures += [F.count_if(F.col("dominant_color") == c).alias(c) for c in PALETTE]
    facets = F.array(*(
        F.struct(F.lit(c).alias("facet"), F.col(c).alias("images")) for c in ["all", *PALETTE]))
    return images.agg(*measures).select(F.inline(facets))
