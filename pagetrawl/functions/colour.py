"""Colour and topic rules of the image search."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrawl.functions.text import col
from pagetrawl.schemas import COLOUR_KEYWORDS, DEFAULT_TOPIC, HASH_COLOURS, TOPIC_SYNONYMS, TOPICS


def _first_match(text: Column, keywords: dict[str, list[str]]) -> Column:
    found = F.coalesce(*(
        F.when(text.rlike("|".join(words)), F.lit(name)) for name, words in keywords.items()))
    return found


def colour_bucket(url) -> Column:
    """MD5 of the URL as a 128-bit number, modulo the number of hash colours.

    The digest is read as four 32-bit chunks; 2^32 leaves 4 modulo 11, so the
    chunks weigh 4^3, 4^2, 4 and 1, that is 9, 5, 4 and 1.
    """
    digest = F.md5(col(url))
    chunks = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    total = sum((c * w for c, w in zip(chunks, (9, 5, 4, 1))), F.lit(0))
    return (total % len(HASH_COLOURS)).cast("int")


def dominant_colour(title, alt, url) -> Column:
    """Colour named in title, alt text or URL, else one picked by the URL hash."""
    parts = [F.coalesce(col(c), F.lit("")) for c in (title, alt, url)]
    text = F.lower(F.concat_ws(" ", *parts))
    names = F.array(*(F.lit(c) for c in HASH_COLOURS))
    return F.coalesce(_first_match(text, COLOUR_KEYWORDS), F.get(names, colour_bucket(url)))


def query_topic(q, wide: bool = False) -> Column:
    """Topic named in an image query; ``wide`` also knows synonyms."""
    keywords = TOPIC_SYNONYMS if wide else {t: [t] for t in TOPICS}
    return F.coalesce(_first_match(F.lower(col(q)), keywords), F.lit(DEFAULT_TOPIC))


def image_terms(q) -> Column:
    """Keywords of an image query; the whole query if it has none."""
    q = F.lower(col(q))
    terms = F.filter(
        F.split(F.translate(q, ",-", "  "), r"\s+"), lambda t: F.length(t) > 1)
    return F.when(F.size(terms) > 0, terms).otherwise(F.array(q))
