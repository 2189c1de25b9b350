"""Extraction and URL queries."""

from pyspark.sql import functions as F

from checks import bindings as B
from pagetrawl.functions import html as H
from pagetrawl.functions import text as X
from pagetrawl.functions import urls as U
from pagetrawl.operators import extract as E


def extract_title(spark, sf):
    return B.raw(spark, sf).select("url", H.extract_title("html", "url").alias("title"))


def extract_content(spark, sf):
    return B.raw(spark, sf).select("url", H.extract_content("html").alias("content"))


def extract_snippet(spark, sf):
    texts = B.raw(spark, sf).select("url", "html", H.extract_content("html").alias("content"))
    return texts.select("url", H.extract_snippet("html", "content").alias("snippet"))


def extract_pages(spark, sf):
    return E.extract_pages(B.raw(spark, sf)).select(
        "url", "title", "content", "snippet", F.array_join("links", " ").alias("links"),
        F.size("images").cast("bigint").alias("images"))


def extract_wrapped(spark, sf):
    """Products as pages full of traps: markup in comments and attributes, a stray quote, very long tags."""
    page = F.concat(
        F.lit("<!-- <title>old</title><body>no --><titlebar>x</titlebar><title>"), "p_name",
        F.lit("</title><body><script>for(i=0;i<n;i++){x()} if(a>b)y()</script><img alt='Next > page' "),
        F.repeat(F.lit('data-x="1 > 0" '), 3000), F.lit(" src='/i/"), "p_partkey", F.lit(".jpg'>"), "p_type",
        F.lit(" <a href=/p title=Bob\"s onclick=\"if(a>b)go()\">"), "p_brand", F.lit("</a>"),
        F.repeat(F.lit('<p class="x">'), 2000))
    shops = B.dealt(B.table(spark, sf, "part"), 500).select(
        F.concat(F.lit("http://shop.example.com/"), "p_partkey").alias("url"), page.alias("html"))
    return E.extract_pages(shops).select(
        "url", "title", "content", F.array_join("links", " ").alias("links"), F.get("images", F.lit(0))["url"].alias("image"))


def extract_hrefs(spark, sf):
    return B.raw(spark, sf).select(
        "url", F.posexplode(H.extract_hrefs("html")).alias("position", "href")).withColumn(
        "position", F.col("position").cast("bigint"))


def page_links(spark, sf):
    return B.merged_links(spark, sf).withColumn("position", F.col("position").cast("bigint"))


def resolve_url(spark, sf):
    hrefs = B.raw(spark, sf).select("url", F.explode(H.extract_hrefs("html")).alias("href"))
    return hrefs.select("url", "href", U.resolve_url("url", "href").alias("target"))


def is_page_link(spark, sf):
    return B.images(spark, sf).select("url", U.is_page_link("url").alias("image"),
                                      U.is_page_link("source_url").alias("page"))


def cap_links(spark, sf):
    return B.raw(spark, sf).select(
        "url", F.array_join(H.cap_links(H.extract_hrefs("html"), 2), " ").alias("hrefs"))


def split_links(spark, sf):
    lists = B.raw(spark, sf).select(
        F.col("url").alias("source_url"),
        F.concat(F.lit(" "), "url", F.lit(" , ,"), F.array_join(H.extract_hrefs("html"), " , ")).alias("links"))
    return E.links_from_lists(lists)


def url_ids(spark, sf):
    return B.links(spark, sf).select(
        "source_url", "target_url", U.url_id("source_url").alias("page_key"),
        U.link_id("source_url", "target_url").alias("link_key"))


def url_parts(spark, sf):
    return B.raw(spark, sf).select(
        "url", U.scheme("url").alias("scheme"), U.netloc("url").alias("netloc"), U.path("url").alias("path"),
        U.host_text("url").alias("host_text"), U.domain_key(U.netloc("url")).alias("domain_key"),
        U.domain_url(U.netloc("url")).alias("domain_url"), U.starts_with_http("url").alias("valid"))


def text_stats(spark, sf):
    stats = E.text_stats(B.pages(spark, sf))
    return stats.select("id", F.col("characters").cast("bigint"), F.col("words").cast("bigint"))


def require_url(spark, sf):
    return E.require_url(B.raw(spark, sf)).select("page_id", "url")


def text_functions(spark, sf):
    return B.corpus(spark, sf).select(
        "id", X.collapse("content").alias("collapsed"), X.truncate("content", 160).alias("cut"))


QUERIES = {f.__name__: f for f in (
    extract_title, extract_content, extract_snippet, extract_pages, extract_wrapped, extract_hrefs, page_links, resolve_url,
    is_page_link, cap_links, split_links, url_ids, url_parts, text_stats, require_url, text_functions)}

SQL = {
    "extract_title": f"SELECT url, {B.TITLE} AS title FROM pages",
    "extract_content": f"SELECT url, {B.CONTENT} AS content FROM pages",
    "extract_snippet": f"WITH {B.PAGES_SQL} SELECT url, snippet FROM p",
    "extract_pages": f"""WITH {B.PAGES_SQL}, {B.PAGE_LINKS_SQL},
        a AS (SELECT page_id, string_agg(target_url, ' ' ORDER BY position) AS links FROM r GROUP BY page_id)
        SELECT url, title, content, snippet, coalesce(links, '') AS links,
               CAST(0 AS BIGINT) AS images
        FROM p LEFT JOIN a USING (page_id)""",
    "extract_wrapped": """SELECT 'http://shop.example.com/' || p_partkey AS url, p_name AS title,
        'for(i=0;i<n;i++){x()} if(a>b)y() ' || p_type || ' ' || p_brand AS content,
        'http://shop.example.com/p' AS links, 'http://shop.example.com/i/' || p_partkey || '.jpg' AS image FROM part""",
    "extract_hrefs": f"""WITH {B.REAL_LINKS_SQL}, k AS (
        SELECT url, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS position FROM h)
        SELECT url, position, {B.decoded('href')} AS href FROM k""",
    "page_links": f"WITH {B.REAL_LINKS_SQL} SELECT source_url, position, target_url FROM r",
    "resolve_url": f"""WITH {B.REAL_LINKS_SQL}, k AS (
        SELECT url, {B.decoded('href')} AS href FROM (SELECT url, unnest(hrefs) AS href FROM h))
        SELECT url, href, regexp_extract(url,'^([a-z]+://[^/?#]*)',1) || href AS target FROM k""",
    "is_page_link": f"""WITH {B.IMAGES_SQL} SELECT url, NOT regexp_matches(url, '\\.(png|jpg|jpeg|gif|pdf|zip)$') AS image,
        NOT regexp_matches(source_url, '\\.(png|jpg|jpeg|gif|pdf|zip)$') AS page FROM im""",
    "cap_links": f"""WITH {B.REAL_LINKS_SQL}, e AS (
        SELECT page_id, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS i FROM h),
        m AS (SELECT page_id, href, min(i) AS i FROM e GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM m)
        SELECT url, coalesce(string_agg({B.decoded('href')}, ' ' ORDER BY i) FILTER (WHERE k <= 2), '') AS hrefs
        FROM pages LEFT JOIN n USING (page_id) GROUP BY page_id, url""",
    "split_links": f"""WITH {B.REAL_LINKS_SQL} SELECT url AS source_url, {B.decoded('href')} AS target_url FROM (
        SELECT url, trim(unnest(string_split(array_to_string(hrefs, ','), ','))) AS href FROM h) WHERE href <> ''
        UNION ALL SELECT url, url FROM pages""",
    "url_ids": f"""WITH {B.LINKS_SQL} SELECT source_url, target_url, sha256(source_url) AS page_key,
        sha256(source_url || '->' || target_url) AS link_key FROM l""",
    "url_parts": f"""SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
        {B.NETLOC} AS netloc, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
        split_part(regexp_replace(url, 'https?://', '', 'g'), '/', 1) AS host_text,
        translate({B.NETLOC}, './:', '___') AS domain_key, 'https://' || {B.NETLOC} AS domain_url,
        starts_with(url, 'http') AS valid FROM pages""",
    "text_stats": f"""WITH {B.PAGES_SQL} SELECT id, length(content) AS characters,
        len(list_filter(string_split_regex(trim(content), '\\s+'), lambda w: w <> '')) AS words FROM p""",
    "require_url": "SELECT page_id, url FROM pages WHERE url IS NOT NULL AND url <> ''",
    "text_functions": r"""SELECT doc_id AS id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS collapsed,
        CASE WHEN length(text) > 160 THEN substr(text, 1, 160) || '...' ELSE text END AS cut FROM documents""",
}
