"""Image, colour, collection, history, run-log and time queries."""

from pyspark.sql import functions as F

from checks import bindings as B
from pagetrawl.functions import colour as C
from pagetrawl.functions import times as M
from pagetrawl.functions.text import falsy
from pagetrawl.operators import collections as L
from pagetrawl.operators import graph as G
from pagetrawl.operators import history as H
from pagetrawl.operators import images as I
from pagetrawl.plans.lineage import new_folder
from pagetrawl.schemas import HISTORY, IMAGE_SCAN_CAP
from pagetrawl.sources.tables import read_batches, write_batch


def scan_images(spark, sf):
    """The scan with its usual cap."""
    return I.scan_images(B.images(spark, sf), IMAGE_SCAN_CAP).select("id", "url")


def image_match(spark, sf):
    return I.image_match(B.images(spark, sf), "Blue,hot-x").select("id", "title")


def image_match_batch(spark, sf):
    """Every distinct product name as an image query."""
    asked = B.table(spark, sf, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("q")).distinct()
    return I.image_match_batch(B.images(spark, sf), asked)


def image_search(spark, sf):
    return I.image_search(B.images(spark, sf), "blue")


def image_search_batch(spark, sf):
    asked = B.table(spark, sf, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("q")).distinct()
    found = I.image_search_batch(B.images(spark, sf), asked)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


def project_images(spark, sf):
    """Images without title or source, as their fallbacks."""
    bare = B.images(spark, sf).withColumn("title", F.lit("")).withColumn(
        "source_url", F.lit(None).cast("string"))
    return I.project_images(bare)


def dominant_colour(spark, sf):
    return B.coloured_images(spark, sf).select("id", "dominant_color")


def colour_bucket(spark, sf):
    return B.raw(spark, sf).select("url", C.colour_bucket("url").alias("bucket"))


def colour_filter(spark, sf):
    return I.colour_filter(B.coloured_images(spark, sf), "teal").select("id", "url")


def colour_facets(spark, sf):
    return I.colour_facets(B.coloured_images(spark, sf))


def query_topic(spark, sf):
    return B.corpus(spark, sf).select(
        "id", C.query_topic("content").alias("topic"), C.query_topic("content", wide=True).alias("wide"))


def image_terms(spark, sf):
    terms = B.title_queries(spark, sf)
    return terms.select("query_id", F.explode(C.image_terms("q")).alias("keyword")).distinct()


def flatten_collections(spark, sf):
    return L.flatten(B.nested_by_url(spark, sf)).select(
        "collection_id", F.col("position").cast("bigint"), "page_id", "url")


def _flat(nested):
    return L.flatten(nested).select("collection_id", "url")


def filter_collections_nested(spark, sf):
    return _flat(L.filter_collections_nested(B.nested_by_url(spark, sf), " THE "))


def collection_add_nested(spark, sf):
    """A new page in the collection with the smallest id."""
    nested = B.nested_collections(spark, sf)
    page = F.struct(F.lit("new").alias("id"), F.lit("http://new/").alias("url"), F.lit("").alias("title"), F.lit("").alias("snippet"))
    return _flat(L.add_page_nested(nested, nested.select(F.min("id")).scalar(), page))


def collection_remove_nested(spark, sf):
    """The page with the smallest id leaves the collection with the largest."""
    nested = B.nested_collections(spark, sf)
    page = L.flatten(nested).agg(F.min("page_id")).first()[0]  # a scalar subquery can't stand in a lambda
    return _flat(L.remove_page_nested(nested, nested.agg(F.max("id")).first()[0], page))


def collection_total_nested(spark, sf):
    return L.collection_total_nested(B.nested_collections(spark, sf))


def filter_collections(spark, sf):
    found = L.filter_collections(B.collections(spark, sf), B.saved(spark, sf), " TH ")
    return found.select("collection_id", "page_id", "url")


def filter_collections_by_page(spark, sf):
    found = L.filter_collections(B.collections(spark, sf), B.saved(spark, sf), "ref=x")
    return found.select("collection_id", "page_id", "url")


def collection_add(spark, sf):
    """Pages saved before are those some page links to."""
    saved = B.saved(spark, sf)
    known = saved.join(B.linked_pages(spark, sf).select("url"), "url", "left_semi")
    return L.add_pages(known, saved).select("collection_id", "page_id", "url")


def collection_create(spark, sf):
    """Hosts as new names, in capitals, next to those of secure pages."""
    used = B.collections(spark, sf).join(
        B.raw(spark, sf).filter("url like 'https:%'").select(F.regexp_extract("url", "//([^/?#]*)", 1).alias("id")),
        "id", "left_semi")
    named = B.collections(spark, sf).withColumn("name", F.concat(F.lit(" "), F.upper("name")))
    return L.add_collections(used, named)


def collection_delete(spark, sf):
    linked = B.linked_pages(spark, sf).select(F.regexp_extract("url", "//([^/?#]*)", 1).alias("id"))
    return L.remove_collections(B.collections(spark, sf), linked).select("id", "name")


def collection_remove(spark, sf):
    saved = B.saved(spark, sf)
    linked = B.linked_pages(spark, sf).select(F.col("id").alias("page_id"))
    return L.remove_pages(saved, saved.join(linked, "page_id", "left_semi")).select("collection_id", "page_id")


def saved_in(spark, sf):
    saved = B.saved(spark, sf).join(B.linked_pages(spark, sf).select("url"), "url", "left_semi")
    return L.saved_in(B.page_keys(spark, sf), saved).select("id", "saved")


def saved_pairs(spark, sf):
    return L.saved_pairs(B.page_keys(spark, sf), B.saved(spark, sf))


def collection_total(spark, sf):
    found = L.filter_collections(B.collections(spark, sf), B.saved(spark, sf), "th")
    return L.collection_total(found)


def recent_history(spark, sf):
    return H.recent_history(B.history(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


def mru_queries(spark, sf):
    return H.mru_queries(B.history(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


def _failed_sessions(spark, sf):
    """Sessions with an expensive error."""
    errors = B.table(spark, sf, "events").filter("event_type = 'error' AND value > 50")
    return errors.select(F.col("user_id").cast("string").alias("session_id"))


def clear_history(spark, sf):
    return H.clear_history(B.history(spark, sf), _failed_sessions(spark, sf)).select("id", "session_id")


def cleared_counts(spark, sf):
    return H.cleared_counts(B.history(spark, sf), _failed_sessions(spark, sf))


def append_history(spark, sf):
    """Searches stored as two batches, the second one twice, with how many rows share an id."""
    path = new_folder(spark, "history")
    events = B.history(spark, sf).drop("id")
    for batch in (0, 1, 1):
        H.append_history(events.filter(F.col("timestamp").cast("bigint") % 2 == batch), path, batch)
    stored = read_batches(spark, HISTORY, path)
    same = stored.groupBy("id").agg(F.count(F.lit(1)).alias("same_id"))
    return stored.join(same, "id").select("session_id", "query", "timestamp", "same_id")


def history_cleared(spark, sf):
    """A stored history and its copy without the failed sessions."""
    path, to = new_folder(spark, "history"), new_folder(spark, "cleared")
    write_batch(B.history(spark, sf), path, 0)
    H.write_cleared(spark, path, _failed_sessions(spark, sf), to)
    return read_batches(spark, HISTORY, to).select("id", "session_id")


def recent_runs(spark, sf):
    return H.recent_runs(B.runs(spark, sf))


def project_runs(spark, sf):
    return H.project_runs(B.runs(spark, sf))


def run_summary(spark, sf):
    """The event log as a crawl batch whose errors have no URL."""
    batch = B.table(spark, sf, "events").select(
        F.when(F.col("event_type") != "error", F.col("props")).alias("url"))
    return H.run_summary(batch)


def schedule(spark, sf):
    rows = B.table(spark, sf, "events").select(
        (F.col("event_type") == "click").alias("enabled"),
        F.when(F.col("value") > 10, "daily").otherwise("weekly").alias("interval"),
        F.lit("").alias("start_url"), F.lit(None).cast("string").alias("last_run"),
        B.event_time().alias("updated_at"), "event_id")
    return H.schedule_rows(rows.drop("event_id"))


def next_run(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", M.next_run(F.col("value") > 5, "event_type", B.event_time()).alias("next_run"))


def asctime(spark, sf):
    return B.history(spark, sf).select("id", M.asctime("timestamp").alias("shown"))


def calendar_text(spark, sf):
    return B.history(spark, sf).select("id", M.calendar_text("timestamp").alias("shown"))


def parse_time(spark, sf):
    shown = B.history(spark, sf).select("id", M.asctime("timestamp").alias("a"), M.calendar_text("timestamp").alias("c"))
    return shown.select(
        "id", M.parse_time("a").alias("from_asctime"), M.parse_time("c").alias("from_calendar"),
        M.parse_time("id").alias("from_garbage"))


def number_casts(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", M.to_number(B.event_k(), "bigint").alias("k"), M.to_number("event_type").alias("none"))


def clamp(spark, sf):
    return B.scored_pages(spark, sf).select("id", G.node_size("backlinks").cast("bigint").alias("size"))


def default_chain(spark, sf):
    return B.images(spark, sf).select("id", falsy("dominant_color", F.nullif("title", F.lit("blue bolt")), F.lit("none")).alias("first"))


QUERIES = {f.__name__: f for f in (
    scan_images, image_match, image_match_batch, image_search, image_search_batch, project_images, dominant_colour,
    colour_bucket, colour_filter, colour_facets, query_topic, image_terms, flatten_collections, filter_collections,
    filter_collections_nested, collection_add_nested, collection_remove_nested, collection_total_nested,
    filter_collections_by_page, collection_add, collection_create, collection_delete, collection_remove, saved_in,
    saved_pairs, collection_total, recent_history, mru_queries, clear_history, cleared_counts, append_history, history_cleared,
    recent_runs, project_runs, run_summary, schedule, next_run, asctime, calendar_text, parse_time, number_casts,
    clamp, default_chain)}

_I = B.IMAGES_SQL
_COLOURED = f"{_I}, ci AS (SELECT *, {B.colour_sql()} AS dominant_color FROM im)"
_KEYWORDS = r"""ky AS (SELECT q, unnest(CASE WHEN len(k) > 0 THEN k ELSE [lower(q)] END) AS keyword FROM (
    SELECT q, list_filter(string_split_regex(translate(lower(q), ',-', '  '), '\s+'), lambda x: length(x) > 1) AS k
    FROM (SELECT DISTINCT p_name AS q FROM part)))"""
_HITS = f"""ht AS (SELECT DISTINCT q AS query_id, id FROM ky JOIN im ON contains(lower(alt_text), keyword)
    OR contains(lower(title), keyword) OR contains(lower(url), keyword))"""
_NESTED = f"""{B.REAL_LINKS_SQL}, ne AS (SELECT sha256(source_url) AS collection_id, position,
    sha256(target_url) AS page_id, target_url AS url, name FROM r
    JOIN (SELECT url AS u, {B.TITLE} AS name FROM pages) ON u = source_url)"""
# Every stored page as a collection of its own.
_NESTED_BY_PAGE = f"""{B.PAGE_LINKS_SQL}, ne AS (SELECT page_id AS stored, sha256(source_url) AS collection_id,
    sha256(target_url) AS page_id, target_url AS url FROM r)"""
_LINKED = "lk AS (SELECT DISTINCT target_url AS url FROM l)"
_HOST = "regexp_extract(url, '//([^/?#]*)', 1)"
_FAILED = "fs AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS session_id FROM events WHERE event_type = 'error' AND value > 50)"
_ASCTIME = "strftime({0}, '%a %b ') || lpad(CAST(day({0}) AS VARCHAR), 2, ' ') || strftime({0}, ' %H:%M:%S %Y')"


def _filtered(q: str) -> str:
    page = f"(contains(lower(title), '{q}') OR contains(lower(url), '{q}'))"
    return f"""fc AS (SELECT collection_id, page_id, url FROM (
        SELECT *, {page} AS m, bool_or({page}) OVER (PARTITION BY collection_id) AS a FROM sv)
        WHERE m OR (NOT a AND contains(lower(collection_id), '{q}')))"""


def _topic(names: dict[str, list[str]]) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{t}'" for t, w in names.items())
    return f"CASE {whens} ELSE 'nature' END"


def _topics() -> str:
    from pagetrawl.schemas import TOPIC_SYNONYMS, TOPICS
    return (f"SELECT doc_id AS id, {_topic({t: [t] for t in TOPICS})} AS topic, "
            f"{_topic(TOPIC_SYNONYMS)} AS wide FROM documents")


def _facets() -> str:
    from pagetrawl.schemas import PALETTE
    names = ", ".join(f"('{c}')" for c in PALETTE)
    return f"""WITH {_COLOURED} SELECT facet, count(ci.id) AS images FROM (VALUES {names}) v(facet)
        LEFT JOIN ci ON ci.dominant_color = facet GROUP BY ALL UNION ALL SELECT 'all', count(*) FROM ci"""


SQL = {
    "scan_images": f"WITH {_I} SELECT id, url FROM im ORDER BY id LIMIT 100",
    "image_match": f"""WITH {_I} SELECT id, title FROM im WHERE regexp_matches(
        lower(alt_text) || chr(10) || lower(title) || chr(10) || lower(url), 'blue|hot')""",
    "image_match_batch": f"WITH {_I}, {_KEYWORDS}, {_HITS} SELECT query_id, id FROM ht",
    "image_search": f"""WITH {_COLOURED}
        SELECT id, url, alt_text, source_url, title, dominant_color FROM ci
        WHERE contains(lower(title), 'blue') ORDER BY id LIMIT 12""",
    "image_search_batch": f"""WITH {_I}, {_KEYWORDS}, {_HITS}, r AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM ht)
        SELECT query_id, id, rank FROM r WHERE rank <= 12""",
    "project_images": f"""WITH {_I}, b AS (SELECT id, url, alt_text, 'https://en.wikipedia.org' AS source_url,
        alt_text AS title FROM im) SELECT *, {B.colour_sql()} AS dominant_color FROM b""",
    "dominant_colour": f"WITH {_COLOURED} SELECT id, dominant_color FROM ci",
    "colour_bucket": f"SELECT url, {B.bucket_sql()} AS bucket FROM pages",
    "colour_filter": f"WITH {_COLOURED} SELECT id, url FROM ci WHERE dominant_color = 'teal'",
    "colour_facets": _facets(),
    "query_topic": _topics(),
    "image_terms": rf"""WITH q AS (SELECT page_id, lower({B.TITLE}) AS q FROM pages), k AS (SELECT page_id, q,
        list_filter(string_split_regex(translate(q, ',-', '  '), '\s+'), lambda x: length(x) > 1) AS k FROM q)
        SELECT DISTINCT page_id AS query_id, unnest(CASE WHEN len(k) > 0 THEN k ELSE [q] END) AS keyword FROM k""",
    "flatten_collections": f"""WITH {_NESTED} SELECT collection_id, position, page_id, url FROM ne""",
    "filter_collections_nested": f"""WITH {_NESTED}, m AS (
        SELECT *, contains(lower(url), 'the') AS m, bool_or(contains(lower(url), 'the')) OVER (PARTITION BY collection_id) AS a
        FROM ne) SELECT collection_id, url FROM m WHERE m OR (NOT a AND contains(lower(name), 'the'))""",
    "collection_add_nested": f"""WITH {_NESTED_BY_PAGE} SELECT collection_id, url FROM ne
        UNION ALL SELECT sha256(url), 'http://new/' FROM pages WHERE sha256(url) = (SELECT min(sha256(url)) FROM pages)
        AND page_id NOT IN (SELECT stored FROM ne WHERE url = 'http://new/')""",
    "collection_remove_nested": f"""WITH {_NESTED_BY_PAGE} SELECT collection_id, url FROM ne
        WHERE NOT (collection_id = (SELECT max(sha256(url)) FROM pages) AND page_id = (SELECT min(page_id) FROM ne))""",
    "collection_total_nested": f"WITH {_NESTED_BY_PAGE} SELECT count(*) AS pages FROM ne",
    "filter_collections": f"WITH {B.SAVED_SQL}, {_filtered('th')} SELECT * FROM fc",
    "filter_collections_by_page": f"WITH {B.SAVED_SQL}, {_filtered('ref=x')} SELECT * FROM fc",
    "collection_add": f"""WITH {B.SAVED_SQL}, {B.LINKS_SQL}, {_LINKED}
        SELECT DISTINCT collection_id, page_id, url FROM sv WHERE url NOT IN (SELECT url FROM lk)""",
    "collection_create": f"""SELECT DISTINCT {_HOST} AS id, upper({_HOST}) AS name, '' AS description FROM pages
        WHERE {_HOST} NOT IN (SELECT {_HOST} FROM pages WHERE url LIKE 'https:%')""",
    "collection_delete": f"""WITH {B.LINKS_SQL}, {_LINKED} SELECT DISTINCT {_HOST} AS id, {_HOST} AS name FROM pages
        WHERE {_HOST} NOT IN (SELECT {_HOST} FROM lk)""",
    "collection_remove": f"""WITH {B.SAVED_SQL}, {B.LINKS_SQL}, {_LINKED}
        SELECT collection_id, page_id FROM sv WHERE url NOT IN (SELECT url FROM lk)""",
    "saved_in": f"""WITH {B.KEYS_SQL}, {B.LINKS_SQL}, {_LINKED}
        SELECT id, url IN (SELECT url FROM lk) AS saved FROM p""",
    "saved_pairs": f"WITH {B.SAVED_SQL} SELECT page_id AS id, collection_id FROM sv",
    "collection_total": f"WITH {B.SAVED_SQL}, {_filtered('th')} SELECT count(*) AS pages FROM fc",
    "recent_history": f"""WITH {B.HISTORY_SQL}, r AS (SELECT session_id, row_number() OVER (
        PARTITION BY session_id ORDER BY "timestamp" DESC, id) AS rank, id, query, "timestamp" FROM hi)
        SELECT * FROM r WHERE rank <= 20""",
    "mru_queries": f"""WITH {B.HISTORY_SQL}, f AS (SELECT session_id, query, min("timestamp") AS "timestamp" FROM hi GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY "timestamp" DESC, query) AS rank FROM f)
        SELECT * FROM r WHERE rank <= 10""",
    "clear_history": f"""WITH {B.HISTORY_SQL}, {_FAILED}
        SELECT id, session_id FROM hi WHERE session_id NOT IN (SELECT session_id FROM fs)""",
    "history_cleared": f"""WITH {B.HISTORY_SQL}, {_FAILED}
        SELECT id, session_id FROM hi WHERE session_id NOT IN (SELECT session_id FROM fs)""",
    "append_history": f"""WITH {B.HISTORY_SQL} SELECT session_id, query, "timestamp", CAST(1 AS BIGINT) AS same_id FROM hi""",
    "cleared_counts": f"""WITH {B.HISTORY_SQL}, {_FAILED}
        SELECT session_id, count(*) AS deleted FROM hi JOIN fs USING (session_id) GROUP BY ALL""",
    "recent_runs": f"""WITH {B.RUNS_SQL} SELECT * FROM ru ORDER BY "timestamp" DESC, id LIMIT 15""",
    "project_runs": f"WITH {B.RUNS_SQL} SELECT * FROM ru",
    "run_summary": """SELECT count(*) FILTER (WHERE event_type <> 'error') AS pages_crawled,
        count(*) FILTER (WHERE event_type = 'error') AS errors FROM events""",
    "schedule": """SELECT event_type = 'click' AS enabled, CASE WHEN value > 10 THEN 'daily' ELSE 'weekly' END AS interval,
        'https://news.ycombinator.com' AS start_url, 'N/A' AS last_run, epoch_us(ts) / 1e6 AS updated_at,
        CASE WHEN event_type = 'click' THEN strftime(ts + to_days(CASE WHEN value > 10 THEN 1 ELSE 7 END),
          '%Y-%m-%d %H:%M:%S') ELSE 'N/A' END AS next_run FROM events""",
    "next_run": """SELECT event_id, CASE WHEN value > 5 THEN strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S')
        ELSE 'N/A' END AS next_run FROM events""",
    "asctime": f"""SELECT CAST(event_id AS VARCHAR) AS id, {_ASCTIME.format('ts')} AS shown FROM events""",
    "calendar_text": "SELECT CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events",
    "parse_time": """SELECT CAST(event_id AS VARCHAR) AS id, CAST(floor(epoch_us(ts) / 1e6) AS DOUBLE) AS from_asctime,
        CAST(floor(epoch_us(ts) / 1e6) AS DOUBLE) AS from_calendar, CAST(NULL AS DOUBLE) AS from_garbage FROM events""",
    "number_casts": """SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
        CAST(NULL AS DOUBLE) AS none FROM events""",
    "clamp": f"WITH {B.SCORED_SQL} SELECT id, greatest(5, least(30, 5 + 2 * backlinks)) AS size FROM s",
    "default_chain": f"WITH {_I} SELECT id, CASE WHEN title = 'blue bolt' THEN 'none' ELSE title END AS first FROM im",
}
