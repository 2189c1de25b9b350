"""The link graph: counts, resolved edges, statistics, frontier and reachability."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrawl.functions.text import contains_text, falsy
from pagetrawl.plans.lineage import cut_lineage
from pagetrawl.plans.skew import hot_keys, salted_join
from pagetrawl.schemas import CRAWL_DEPTH, DEFAULT_NODE_SNIPPET


def clamp(c, low, high) -> Column:
    """``c`` moved into the range from ``low`` to ``high``."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def node_size(backlinks) -> Column:
    """Display size of a graph node from its backlinks."""
    count = F.col(backlinks) if isinstance(backlinks, str) else backlinks
    return clamp(5 + 2 * count, 5, 30)


def backlink_counts(links: DataFrame) -> DataFrame:
    """``target_url, backlinks`` over all links with a target."""
    has_target = F.col("target_url").isNotNull() & (F.col("target_url") != "")
    return links.filter(has_target).groupBy("target_url").agg(F.count(F.lit(1)).alias("backlinks"))


def pages_with_backlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Graph nodes ``id, url, title, size, backlinks``; pages without links get 0.

    The links are counted before the join, so both sides have one row per URL.
    """
    counted = backlink_counts(links).withColumnRenamed("target_url", "url")
    count = F.coalesce("backlinks", F.lit(0))
    return pages.select("id", "url", "title").join(counted, "url", "left").select(
        "id", "url", falsy("title", F.col("url")).alias("title"),
        node_size(count).alias("size"), count.alias("backlinks"))


def resolve_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links between stored pages as ``source, target`` ids; others are dropped.

    A page that is stored in several versions is one end all the same.
    """
    ids = pages.select("url", "id").distinct()
    sources = ids.toDF("source_url", "source")
    targets = ids.toDF("target_url", "target")
    edges = links.select("source_url", "target_url")
    from_known = salted_join(edges, sources, "source_url", salt_by="target_url")
    resolved = salted_join(
        from_known, targets, "target_url", salt_by="source_url", hot=hot_keys(edges, "target_url"))
    return resolved.select("source", "target")


def graph_stats(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One row ``total_pages, total_links, isolated_pages``.

    Links count if both ends are stored; a page is isolated if no link at all
    points at it. Links are summed up per target before they meet the pages. Every version
    of a page is a page, but one end of a link.
    """
    versions = pages.groupBy(F.col("url").alias("target_url")).agg(F.count(F.lit(1)).alias("_versions"))
    sources = versions.select(F.col("target_url").alias("source_url"), F.lit(1).alias("_known"))
    flagged = salted_join(
        links.select("source_url", "target_url"), sources, "source_url", "left", "target_url")
    per_target = flagged.groupBy("target_url").agg(
        F.count(F.lit(1)).alias("_all"), F.count("_known").alias("_resolved"))
    isolated = F.when(F.col("_all").isNull(), F.col("_versions"))
    return versions.join(per_target, "target_url", "left").agg(
        F.coalesce(F.sum("_versions"), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum("_resolved"), F.lit(0)).alias("total_links"),
        F.coalesce(F.sum(isolated), F.lit(0)).alias("isolated_pages"))


def backlinks_as_of(pages: DataFrame, links: DataFrame) -> DataFrame:
    """``id, backlinks``: links to each page that existed when it was indexed.

    Of a page that is stored in several versions, each is counted at its own time.
    """
    when = pages.select("id", F.col("url").alias("target_url"), "indexed_time").distinct()
    facts = links.select("target_url", "source_url", "created_at")
    earlier = salted_join(facts, when, "target_url", salt_by="source_url").filter(
        F.col("created_at") < F.col("indexed_time"))
    counted = earlier.groupBy("id", "indexed_time").agg(F.count(F.lit(1)).alias("backlinks"))
    return pages.select("id", "indexed_time").join(counted, ["id", "indexed_time"], "left").select(
        "id", F.coalesce("backlinks", F.lit(0)).alias("backlinks"))


def frontier(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Link targets that are not stored yet, each once."""
    targets = links.select(F.col("target_url").alias("url")).distinct()
    return targets.join(pages.select("url"), "url", "left_anti")


def reachable(links: DataFrame, seeds: DataFrame, depth: int = CRAWL_DEPTH) -> DataFrame:
    """``url, hops`` of all pages at most ``depth`` links away from the seeds.

    Every round joins the newest pages, each once, to the links; repeated
    targets are combined before they are shuffled. Only the pages a round adds are
    checkpointed.
    """
    edges = links.select("source_url", "target_url")
    hot = hot_keys(edges, "source_url")
    newest = cut_lineage(seeds.select("url").distinct().withColumn("hops", F.lit(0)))
    seen = newest
    for hop in range(1, depth + 1):
        starts = newest.select(F.col("url").alias("source_url"))
        found = salted_join(edges, starts, "source_url", "left_semi", "target_url", hot)
        targets = found.select(F.col("target_url").alias("url")).distinct()
        newest = cut_lineage(
            targets.join(seen.select("url"), "url", "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(newest)
    return seen


def node_matches(q: str) -> Column:
    """True for nodes with ``q`` in title or URL; false for a blank ``q``."""
    needle = q.strip()
    if not needle:
        return F.lit(False)
    return contains_text("title", needle) | contains_text("url", needle)


def graph_search(nodes: DataFrame, q: str) -> DataFrame:
    """Nodes with ``q`` in title or URL; none if ``q`` is blank."""
    return nodes.filter(node_matches(q))


def edge_match(edges: DataFrame, nodes: DataFrame, q: str) -> DataFrame:
    """Edges between known nodes with a class: ``both``, ``one`` or ``none`` match.

    Without a search text the class is ``idle``. A node that is stored in several versions matches if one does.
    """
    flags = nodes.select("id", node_matches(q).alias("_m")).groupBy("id").agg(F.max("_m").alias("_m"))
    step = salted_join(
        edges.select("source", "target"), flags.toDF("source", "_s"), "source", salt_by="target")
    step = salted_join(
        step, flags.toDF("target", "_t"), "target", salt_by="source", hot=hot_keys(edges, "target"))
    hits = F.col("_s").cast("int") + F.col("_t").cast("int")
    matched = F.when(hits == 2, "both").when(hits == 1, "one").otherwise("none")
    return step.select("source", "target", (matched if q.strip() else F.lit("idle")).alias("match"))


def node_details(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """Nodes with the details of their page, or their own where there is none."""
    stored = pages.select(
        "id", F.col("title").alias("_title"), F.col("snippet").alias("_snippet"),
        F.col("backlinks").alias("_backlinks"), F.col("url").alias("_url"))
    return nodes.join(stored, "id", "left").select(
        "id",
        falsy("_title", F.col("title")).alias("title"),
        falsy("_snippet", F.lit(DEFAULT_NODE_SNIPPET)).alias("snippet"),
        F.coalesce(F.nullif("_backlinks", F.lit(0)), "backlinks", F.lit(0)).alias("backlinks"),
        falsy("_url", F.col("url")).alias("url"))


def likes(pages: DataFrame, like_events: DataFrame) -> DataFrame:
    """``id, likes`` from like events ``id``; pages without likes get 0."""
    counted = like_events.groupBy("id").agg(F.count(F.lit(1)).alias("likes"))
    return pages.select("id").join(counted, "id", "left").select(
        "id", F.coalesce("likes", F.lit(0)).alias("likes"))
