"""Full-text matching, BM25 ranking, filters, sorting and paging."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrawl.functions.text import analyse, analyse_literal, contains_text, falsy
from pagetrawl.functions.times import parse_time, preset_bounds
from pagetrawl.functions.urls import netloc
from pagetrawl.operators.index import GRAM, Index
from pagetrawl.plans.lineage import stored_once
from pagetrawl.plans.skew import salted_join, top_n
from pagetrawl.schemas import BM25_B, BM25_K1, CANDIDATE_CAP, PAGE_SIZE

# --- Matching: ids of documents --------------------------------------------------------


def _field(postings: DataFrame, field: str) -> DataFrame:
    return postings.filter(F.col("field") == field)


def match_all(postings: DataFrame, terms: list[str], field: str = "content") -> DataFrame:
    """Documents with every term."""
    wanted = sorted(set(terms))
    return (
        _field(postings, field).filter(F.col("term").isin(wanted))
        .groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == len(wanted)).select("id")
    )


def match_any(postings: DataFrame, terms: list[str], field: str = "content") -> DataFrame:
    """Documents with at least one of the terms."""
    return _field(postings, field).filter(F.col("term").isin(sorted(set(terms)))).select("id").distinct()


def match_none(docs: DataFrame, postings: DataFrame, terms: list[str], field: str = "content") -> DataFrame:
    """Documents of ``docs`` with none of the terms."""
    return docs.select("id").join(match_any(postings, terms, field), "id", "left_anti")


def match_phrase(positions: DataFrame, terms: list[str], field: str = "content",
                 postings: DataFrame | None = None) -> DataFrame:
    """Documents with the terms next to each other in this order.

    Every occurrence votes for the place where the phrase would start; a start
    with a vote for each place of the phrase is a match. With ``postings`` only
    occurrences in documents that hold all the terms are looked at. From the ``places`` of an index
    votes stay in arrays: a document's meet in one row, and a task holds numbers instead of groups.
    """
    if postings is not None:
        positions = positions.join(match_all(postings, terms, field), "id", "left_semi")
    places = F.create_map(*(
        x for t in sorted(set(terms))
        for x in (F.lit(t), F.array(*(F.lit(i) for i, u in enumerate(terms) if u == t)))))
    found = _field(positions, field).filter(F.col("term").isin(sorted(set(terms))))
    if "positions" in positions.columns:
        starts = F.flatten(F.transform(places[F.col("term")], lambda i: F.transform("positions", lambda at: at - i)))
        cast = found.select("id", starts.alias("_starts")).repartition("id").groupBy("id").agg(
            F.sort_array(F.flatten(F.collect_list("_starts"))).alias("_s"))
        n = F.greatest(F.size("_s") - (len(terms) - 1), F.lit(0))
        agreed = F.zip_with(F.slice("_s", 1, n), F.slice("_s", len(terms), n), lambda a, b: a == b)
        return cast.filter(F.exists(agreed, lambda same: same)).select("id")
    votes = (
        found.select("id", "position", F.explode(places[F.col("term")]).alias("_place"))
        .groupBy("id", (F.col("position") - F.col("_place")).alias("_start"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return votes.filter(F.col("_n") == len(terms)).select("id").distinct()


def _with_terms(postings: DataFrame, field: str, test: Column, dictionary: DataFrame | None) -> DataFrame:
    """Documents with a term that passes ``test``; with a dictionary its terms are tested, not the postings."""
    rows = _field(postings, field)
    if dictionary is None:
        return rows.filter(test).select("id").distinct()
    terms = _field(dictionary, field).filter(test).select("term")
    return rows.join(terms, "term", "left_semi").select("id").distinct()


def match_prefix(postings: DataFrame, prefix: str, field: str = "content",
                 dictionary: DataFrame | None = None) -> DataFrame:
    """Documents with a term that starts with ``prefix``; ``dictionary`` is the index's ``term_stats``."""
    return _with_terms(postings, field, F.col("term").startswith(prefix.lower()), dictionary)


def _like(pattern: str) -> str:
    """A SQL pattern for a wildcard."""
    quoted = pattern.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return quoted.replace("*", "%").replace("?", "_")


def match_wildcard(postings: DataFrame, pattern: str, field: str = "content",
                   dictionary: DataFrame | None = None, grams: DataFrame | None = None) -> DataFrame:
    """Documents with a term like ``pattern``, where ``*`` is any text and ``?`` any character.

    With ``grams`` (see :func:`pagetrawl.operators.index.term_grams`) only terms that hold the rarest
    three-letter piece of the pattern are tested; a pattern without one tests the whole dictionary.
    """
    test = F.col("term").like(_like(pattern))
    if grams is not None and (pieces := wildcard_grams(pattern)):
        # one row for each piece of the pattern
        asked = _field(grams, field).filter(F.col("gram").isin(pieces))
        counts = {r.gram: r["count"] for r in asked.groupBy("gram").count().collect()}
        rarest = min(pieces, key=lambda g: (counts.get(g, 0), g))
        dictionary = _field(grams, field).filter(F.col("gram") == rarest)
    return _with_terms(postings, field, test, dictionary)


def wildcard_grams(pattern: str) -> list[str]:
    """The three-letter pieces that every term like ``pattern`` has, its ends marked with ``^`` and ``$``."""
    stretches = f"^{pattern.lower()}$".replace("?", "*").split("*")
    return sorted({s[i:i + GRAM] for s in stretches for i in range(len(s) - GRAM + 1)})


def number_between(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows with a number in an inclusive range; an open end is None."""
    if low is not None:
        df = df.filter(F.col(column) >= low)
    if high is not None:
        df = df.filter(F.col(column) <= high)
    return df


# --- Ranking ---------------------------------------------------------------------------

#: Terms of the sets of terms that one pass over the texts takes along, as a broadcast; more make more passes.
PASS_TERMS = 200_000


def _idf(docs: Column) -> Column:
    return F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _bm25(docs: Column, average: Column) -> Column:
    tf, dl = F.col("tf"), F.col("dl")
    return _idf(docs) * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / average))


def _corpus(index: Index, field: str) -> tuple[Column, Column]:
    """Number of documents and average length, as scalar subqueries."""
    stored = index.corpus.filter(F.col("field") == field)
    return stored.select("docs").scalar(), stored.select("average").scalar()


def rank(index: Index, terms: list[str], k: int | None = None, field: str = "content") -> DataFrame:
    """``id, score`` of the documents with all terms, the best ``k`` by BM25.

    Ties go to the smaller id. Without ``k`` every match is returned, in no order.
    """
    wanted = sorted(set(terms))
    # One row per distinct term of the request, so always small enough to broadcast.
    stats = _field(index.term_stats, field).filter(F.col("term").isin(wanted)).select("term", "df")
    hits = _field(index.postings, field).filter(F.col("term").isin(wanted))
    docs, average = _corpus(index, field)
    scored = (
        hits.join(F.broadcast(stats), "term")
        .groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.sum(_bm25(docs, average)).alias("score"))
        .filter(F.col("_n") == len(wanted)).select("id", F.round("score", 6).alias("score"))
    )
    return scored.orderBy(F.desc("score"), "id").limit(k) if k else scored


def rank_structured(index: Index, must: list[str] = (), should: list[str] = (), must_not: list[str] = (),
                    phrases: list[list[str]] = (), prefixes: list[str] = (), k: int | None = None,
                    field: str = "content") -> DataFrame:
    """``id, score`` of documents by a structured query, best first with ``k``.

    A document needs all ``must`` terms, all ``phrases`` and a term for each prefix,
    and none of ``must_not``; with neither of the first three, one of ``should``. The
    score is the BM25 sum over the terms of ``must``, ``should`` and the phrases that it
    holds; a document that only a prefix matched has score 0.
    """
    needed = sorted({*must, *(t for p in phrases for t in p)})
    scoring = sorted({*needed, *should})
    stats = _field(index.term_stats, field).filter(F.col("term").isin(scoring)).select("term", "df")
    rows = _field(index.postings, field).filter(F.col("term").isin(scoring))
    docs, average = _corpus(index, field)
    found = rows.join(F.broadcast(stats), "term").groupBy("id").agg(
        F.count_if(F.col("term").isin(needed)).alias("_needed"), F.sum(_bm25(docs, average)).alias("score"))
    if needed:
        found = found.filter(F.col("_needed") == len(needed))
    elif prefixes:
        # with prefixes alone every document with one is a candidate
        every = match_prefix(index.postings, prefixes[0], field, index.term_stats)
        found = every.join(found, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    for phrase in phrases:
        found = found.join(match_phrase(index.positions, phrase, field, index.postings), "id", "left_semi")
    for prefix in prefixes:
        found = found.join(match_prefix(index.postings, prefix, field, index.term_stats), "id", "left_semi")
    if must_not:
        found = found.join(match_any(index.postings, must_not, field), "id", "left_anti")
    scored = found.select("id", F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k) if k else scored


def rank_batch(queries: DataFrame, index: Index, k: int | None = None,
               field: str = "content") -> DataFrame:
    """``query_id, id, score, rank`` for a table of queries ``query_id, q``.

    Queries with the same set of terms are answered once. The sets go to the texts (see :func:`match_sets`),
    so that nothing but scored matches is moved, and with ``k`` only the best of each task. Ranks
    start at 1; without ``k`` there is no rank.
    """
    signatures = _signatures(queries)
    sets = term_sets(signatures, index, field)
    scored = match_sets(sets, index, field)
    order = [F.desc("score"), F.asc("id")]
    ranked = top_n(scored, ["set"], order, k) if k else scored.withColumn("rank", F.lit(None).cast("int"))
    return salted_join(_asked_by(signatures, sets), ranked, "set", salt_by="query_id").select(
        "query_id", "id", "score", "rank")


def _signatures(queries: DataFrame) -> DataFrame:
    """``query_id, _key``: the sorted distinct terms of each query as one text."""
    return queries.select(
        "query_id", F.array_join(F.array_sort(F.array_distinct(analyse("q"))), " ").alias("_key"))


def term_sets(signatures: DataFrame, index: Index, field: str) -> DataFrame:
    """``set, key, terms`` of every distinct set of terms that the index knows all of, stored and numbered.

    ``terms`` has the ``df, term, idf`` of each term, the rarest first.
    """
    distinct = signatures.select("_key").filter("_key <> ''").distinct()
    terms = distinct.select("_key", F.explode(F.split("_key", " ")).alias("term"))
    asked = terms.select("term").distinct()
    stats = _field(index.term_stats, field).join(asked, "term", "left_semi").select("term", "df")
    docs, _ = _corpus(index, field)
    known = salted_join(terms, stats, "term", "left", salt_by="_key").withColumn("idf", _idf(docs))
    found = known.groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("df", "term", "idf"))).alias("terms"),
        F.count_if(F.col("df").isNull()).alias("_unknown"),
    ).filter("_unknown = 0")
    return stored_once(found.select(
        F.monotonically_increasing_id().alias("set"), F.col("_key").alias("key"), "terms"), "query-sets")


def _asked_by(signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """``query_id, set`` of the queries whose set of terms is in ``sets``."""
    return salted_join(
        signatures, sets.select(F.col("key").alias("_key"), "set"), "_key", salt_by="query_id").select("query_id", "set")


def match_sets(sets: DataFrame, index: Index, field: str, block: Column | None = None) -> DataFrame:
    """``set, id, score`` of the texts with all terms of a set of :func:`term_sets`.

    The sets are copied to the texts, about ``PASS_TERMS`` terms in one pass, and meet them through their rarest term.
    The next two terms are tested by hash within the join, then all of them on the text's own terms. No posting
    and no candidate is moved. With ``block``, an expression over ``id, dl``, a set has an array ``blocks`` and
    only texts in one of these count.
    """
    _, average = _corpus(index, field)
    weight = F.size("terms") + (F.size("blocks") if block is not None else F.lit(0))
    total = sets.agg(F.sum(weight)).first()[0] or 0
    passes = -(-total // PASS_TERMS)
    texts = _field(index.texts, field).select(
        "id", "dl", (BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / average)).alias("norm"),
        F.col("runs.term").alias("has"), F.col("runs.tf").alias("tfs"),
        F.transform("runs.term", lambda t: F.xxhash64(t)).alias("hashes"), (F.lit(0) if block is None else block).alias("_block"))
    first = F.get("terms", F.lit(0))
    nth = [F.get("terms", F.lit(i))["term"] for i in (1, 2)]
    wanted = sets.select(
        "set", first["term"].alias("lead"), first["idf"].alias("idf"),
        F.slice("terms", 2, F.greatest(F.size("terms"), F.lit(1))).alias("others"),
        *(F.when(t.isNotNull(), F.xxhash64(t)).alias(f"_h{i}") for i, t in enumerate(nth)),
        *([] if block is None else ["blocks"]))
    rows = texts.select("id", "norm", "has", "tfs", "hashes", "_block", F.posexplode("has").alias("_at", "lead"))
    test = F.lit(True)
    for i in range(len(nth)):
        test &= F.col(f"_h{i}").isNull() | F.array_contains(F.col("hashes"), F.col(f"_h{i}"))
    if block is not None:
        test &= F.array_contains(F.col("blocks"), F.col("_block"))

    def part(idf: Column, tf: Column) -> Column:
        return idf * tf * (BM25_K1 + 1) / (tf + F.col("norm"))

    # null if a term is not there
    score = F.aggregate(
        "others", part(F.col("idf"), F.get("tfs", F.col("_at"))),
        lambda so_far, o: so_far + part(o["idf"], F.get("tfs", F.array_position(F.col("has"), o["term"]).cast("int") - 1)))
    found = []
    for i in range(max(passes, 1)):
        asked = wanted.filter(F.pmod(F.xxhash64("set"), F.lit(max(passes, 1))) == i).withColumnRenamed("lead", "_lead")
        met = rows.join(F.broadcast(asked), (F.col("lead") == F.col("_lead")) & test)
        # numbered, because Spark would else move the filter into the join, which then runs without generated code
        # and copies the text's arrays for each of its terms
        numbered = met.select("set", "id", F.round(score, 6).alias("score"), F.monotonically_increasing_id().alias("_row"))
        found.append(numbered.filter(F.col("score").isNotNull() & (F.col("_row") >= 0)).drop("_row"))
    return reduce(DataFrame.unionByName, found)


# --- Filters on pages ------------------------------------------------------------------


def domain_filter(df: DataFrame, domain: str, whole_url: bool = False) -> DataFrame:
    """Pages whose host, or whole URL, contains ``domain`` in any case."""
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    if whole_url:
        return df.filter(url.contains(domain.lower().strip()))
    host = F.coalesce(F.lower(netloc("url")), url)
    return df.filter(host.contains(domain.lower()))


def date_filter(df: DataFrame, date_from=None, date_to=None) -> DataFrame:
    """Pages indexed in an inclusive epoch range; a missing time counts as 0."""
    time = F.coalesce(F.col("indexed_time"), F.lit(0.0))
    if date_from is not None:
        df = df.filter(time >= date_from)
    if date_to is not None:
        df = df.filter(time <= date_to)
    return df


def date_preset(df: DataFrame, preset: str, now, start=None, end=None) -> DataFrame:
    """Pages indexed within a date preset before ``now``."""
    return date_filter(df, *preset_bounds(preset, now, start, end))


def display_date_filter(df: DataFrame, preset: str, now, start=None, end=None) -> DataFrame:
    """A date preset on the display time; missing counts as 0, unreadable is dropped."""
    shown = falsy("indexed_at", F.lit(None))
    time = F.when(shown.isNull(), F.lit(0.0)).otherwise(parse_time("indexed_at"))
    low, high = preset_bounds(preset, now, start, end)
    if low is not None:
        df = df.filter(time >= low)
    if high is not None:
        df = df.filter(time <= high)
    return df


def min_backlinks(df: DataFrame, n: int) -> DataFrame:
    """Pages with at least ``n`` backlinks; missing counts as 0."""
    return df.filter(F.coalesce(F.col("backlinks"), F.lit(0)) >= n)


def substring_search(df: DataFrame, q: str) -> DataFrame:
    """Pages with ``q`` in title, content, snippet or URL, in any case."""
    return df.filter(
        contains_text("title", q) | contains_text("content", q)
        | contains_text("snippet", q) | contains_text("url", q))


def refine(df: DataFrame, q: str) -> DataFrame:
    """Results with ``q`` in title, snippet or URL; all of them if ``q`` is blank."""
    needle = q.strip()
    if not needle:
        return df
    return df.filter(contains_text("title", needle) | contains_text("snippet", needle) | contains_text("url", needle))


# --- Order, pages, projection ----------------------------------------------------------


def sort_order(by: str | None) -> list[Column]:
    """Sort keys of a sort name; ties keep relevance, an unknown name means relevance."""
    time = F.coalesce(F.col("indexed_time"), F.lit(0.0))
    keys = {
        "date_desc": [F.desc(time)],
        "date_asc": [F.asc(time)],
        "backlinks_desc": [F.desc(F.coalesce(F.col("backlinks"), F.lit(0)))],
        "likes_desc": [F.desc(F.coalesce(F.col("likes"), F.lit(0)))],
    }
    return keys.get(by, [])


def sort_hits(df: DataFrame, by: str | None = None) -> DataFrame:
    """Hits by a sort name, then by score if they have one, then by id."""
    relevance = [F.desc("score")] if "score" in df.columns else []
    return df.orderBy(*sort_order(by), *relevance, F.asc("id"))


def sort_local(df: DataFrame, by: str | None = "likes_desc") -> DataFrame:
    """Unranked pages by a sort name; relevance means most liked first."""
    return sort_hits(df, "likes_desc" if by in (None, "relevance") else by)


def paginate(df: DataFrame, page: int = 1, limit: int = PAGE_SIZE) -> DataFrame:
    """One page of sorted rows; pages start at 1."""
    return df.offset((page - 1) * limit).limit(limit)


#: The value that a sort name orders by, where a row has none.
_SORT_FIELDS = {"date_desc": ("indexed_time", 0.0), "date_asc": ("indexed_time", 0.0), "backlinks_desc": ("backlinks", 0), "likes_desc": ("likes", 0)}


def cursor_of(row, by: str | None = None) -> dict:
    """Where a row stands in the order of a sort name: what :func:`page_after` continues after."""
    fields = row.asDict()
    place = {n: fields[n] for n in ("score", "id") if n in fields}
    if by in _SORT_FIELDS:
        name, missing = _SORT_FIELDS[by]
        place["key"] = missing if fields[name] is None else fields[name]
    return place


def _later(value: Column, place, descending: bool) -> Column:
    """Rows behind a place in one sort key: nulls come last if it descends, else first, as Spark sorts them."""
    if place is None:
        return F.lit(False) if descending else value.isNotNull()
    return ((value < place) | value.isNull()) if descending else F.coalesce(value > place, F.lit(False))


def page_after(df: DataFrame, cursor: dict | None = None, by: str | None = None, limit: int = PAGE_SIZE) -> DataFrame:
    """The ``limit`` rows that follow ``cursor`` in the order of a sort name; the first ones without a cursor.

    Rows up to the cursor are left out by a condition, so that a page far behind costs no more than
    the first: each task keeps its own best ``limit`` rows and nothing is sorted as a whole. Ids are
    distinct; equal keys and scores go by id, so no row is shown twice or missed.
    """
    if cursor is not None:
        keys = [("id", F.col("id"), False)]
        if "score" in df.columns:
            keys.insert(0, ("score", F.col("score"), True))
        if by in _SORT_FIELDS:
            name, missing = _SORT_FIELDS[by]
            keys.insert(0, ("key", F.coalesce(F.col(name), F.lit(missing)), by != "date_asc"))
        after, level = F.lit(False), F.lit(True)
        for name, value, descending in keys:
            after = after | (level & _later(value, cursor[name], descending))
            level = level & value.eqNullSafe(F.lit(cursor[name]))
        df = df.filter(after)
    return sort_hits(df, by).limit(limit)


def search_after(index: Index, pages: DataFrame, q: str, cursor: dict | None = None, limit: int = PAGE_SIZE,
                 sort_by: str | None = None, **filters) -> DataFrame:
    """The rows of the answer to a query that follow ``cursor``, unprojected; see :func:`cursor_of`."""
    return page_after(hits(index, pages, q, **filters), cursor, sort_by, limit)


def top_liked(pages: DataFrame, n: int = PAGE_SIZE) -> DataFrame:
    """The most liked pages."""
    return sort_hits(pages, "likes_desc").limit(n)


def highlight(content, terms: list[str], around: int = 80) -> Column:
    """The text around the first match of any term as a whole word, with matches in bold."""
    either = "|".join(rf"\Q{t}\E" for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    either = rf"(?<![\p{{L}}\p{{N}}])(?:{either})(?![\p{{L}}\p{{N}}])"
    content = F.col(content) if isinstance(content, str) else content
    found = rf"(?ius)(.{{0,{around}}}(?:{either}).{{0,{around}}})"
    cut = F.regexp_extract(content, found, 1)
    if terms:
        # a plain search for the first match; only the text around it meets the pattern that steps back
        length = 2 * around + max(map(len, terms)) + 1

        def near(parts: Column) -> Column:
            start = F.greatest(F.char_length(F.get(parts, F.lit(0))) - around, F.lit(0)) + 1
            return F.when(F.size(parts) > 1, F.regexp_extract(F.substring(content, start, F.lit(length)), found, 1)).otherwise("")

        cut = F.when(content.isNotNull(), F.get(F.transform(F.array(F.split(content, f"(?iu){either}", 2)), near), F.lit(0)))
    return F.regexp_replace(cut, rf"(?iu)({either})", "<b>$1</b>")


def project_hits(df: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """The fields of a hit with their defaults."""
    fallback = highlight("content", terms) if terms and "content" in df.columns else F.lit("")
    return df.select(
        "id", "url", "title",
        falsy("snippet", fallback).alias("snippet"),
        F.coalesce("indexed_at", F.lit("")).alias("indexed_at"),
        F.coalesce("indexed_time", F.lit(0.0)).alias("indexed_time"),
        F.coalesce("backlinks", F.lit(0)).alias("backlinks"),
        *([c for c in ("score",) if c in df.columns]),
    )


def _filtered(df: DataFrame, domain, date_from, date_to, min_links) -> DataFrame:
    if domain:
        df = domain_filter(df, domain)
    df = date_filter(df, date_from, date_to)
    return df if min_links is None else min_backlinks(df, min_links)


def hits(index: Index, pages: DataFrame, q: str, domain: str | None = None, date_from=None, date_to=None,
         min_links: int | None = None, candidate_cap: int | None = None) -> DataFrame:
    """All filtered matches of a query with their page and score, unordered.

    The filters apply first and no match is lost. With ``candidate_cap`` (the usual
    one is ``CANDIDATE_CAP``) only that many best matches reach the filters.
    """
    ranked = rank(index, analyse_literal(q), candidate_cap)
    if candidate_cap:
        return _filtered(pages.join(ranked, "id"), domain, date_from, date_to, min_links)
    return _filtered(pages, domain, date_from, date_to, min_links).join(ranked, "id")


def total_hits(df: DataFrame) -> DataFrame:
    """One row ``total``."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def search(index: Index, pages: DataFrame, q: str, page: int = 1, limit: int = PAGE_SIZE,
           sort_by: str | None = None, **filters) -> DataFrame:
    """One page of the ranked, filtered and sorted answer to a query."""
    found = hits(index, pages, q, **filters)
    return project_hits(paginate(sort_hits(found, sort_by), page, limit), analyse_literal(q))


def search_batch(queries: DataFrame, index: Index, pages: DataFrame, page: int = 1, limit: int = PAGE_SIZE,
                 sort_by: str | None = None, candidate_cap: int | None = None,
                 domain: str | None = None, date_from=None, date_to=None,
                 min_links: int | None = None) -> DataFrame:
    """One page of the answer to every query, with its ``position`` in the answer.

    Only the keys that filters and order need meet the ranked rows; the other
    page fields can be joined to the few rows of the result.
    """
    ranked = rank_batch(queries, index, candidate_cap)
    # as in the other searches, an id that the index holds more than once has no terms counted right and is no hit
    several = pages.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("id")
    ranked = ranked.join(several, "id", "left_anti")
    keys = [c for c in ("id", "url", "indexed_time", "backlinks", "likes") if c in pages.columns]
    found = salted_join(ranked, pages.select(*keys), "id", salt_by="query_id")
    found = _filtered(found, domain, date_from, date_to, min_links)
    order = [*sort_order(sort_by), F.desc("score"), F.asc("id")]
    return top_n(found, ["query_id"], order, limit, "position", (page - 1) * limit)


def totals_batch(queries: DataFrame, index: Index, field: str = "content") -> DataFrame:
    """``query_id, total`` of every query, 0 if nothing matches.

    Documents are counted once for each set of terms, where the texts are, and the
    counts then go to the queries.
    """
    signatures = _signatures(queries)
    sets = term_sets(signatures, index, field)
    counted = match_sets(sets, index, field).groupBy("set").agg(F.count(F.lit(1)).alias("total"))
    totals = counted.join(sets.select("set", F.col("key").alias("_key")), "set").select("_key", "total")
    return salted_join(signatures, totals, "_key", "left", salt_by="query_id").select(
        "query_id", F.coalesce("total", F.lit(0)).alias("total"))
