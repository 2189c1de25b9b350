"""Index, search, spelling and page filter queries."""

from pyspark.sql import functions as F

from checks import bindings as B
from pagetrawl.functions.html import extract_title
from pagetrawl.functions.text import words
from pagetrawl.functions.times import asctime
from pagetrawl.operators import index as I
from pagetrawl.operators import pairs as N
from pagetrawl.operators import search as S
from pagetrawl.operators import spell as P
from pagetrawl.operators import topk as K


def _index(spark, sf):
    return I.build_index(B.corpus(spark, sf))


def term_stats(spark, sf):
    return _index(spark, sf).term_stats.select("term", "df", "cf")


def doc_len(spark, sf):
    return _index(spark, sf).doc_len.select("id", F.col("dl").cast("bigint"))


def postings(spark, sf):
    return _index(spark, sf).postings.select("id", "term", F.col("dl").cast("bigint"), F.col("tf").cast("bigint"))


def positions(spark, sf):
    return _index(spark, sf).positions.select("id", "term", F.col("position").cast("bigint"))


def field_terms(spark, sf):
    """Terms per field of the pages, as a fielded index counts them; the versions of a URL are one document."""
    return I.term_stats(I.postings(B.pages(spark, sf), ("title", "snippet")), versions=True)


def match_all(spark, sf):
    return S.match_all(_index(spark, sf).postings, ["was", "ther"])


def match_any(spark, sf):
    return S.match_any(_index(spark, sf).postings, ["de", "ther"])


def match_none(spark, sf):
    docs = B.corpus(spark, sf)
    return S.match_none(docs, I.postings(docs), ["de", "ther"])


def match_phrase(spark, sf):
    return S.match_phrase(B.index(spark, sf).places, ["de", "la"])


def match_phrase_repeated(spark, sf):
    index = B.index(spark, sf)
    return S.match_phrase(index.places, ["de", "la", "de"], postings=index.postings)


def match_phrase_frequent(spark, sf):
    """A phrase of frequent terms, found among stored pairs of neighbours."""
    index = B.index(spark, sf)
    path = B.stored(spark, sf, "pairs", lambda to: N.write_pairs(B.corpus(spark, sf), index, to))
    return N.match_phrase_pairs(index, N.read_pairs(index, path), ["de", "la", "de"])


def match_prefix(spark, sf):
    index = B.index(spark, sf)
    return S.match_prefix(index.postings, "theat", dictionary=index.term_stats)


def match_wildcard(spark, sf):
    index = B.index(spark, sf)
    return S.match_wildcard(index.postings, "th?a*tion", dictionary=index.term_stats)


def match_wildcard_infix(spark, sf):
    """A wildcard at both ends, through the pieces of the terms."""
    index = B.index(spark, sf)
    path = B.stored(spark, sf, "grams", lambda to: I.write_term_grams(index.term_stats, to))
    return S.match_wildcard(index.postings, "*heati*n*", grams=spark.read.parquet(path))


def match_field(spark, sf):
    """Pages with a term in the title; each version of a URL has its own title."""
    table = I.postings(B.versions(spark, sf), ("title", "snippet", "content"))
    return S.match_all(table, ["th"], field="title").select("id.id")


def number_range(spark, sf):
    return S.number_between(B.scored_pages(spark, sf), "backlinks", 2, 4).select("id", "backlinks")


def rank_bm25(spark, sf):
    return S.rank(B.index(spark, sf), ["was", "ther"])


def rank_structured(spark, sf):
    """A must, a phrase, a prefix, optional and forbidden terms in one query."""
    return S.rank_structured(B.index(spark, sf), must=["la"], should=["en", "es"], must_not=["por"],
                             phrases=[["de", "la"]], prefixes=["ci"])


def rank_all(spark, sf):
    return S.rank(B.index(spark, sf), ["en", "de"], None)


def rank_batch(spark, sf):
    ranked = S.rank_batch(B.title_queries(spark, sf), B.index(spark, sf), 20)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def _blocks(spark, sf):
    index = B.index(spark, sf)
    return K.read_blocks(index, B.stored(spark, sf, "blocks", lambda to: K.write_blocks(index.postings, to, 4)))


def rank_top(spark, sf):
    """The best 50 documents with two frequent terms; blocks of documents below the 50th score are not read."""
    return K.rank_top(B.index(spark, sf), _blocks(spark, sf), ["en", "de"], 50)


def rank_batch_top(spark, sf):
    """The best 20 documents of every page title, by bounds of blocks."""
    ranked = K.rank_batch_top(B.title_queries(spark, sf), B.index(spark, sf), _blocks(spark, sf), 20)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))


def rank_passages(spark, sf):
    """Documents that hold every term of a benchmark passage."""
    asked = B.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return S.rank_batch(asked, B.index(spark, sf)).select("query_id", "id", "score")


def search_batch(spark, sf):
    found = S.search_batch(
        B.title_queries(spark, sf), B.page_index(spark, sf), B.scored_pages(spark, sf), page=1, limit=10,
        sort_by="backlinks_desc", min_links=1)
    return found.select("query_id", "id", "score", "backlinks", F.col("position").cast("bigint"))


def index_appended(spark, sf):
    """The index written as two batches, by language, and read as one."""
    docs = B.table(spark, sf, "documents")

    def write(to):
        for batch, part in enumerate((docs.filter("lang = 'en'"), docs.filter("lang <> 'en'"))):
            texts = part.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
            I.append_index(texts, to, batch, ("content",))

    both = I.read_appended_index(spark, B.stored(spark, sf, "appended-index", write))
    return S.rank(both, ["was", "ther"])


def _refreshed(spark, sf):
    """Half the documents indexed with other words, then all as they are, and that batch once more."""
    docs = B.corpus(spark, sf)

    def write(to):
        old = docs.filter("id % 2 = 0").select("id", F.concat(F.lit("was missing ther "), F.reverse("content")).alias("content"))
        for batch, pages in ((0, old), (1, docs), (1, docs)):
            I.append_index(pages, to, batch, ("content",))

    return B.stored(spark, sf, "refreshed-index", write)


def index_refreshed(spark, sf):
    """Postings, document frequency and scores after every other page was replaced."""
    index = I.read_appended_index(spark, _refreshed(spark, sf))
    found = index.postings.filter("term = 'was'").select("id", "term", F.col("tf").cast("bigint"))
    return found.join(index.term_stats, "term").join(S.rank(index, ["was", "ther"]), "id", "left").select(
        "id", "tf", "df", "score")


def index_statistics(spark, sf):
    """Statistics of every term after half the pages were replaced, added up from the batches' changes."""
    index = I.read_appended_index(spark, _refreshed(spark, sf))
    corpus = index.corpus.select("field", "docs", F.round("average", 9).alias("average"))
    return index.term_stats.join(F.broadcast(corpus), "field").select("term", "df", "cf", "docs", "average")


def index_compacted(spark, sf):
    path = B.stored(spark, sf, "compacted-index", lambda to: I.compact_index(spark, _refreshed(spark, sf), to))
    return S.rank(I.read_index(spark, path), ["was", "ther"])


def totals_batch(spark, sf):
    return S.totals_batch(B.title_queries(spark, sf), B.index(spark, sf))


def _hits(spark, sf, **options):
    return S.hits(B.page_index(spark, sf), B.scored_pages(spark, sf), "th of re", **options)


def search(spark, sf):
    texts = B.pages(spark, sf)
    pages = texts.drop("url", "content").join(B.scored_pages(spark, sf), "id")
    found = S.search(B.page_index(spark, sf), pages, "th of re", page=2, limit=5, sort_by="date_desc",
                     domain="example", min_links=1)
    return found.select("id", "url", "title", "snippet", "indexed_time", "backlinks", "score")


def search_capped(spark, sf):
    """The filter after a cap of 20 candidates, which loses hits on purpose."""
    return _hits(spark, sf, min_links=3, candidate_cap=20).select("id", "score")


def total_hits(spark, sf):
    return S.total_hits(_hits(spark, sf, min_links=2))


def domain_filter(spark, sf):
    return S.domain_filter(B.raw(spark, sf), "Example.ORG").select("url")


def domain_filter_whole_url(spark, sf):
    return S.domain_filter(B.raw(spark, sf), " Page=2 ", whole_url=True).select("url")


def date_filter(spark, sf):
    keys = B.page_keys(spark, sf)
    return S.date_filter(keys, keys.select(F.avg("indexed_time")).scalar()).select("id", "indexed_time")


def date_preset(spark, sf):
    keys = B.page_keys(spark, sf)
    return S.date_preset(keys, "7d", keys.select(F.max("indexed_time")).scalar()).select("id", "indexed_time")


def display_date_filter(spark, sf):
    keys = B.page_keys(spark, sf).withColumn("indexed_at", asctime("indexed_time"))
    last = keys.select(F.max("indexed_time")).scalar()
    return S.display_date_filter(keys, "24h", last).select("id", "indexed_at")


def display_date_custom(spark, sf):
    keys = B.page_keys(spark, sf).withColumn("indexed_at", asctime("indexed_time"))
    return S.display_date_filter(keys, "custom", 0, "2024-01-03", "2024-01-09").select("id", "indexed_at")


def min_backlinks(spark, sf):
    return S.min_backlinks(B.scored_pages(spark, sf), 3).select("id", "backlinks")


def substring_search(spark, sf):
    return S.substring_search(B.pages(spark, sf), "Ther On").select("id", "url")


def refine(spark, sf):
    return S.refine(B.pages(spark, sf), " THEA ").select("id", "title")


def _top(spark, sf, by):
    found = S.paginate(S.sort_hits(B.scored_pages(spark, sf), by), 2, 25)
    return found.select("id", "indexed_time", "backlinks", "likes")


def sort_date_desc(spark, sf):
    return _top(spark, sf, "date_desc")


def sort_date_asc(spark, sf):
    return _top(spark, sf, "date_asc")


def sort_backlinks_desc(spark, sf):
    return _top(spark, sf, "backlinks_desc")


def sort_likes_desc(spark, sf):
    return _top(spark, sf, "likes_desc")


def sort_unknown(spark, sf):
    return _top(spark, sf, "nonsense")


def sort_local(spark, sf):
    return S.paginate(S.sort_local(B.scored_pages(spark, sf), "relevance"), 1, 10).select("id", "likes")


def top_liked(spark, sf):
    return S.top_liked(B.scored_pages(spark, sf)).select("id", "likes")


def paginate(spark, sf):
    return S.paginate(S.sort_hits(B.page_keys(spark, sf)), 3, 10).select("id", "url")


def page_after(spark, sf):
    """The third page of the most linked pages, found from the last row of the second."""
    pages = B.scored_pages(spark, sf)
    cursor = None
    for _ in range(2):
        cursor = S.cursor_of(S.page_after(pages, cursor, "backlinks_desc").collect()[-1], "backlinks_desc")
    return S.page_after(pages, cursor, "backlinks_desc").select("id", "backlinks")


def highlight(spark, sf):
    cut = B.corpus(spark, sf).select("id", S.highlight("content", ["ther", "de"]).alias("snippet"))
    return cut.filter("snippet <> ''")


def project_hits(spark, sf):
    bare = B.scored_pages(spark, sf).select(
        "id", "url", F.col("url").alias("title"), F.lit(None).cast("string").alias("snippet"),
        F.lit(None).cast("string").alias("indexed_at"), "indexed_time", F.nullif("backlinks", F.lit(0)).alias("backlinks"))
    return S.project_hits(bare)


def _vocabulary(spark, sf):
    return B.index(spark, sf).term_stats.select("term", "df")


def _lower_titles(spark, sf):
    return B.raw(spark, sf).select(
        F.col("page_id").alias("query_id"), F.lower(extract_title("html", "url")).alias("q"))


def suggest(spark, sf):
    asked = _lower_titles(spark, sf).select(F.explode(words("q")).alias("word"))
    found = P.suggest(asked, _vocabulary(spark, sf))
    return found.select(
        "word", "term", F.col("distance").cast("bigint"), "df", F.col("rank").cast("bigint"))


def spell_correct(spark, sf):
    return P.spell_correct(_lower_titles(spark, sf), _vocabulary(spark, sf))


def spell_correct_always(spark, sf):
    """Known words too give way to their best neighbour."""
    return P.spell_correct(_lower_titles(spark, sf), _vocabulary(spark, sf), keep_known=False)


def prefix_suggest(spark, sf):
    pool = B.pages(spark, sf).select(F.col("title").alias("phrase")).distinct()
    return P.prefix_suggest(pool, "the")


QUERIES = {f.__name__: f for f in (
    term_stats, doc_len, postings, positions, field_terms, match_all, match_any, match_none, match_phrase,
    match_phrase_repeated, match_phrase_frequent, match_prefix, match_wildcard, match_wildcard_infix, match_field, number_range, rank_bm25, rank_all, rank_batch,
    rank_structured, rank_passages, rank_top, rank_batch_top, index_appended, index_refreshed, index_statistics, index_compacted, search_batch, totals_batch, search, search_capped, total_hits, domain_filter,
    domain_filter_whole_url, date_filter, date_preset, display_date_filter, display_date_custom, min_backlinks,
    substring_search, refine, sort_date_desc, sort_date_asc, sort_backlinks_desc, sort_likes_desc, sort_unknown,
    sort_local, top_liked, paginate, page_after, highlight, project_hits, suggest, spell_correct, spell_correct_always,
    prefix_suggest)}

_C = B.CORPUS_SQL
# The pages as corpus: the same tables over their text.
_PC = B.PAGES_SQL + "," + B.CORPUS_SQL.replace(
    "doc_id AS id", "id").replace("(text)", "(content)").replace("FROM documents", "FROM p")
_SCORED = B.SCORED_SQL.replace("p AS (", "pk AS (").replace("FROM p LEFT", "FROM pk p LEFT")


def _queries_sql(table: str, key: str, text: str) -> str:
    return f"""qt AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM (
        SELECT {key} AS query_id, list_distinct({B.terms_sql(text)}) AS terms FROM {table}))"""


_TITLES = f"tq AS (SELECT page_id, {B.TITLE} AS q FROM pages), " + _queries_sql("tq", "page_id", "q")
_MATCHED = f"""sc AS (SELECT query_id, id, round(sum({B.BM25_SQL}), 6) AS score
    FROM qt JOIN ts USING (term) JOIN po USING (term) JOIN dl USING (id)
    GROUP BY query_id, id, n HAVING count(*) = n)"""
_RANKED = """rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc)"""


def _one_query(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""sc AS (SELECT id, round(sum({B.BM25_SQL}), 6) AS score
        FROM po JOIN ts USING (term) JOIN dl USING (id) WHERE term IN ({listed})
        GROUP BY id HAVING count(*) = {len(terms)})"""


def _sorted(by: str, offset: int = 25, n: int = 25) -> str:
    return (f"WITH {B.SCORED_SQL} SELECT id, indexed_time, backlinks, likes FROM s "
            f"ORDER BY {by} LIMIT {n} OFFSET {offset}")


# Letters outside ASCII in the tables, mapped one to one to capitals for an edit
# distance that counts bytes; all compared texts are in lower case.
_LETTERS = "àáâäçèéêëíîïñóôöùúûüß"
_PLAIN = f"""translate({{0}}, '{_LETTERS}', '{"ABCDEFGHIJKLMNOPQRSTU"[:len(_LETTERS)]}')"""
_VOCABULARY = f"vo AS (SELECT term, df, length(term) AS l, {_PLAIN.format('term')} AS flat FROM ts)"
_LOWER = f"lt AS (SELECT page_id AS query_id, lower({B.TITLE}) AS q FROM pages)"
_ASKED = r"""wd AS (SELECT query_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (
    SELECT query_id, list_filter(string_split_regex(q, '[\s\p{Z}]+'), lambda x: x <> '') AS w FROM lt))"""


def _suggested(words_from: str) -> str:
    return f"""ak AS (SELECT word, length(word) AS m, {_PLAIN.format('word')} AS flat
        FROM (SELECT DISTINCT word FROM {words_from})),
        cl AS (SELECT word, term, df, levenshtein(ak.flat, vo.flat) AS distance
        FROM ak JOIN vo ON l BETWEEN m - 2 AND m + 2 AND word <> term AND levenshtein(ak.flat, vo.flat) <= 2),
        sg AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) AS rank FROM cl)"""


_CORRECTED = """SELECT query_id, q, CASE WHEN bool_or(b.term IS NOT NULL)
    THEN string_agg(coalesce(b.term, wd.word), ' ' ORDER BY pos) END AS correction
    FROM lt LEFT JOIN wd USING (query_id) LEFT JOIN (SELECT * FROM sg WHERE rank = 1) b ON b.word = wd.word
    GROUP BY query_id, q"""

SQL = {
    "term_stats": f"WITH {_C} SELECT * FROM ts",
    "doc_len": f"WITH {_C} SELECT id, dl FROM dl",
    "postings": f"WITH {_C} SELECT id, term, dl, tf FROM po JOIN dl USING (id)",
    "positions": f"WITH {_C} SELECT id, term, pos AS position FROM tk",
    "field_terms": f"""WITH {B.PAGES_SQL}, f AS (
        SELECT id, 'title' AS field, unnest({B.terms_sql('title')}) AS term FROM p
        UNION ALL SELECT id, 'snippet', unnest({B.terms_sql('snippet')}) FROM p)
        SELECT field, term, count(DISTINCT id) AS df, count(*) AS cf FROM f GROUP BY ALL""",
    "match_all": f"""WITH {_C} SELECT id FROM po WHERE term IN ('was', 'ther') GROUP BY id HAVING count(*) = 2""",
    "match_any": f"WITH {_C} SELECT DISTINCT id FROM po WHERE term IN ('de', 'ther')",
    "match_none": f"""WITH {_C} SELECT doc_id AS id FROM documents
        WHERE doc_id NOT IN (SELECT id FROM po WHERE term IN ('de', 'ther'))""",
    "match_phrase": f"""WITH {_C} SELECT DISTINCT a.id FROM tk a JOIN tk b ON a.id = b.id AND b.pos = a.pos + 1
        WHERE a.term = 'de' AND b.term = 'la'""",
    "match_phrase_repeated": f"""WITH {_C} SELECT DISTINCT a.id FROM tk a
        JOIN tk b ON a.id = b.id AND b.pos = a.pos + 1 JOIN tk c ON a.id = c.id AND c.pos = a.pos + 2
        WHERE a.term = 'de' AND b.term = 'la' AND c.term = 'de'""",
    "match_phrase_frequent": f"""WITH {_C} SELECT DISTINCT a.id FROM tk a
        JOIN tk b ON a.id = b.id AND b.pos = a.pos + 1 JOIN tk c ON a.id = c.id AND c.pos = a.pos + 2
        WHERE a.term = 'de' AND b.term = 'la' AND c.term = 'de'""",
    "match_prefix": f"WITH {_C} SELECT DISTINCT id FROM po WHERE starts_with(term, 'theat')",
    "match_wildcard_infix": f"WITH {_C} SELECT DISTINCT id FROM po WHERE term LIKE '%heati%n%'",
    "match_wildcard": f"WITH {_C} SELECT DISTINCT id FROM po WHERE term LIKE 'th_a%tion'",
    "match_field": f"WITH {B.PAGES_SQL} SELECT id FROM p WHERE list_contains({B.terms_sql('title')}, 'th')",
    "number_range": f"WITH {B.SCORED_SQL} SELECT id, backlinks FROM s WHERE backlinks BETWEEN 2 AND 4",
    "rank_bm25": f"WITH {_C}, {_one_query(['was', 'ther'])} SELECT * FROM sc",
    "index_appended": f"WITH {_C}, {_one_query(['was', 'ther'])} SELECT * FROM sc",
    "index_statistics": f"""WITH {_C} SELECT term, df, cf, (SELECT count(*) FROM dl) AS docs,
        round((SELECT avg(dl) FROM dl), 9) AS average FROM ts""",
    "index_refreshed": f"""WITH {_C}, {_one_query(['was', 'ther'])}
        SELECT po.id, tf, df, score FROM po JOIN ts USING (term) LEFT JOIN sc ON sc.id = po.id WHERE term = 'was'""",
    "index_compacted": f"WITH {_C}, {_one_query(['was', 'ther'])} SELECT * FROM sc",
    "rank_structured": f"""WITH {_C}, m AS (
        SELECT id, round(sum({B.BM25_SQL}), 6) AS score FROM po JOIN ts USING (term) JOIN dl USING (id)
        WHERE term IN ('la', 'de', 'en', 'es') GROUP BY id HAVING count(*) FILTER (term IN ('la', 'de')) = 2)
        SELECT id, score FROM m WHERE id NOT IN (SELECT id FROM po WHERE term = 'por')
        AND id IN (SELECT id FROM po WHERE starts_with(term, 'ci'))
        AND id IN (SELECT a.id FROM tk a JOIN tk b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'de' AND b.term = 'la')""",
    "rank_all": f"WITH {_C}, {_one_query(['en', 'de'])} SELECT * FROM sc",
    "rank_batch": f"WITH {_C}, {_TITLES}, {_MATCHED}, {_RANKED} SELECT * FROM rk WHERE rank <= 20",
    "rank_top": f"WITH {_C}, {_one_query(['en', 'de'])} SELECT * FROM sc ORDER BY score DESC, id LIMIT 50",
    "rank_batch_top": f"WITH {_C}, {_TITLES}, {_MATCHED}, {_RANKED} SELECT * FROM rk WHERE rank <= 20",
    "rank_passages": f"""WITH {_C}, {_queries_sql('benchmark', 'item_id', 'text')}, {_MATCHED}, {_RANKED}
        SELECT query_id, id, score FROM rk""",
    "search_batch": f"""WITH {_PC}, {_SCORED}, {_TITLES}, {_MATCHED}, {_RANKED},
        fl AS (SELECT query_id, id, score, backlinks, row_number() OVER (
            PARTITION BY query_id ORDER BY backlinks DESC, score DESC, id) AS position
          FROM rk JOIN s USING (id) WHERE backlinks >= 1)
        SELECT * FROM fl WHERE position <= 10""",
    "totals_batch": f"""WITH {_C}, {_TITLES}, {_MATCHED} SELECT page_id AS query_id, count(sc.id) AS total
        FROM pages LEFT JOIN sc ON sc.query_id = pages.page_id GROUP BY ALL""",
    "search": f"""WITH {_PC}, {_SCORED}, {_one_query(['th', 're'])},
        SELECT id, s.url, title, snippet, s.indexed_time, backlinks, score
        FROM sc JOIN s USING (id) JOIN p USING (id)
        WHERE contains(lower(regexp_extract(s.url, '://([^/?#]*)', 1)), 'example') AND backlinks >= 1
        ORDER BY s.indexed_time DESC, score DESC, id LIMIT 5 OFFSET 5""",
    "search_capped": f"""WITH {_PC}, {_SCORED}, {_one_query(['th', 're'])},
        cd AS (SELECT * FROM sc ORDER BY score DESC, id LIMIT 20)
        SELECT id, score FROM cd JOIN s USING (id) WHERE backlinks >= 3""",
    "total_hits": f"""WITH {_PC}, {_SCORED}, {_one_query(['th', 're'])}
        SELECT count(*) AS total FROM sc JOIN s USING (id) WHERE backlinks >= 2""",
    "domain_filter": "SELECT url FROM pages WHERE contains(lower(regexp_extract(url, '://([^/?#]*)', 1)), 'example.org')",
    "domain_filter_whole_url": "SELECT url FROM pages WHERE contains(lower(url), 'page=2')",
    "date_filter": f"""WITH {B.KEYS_SQL} SELECT id, indexed_time FROM p
        WHERE indexed_time >= (SELECT avg(indexed_time) FROM p)""",
    "date_preset": f"""WITH {B.KEYS_SQL} SELECT id, indexed_time FROM p
        WHERE indexed_time >= (SELECT max(indexed_time) FROM p) - 7*86400""",
    "display_date_filter": f"""WITH {B.KEYS_SQL}, a AS (SELECT *, make_timestamp(CAST(indexed_time AS BIGINT)*1000000) AS ts FROM p)
        SELECT id, strftime(ts, '%a %b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S %Y') AS indexed_at
        FROM a WHERE indexed_time >= (SELECT max(indexed_time) FROM p) - 86400""",
    "display_date_custom": f"""WITH {B.KEYS_SQL}, a AS (SELECT *, make_timestamp(CAST(indexed_time AS BIGINT)*1000000) AS ts FROM p)
        SELECT id, strftime(ts, '%a %b ') || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S %Y') AS indexed_at
        FROM a WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-09'""",
    "min_backlinks": f"WITH {B.SCORED_SQL} SELECT id, backlinks FROM s WHERE backlinks >= 3",
    "substring_search": f"""WITH {B.PAGES_SQL} SELECT id, url FROM p WHERE contains(lower(title), 'ther on')
        OR contains(lower(content), 'ther on') OR contains(lower(snippet), 'ther on') OR contains(lower(url), 'ther on')""",
    "refine": f"""WITH {B.PAGES_SQL} SELECT id, title FROM p WHERE contains(lower(title), 'thea')
        OR contains(lower(snippet), 'thea') OR contains(lower(url), 'thea')""",
    "sort_date_desc": _sorted("indexed_time DESC, id"),
    "sort_date_asc": _sorted("indexed_time, id"),
    "sort_backlinks_desc": _sorted("backlinks DESC, id"),
    "sort_likes_desc": _sorted("coalesce(likes, 0) DESC, id"),
    "sort_unknown": _sorted("id"),
    "sort_local": f"""WITH {B.SCORED_SQL} SELECT id, likes FROM s ORDER BY coalesce(likes, 0) DESC, id LIMIT 10""",
    "top_liked": f"""WITH {B.SCORED_SQL} SELECT id, likes FROM s ORDER BY coalesce(likes, 0) DESC, id LIMIT 10""",
    "page_after": f"""WITH {B.SCORED_SQL} SELECT id, backlinks FROM s ORDER BY backlinks DESC, id LIMIT 10 OFFSET 20""",
    "paginate": f"WITH {B.KEYS_SQL} SELECT id, url FROM p ORDER BY id LIMIT 10 OFFSET 20",
    "highlight": r"""WITH c AS (SELECT doc_id AS id, regexp_extract(text,
        '(?is)((?:.{0,79}[^\p{L}\p{N}]|^)(?:ther|de)(?:[^\p{L}\p{N}].{0,79}|$))', 1) AS cut FROM documents)
        SELECT id, array_to_string(list_transform(regexp_extract_all(cut, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'),
            lambda w: CASE WHEN lower(w) IN ('ther', 'de') THEN '<b>' || w || '</b>' ELSE w END), '') AS snippet
        FROM c WHERE cut <> ''""",
    "project_hits": f"""WITH {B.SCORED_SQL} SELECT id, url, url AS title, '' AS snippet, '' AS indexed_at, indexed_time,
        backlinks FROM s""",
    "suggest": f"""WITH {_C}, {_VOCABULARY}, {_LOWER}, {_ASKED}, {_suggested('wd')}
        SELECT word, term, distance, df, rank FROM sg WHERE rank <= 5""",
    "spell_correct": f"""WITH {_C}, {_VOCABULARY}, {_LOWER}, {_ASKED},
        un AS (SELECT word FROM wd WHERE word NOT IN (SELECT term FROM ts)), {_suggested('un')} {_CORRECTED}""",
    "spell_correct_always": f"""WITH {_C}, {_VOCABULARY}, {_LOWER}, {_ASKED}, {_suggested('wd')} {_CORRECTED}""",
    "prefix_suggest": f"""SELECT DISTINCT phrase FROM (SELECT {B.TITLE} AS phrase FROM pages)
        WHERE starts_with(lower(phrase), 'the')""",
}
