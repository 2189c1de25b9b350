"""Search, ranking, spelling and image queries against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pagetrawl.functions.text import analyse, analyse_literal
from pagetrawl.operators import images as I
from pagetrawl.operators import index as X
from pagetrawl.operators import search as S
from pagetrawl.operators import spell as P
from pagetrawl.plans import skew
from pagetrawl.plans.lineage import new_folder


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(params=["cold", "hot"])
def heat(request, monkeypatch):
    if request.param == "hot":
        monkeypatch.setattr(skew.hot_of, "__defaults__", (1,))
        monkeypatch.setattr(skew.hot_keys, "__defaults__", (1,))


TEXTS = ["red fox red dog", "blue fox", "red dog and the red fox jumps", "nothing", "", "fox red dog red fox"]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string")


@pytest.fixture(scope="module")
def index(corpus):
    return X.build_index(corpus)


def bm25(terms):
    docs = [analyse_literal(t) for t in TEXTS]
    average = sum(map(len, docs)) / len(docs)
    scores = {}
    for i, doc in enumerate(docs):
        if all(t in doc for t in terms):
            score = 0
            for t in terms:
                df, tf = sum(t in d for d in docs), doc.count(t)
                idf = math.log(1 + (len(docs) - df + .5) / (df + .5))
                score += idf * tf * 2.2 / (tf + 1.2 * (.25 + .75 * len(doc) / average))
            scores[i] = round(score, 6)
    return sorted(((i, s) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))


def test_analyser(spark):
    text = "The Fox's 2nd É-mail, x an ON_line"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(analyse("t")).first()[0] == analyse_literal(text) == ["fox", "2nd", "mail", "line"]


def test_rank(index):
    assert rows(S.rank(index, ["red", "fox"], 10)) == bm25(["red", "fox"])
    assert sorted(rows(S.rank(index, ["red", "fox"]))) == sorted(bm25(["red", "fox"]))
    assert rows(S.rank(index, ["red", "fox"], 1)) == bm25(["red", "fox"])[:1]
    assert rows(S.rank(index, ["absent", "fox"])) == []


def test_rank_batch(spark, heat, index):
    asked = {1: "Red fox", 2: "fox RED red", 3: "absent fox", 4: "", 5: "fox", 6: "the"}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, q string")
    got = {}
    for query, doc, score, rank in sorted(rows(S.rank_batch(queries, index, 200))):
        got.setdefault(query, []).append((rank, doc, score))
    expected = {q: [(n + 1, *hit) for n, hit in enumerate(bm25(t))] for q, t in {
        1: ["red", "fox"], 2: ["red", "fox"], 5: ["fox"]}.items()}
    assert {q: sorted(h) for q, h in got.items()} == expected
    assert sorted(rows(S.totals_batch(queries, index))) == [(1, 3), (2, 3), (3, 0), (4, 0), (5, 4), (6, 0)]


def test_match(index, corpus):
    p = index.postings
    assert sorted(rows(S.match_all(p, ["red", "dog"]))) == [(0,), (2,), (5,)]
    assert sorted(rows(S.match_any(p, ["blue", "nothing"]))) == [(1,), (3,)]
    assert sorted(rows(S.match_none(corpus, p, ["red", "blue"]))) == [(3,), (4,)]
    assert sorted(rows(S.match_phrase(index.positions, ["red", "fox"]))) == [(0,), (2,), (5,)]
    assert sorted(rows(S.match_phrase(index.positions, ["red", "dog", "red"]))) == [(2,), (5,)]
    assert sorted(rows(S.match_phrase(index.positions, ["fox", "red", "dog", "red", "fox"]))) == [(5,)]
    assert sorted(rows(S.match_prefix(p, "JU"))) == [(2,)]
    assert sorted(rows(S.match_wildcard(p, "?o*"))) == [(0,), (1,), (2,), (3,), (5,)]


def test_written_index(spark, corpus, index):
    path = new_folder(spark, "index")
    X.write_index(corpus, path, ("content",))
    stored = X.read_index(spark, path)
    assert rows(S.rank(stored, ["red", "fox"], 10)) == bm25(["red", "fox"])
    assert sorted(rows(S.match_phrase(stored.positions, ["red", "fox"]))) == [(0,), (2,), (5,)]
    for batch in (0, 1, 1):
        X.append_index(corpus.filter(F.col("id") % 2 == batch), path + "-b", batch, ("content",))
    assert rows(S.rank(X.read_appended_index(spark, path + "-b"), ["red", "fox"], 10)) == bm25(["red", "fox"])


@pytest.fixture(scope="module")
def many(spark):
    texts = spark.range(250).select("id", F.concat(F.lit("word "), F.repeat(F.lit("pad "), F.col("id").cast("int"))).alias("content"))
    pages = spark.range(250).select(
        "id", F.concat(F.lit("http://h"), F.col("id") % 2, F.lit("/")).alias("url"), F.lit("t").alias("title"),
        F.lit("").alias("snippet"), F.lit("").alias("indexed_at"), F.col("id").cast("double").alias("indexed_time"),
        F.when(F.col("id") >= 240, 5).otherwise(0).cast("long").alias("backlinks"))
    return X.build_index(texts), pages


def test_candidate_cap_loses_hits(many):
    index, pages = many
    assert S.hits(index, pages, "word", min_links=1, candidate_cap=200).count() == 0
    assert S.hits(index, pages, "word", min_links=1, candidate_cap=None).count() == 10


def test_nothing_is_capped_by_default(many, spark):
    index, pages = many
    asked = spark.createDataFrame([(1, "word"), (2, "word"), (3, "nothing"), (4, "")], "query_id long, q string")
    assert S.hits(index, pages, "word").count() == 250
    assert sorted(rows(S.totals_batch(asked, index))) == [(1, 250), (2, 250), (3, 0), (4, 0)]
    assert S.rank_batch(asked, index).count() == 500


def test_refreshed_pages_replace_their_entries(spark):
    path = new_folder(spark, "refreshed")
    page = lambda *texts: spark.createDataFrame(list(texts), "id long, content string")
    X.append_index(page((1, "apple old"), (2, "apple pear"), (3, "plum")), path, 0, ("content",))
    for _ in range(2):
        X.append_index(page((1, "apple newer"), (3, "")), path, 1, ("content",))
    compact = new_folder(spark, "compact")
    X.compact_index(spark, path, compact)
    for index in (X.read_appended_index(spark, path), X.read_index(spark, compact)):
        ids = lambda *terms: sorted(r[0] for r in S.rank(index, list(terms)).collect())  # noqa: B023, E731
        assert (ids("old"), ids("apple"), ids("apple", "newer"), ids("plum"), ids("apple", "missing")) == ([], [1, 2], [1], [], [])
        stats = {r.term: (r.df, r.cf) for r in index.term_stats.collect()}
        assert stats == {"apple": (2, 2), "newer": (1, 1), "pear": (1, 1)}
        assert index.corpus.select("docs").first()[0] == 3
        assert sorted(r.position for r in index.positions.collect()) == [0, 0, 1, 1]
    X.append_index(page((1, "third")), path, 2, ("content",))
    assert {r.term for r in X.read_appended_index(spark, path).term_stats.collect()} == {"apple", "pear", "third"}


def test_pages_make_up_the_whole(many):
    index, pages = many
    seen = [r.id for page in range(1, 5) for r in S.search(index, pages, "word", page, 60, domain="H1").collect()]
    assert len(seen) == len(set(seen)) == 125 == S.hits(index, pages, "word", domain="h1").count()
    assert S.search(index, pages, "word", 9, 60).count() == 0
    by_date = [r.id for r in S.search(index, pages, "word", sort_by="date_desc").collect()]
    assert by_date == list(range(249, 239, -1))
    plain = rows(S.search(index, pages, "word"))
    assert rows(S.search(index, pages, "word", sort_by="what")) == plain


def test_search_batch_is_search(spark, heat, many):
    index, pages = many
    queries = spark.createDataFrame([("q", "word"), ("r", "pad word")], "query_id string, q string")
    got = S.search_batch(queries, index, pages, page=2, limit=7, sort_by="date_asc", domain="h0")
    one = S.search(index, pages, "word", 2, 7, "date_asc", domain="h0")
    assert [r.id for r in got.filter("query_id = 'q'").orderBy("position").collect()] == [r.id for r in one.collect()]


def test_filters(spark):
    df = spark.createDataFrame(
        [("http://A.org:80/x", None, None, None), ("/a.org", 5.0, 2, "Tue Jun  6 01:48:00 2026"), ("http://b/?a.org", 9.0, 9, "junk")],
        "url string, indexed_time double, backlinks long, indexed_at string")
    assert [r.url for r in S.domain_filter(df, "a.ORG").collect()] == ["http://A.org:80/x", "/a.org"]
    assert S.domain_filter(df, " a.org ", whole_url=True).count() == 3
    assert [S.date_filter(df, a, b).count() for a, b in ((None, None), (0, 5), (5, 5), (6, None))] == [3, 2, 1, 1]
    assert S.min_backlinks(df, 2).count() == 2
    assert S.display_date_filter(df, "custom", 0, "2026-06-06", "2026-06-07").count() == 1
    assert S.display_date_filter(df, "any", 0).count() == 3
    assert S.display_date_filter(df, "365d", 0).count() == 2


def test_highlight_and_projection(spark):
    df = spark.createDataFrame([(1, "u", "t", "", "x" * 90 + " Fox\nand " + "y" * 90)], "id long, url string, title string, snippet string, content string")
    cut = df.select(S.highlight("content", ["fox"])).first()[0]
    assert cut == "x" * 79 + " <b>Fox</b>\nand " + "y" * 75
    inner = spark.createDataFrame([("under de Den, de de",)], "content string")
    assert inner.select(S.highlight("content", ["de"])).first()[0] == "under <b>de</b> Den, <b>de</b> <b>de</b>"
    full = df.withColumns({"indexed_at": F.lit(None).cast("string"), "indexed_time": F.lit(None).cast("double"), "backlinks": F.lit(None).cast("long")})
    assert rows(S.project_hits(full, ["fox"])) == [(1, "u", "t", cut, "", 0.0, 0)]


# --- Spelling: all pairs in Python against the segment join --------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_suggest_finds_every_close_term(spark, heat):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abé") for _ in range(r.choice([1, 2, 2, 3, 4, 5, 6, 7, 9, 12])))
    vocabulary = {word(): r.randint(1, 9) for _ in range(400)}
    asked = {word() for _ in range(150)} | set(list(vocabulary)[:20])
    expected = []
    for w in asked:
        close = sorted((distance(w, t), -df, t) for t, df in vocabulary.items() if t != w and distance(w, t) <= 2)
        expected += [(w, t, d, -df, n + 1) for n, (d, df, t) in enumerate(close[:5])]
    got = P.suggest(
        spark.createDataFrame([(w,) for w in asked], "word string"),
        spark.createDataFrame(list(vocabulary.items()), "term string, df long"))
    assert sorted(rows(got)) == sorted(expected)


def test_suggest_short_words_only(spark):
    vocabulary = spark.createDataFrame([(a + b, ord(a) * 30 + ord(b)) for a in "abcdefgh" for b in "abcdefgh"], "term string, df long")
    asked = spark.createDataFrame([("zz",), ("hh",), ("q",), ("hz",)], "word string")
    terms = vocabulary.collect()
    for w, got in ((w, [r.term for r in P.suggest(asked, vocabulary, 3).filter(F.col("word") == w).orderBy("rank").collect()]) for w in ("zz", "hh", "q", "hz")):
        close = sorted((distance(w, t.term), -t.df, t.term) for t in terms if t.term != w and distance(w, t.term) <= 2)
        assert got == [c[2] for c in close[:3]]


def test_spell_correct(spark, heat):
    vocabulary = spark.createDataFrame([("search", 9), ("engine", 5), ("engines", 2), ("seerch", 1)], "term string, df long")
    queries = spark.createDataFrame([(1, "serch  enginee"), (2, "search engine"), (3, "xyzxyz"), (4, ""), (5, "engines serch")], "query_id long, q string")
    got = {r.query_id: r.correction for r in P.spell_correct(queries, vocabulary).collect()}
    assert got == {1: "search engine", 2: None, 3: None, 4: None, 5: "engines search"}
    always = {r.query_id: r.correction for r in P.spell_correct(queries, vocabulary, keep_known=False).collect()}
    assert always[2] == "seerch engines"


def test_prefix_suggest(spark):
    pool = spark.createDataFrame([("Web search",), ("web",), ("a web",)], "phrase string")
    assert P.prefix_suggest(pool, "WEB").count() == 2 and P.prefix_suggest(pool, "").count() == 0


# --- Images ------------------------------------------------------------------------------


def image_keywords(q):
    words = [k.lower() for k in q.replace(",", " ").replace("-", " ").split() if len(k) > 1]
    return words or [q.lower()]


def test_image_match_batch_is_all_pairs(spark, heat):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abC -") for _ in range(r.randint(0, n)))
    data = [(i, f"http://i/{text(5)}", text(9), r.choice([None, text(12)])) for i in range(60)]
    images = spark.createDataFrame(data, "id long, url string, alt_text string, title string")
    asked = [(i, text(6)) for i in range(40)] + [(40, ""), (41, "A"), (42, "abc, b-c")]
    queries = spark.createDataFrame(asked, "query_id long, q string")
    expected = sorted(
        (n, i) for n, q in asked for i, url, alt, title in data
        if any(k in (alt or "").lower() or k in (title or "").lower() or k in url.lower() for k in image_keywords(q)))
    assert sorted(rows(I.image_match_batch(images, queries))) == expected
    for n, q in asked[-6:]:
        assert sorted(r.id for r in I.image_match(images, q).collect()) == [i for m, i in expected if m == n]


def test_image_search_scans_only_the_first(spark):
    images = spark.range(150).select(
        "id", F.concat(F.lit("http://i/"), "id").alias("url"), F.lit("").alias("alt_text"), F.lit("").alias("title"),
        F.lit("").alias("source_url"), F.when(F.col("id") > 99, "red").alias("dominant_color"))
    assert I.image_search(images, "http", 200, cap=100).count() == 100
    first = I.image_search(images, "http").collect()
    assert len(first) == 12 and first[0].title == first[0].alt_text == "Indexed Image"
    facets = {r.facet: r.images for r in I.colour_facets(images).collect()}
    assert facets["all"] == 150 and facets["red"] == 50 and facets["teal"] == 0 and len(facets) == 12
    assert I.colour_filter(images, None).count() == 150
