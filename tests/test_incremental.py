"""Statistics, counts, known keys and current rows that are kept by batch, against the same computed at once."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrawl.operators import current as C
from pagetrawl.operators import history as H
from pagetrawl.operators import index as X
from pagetrawl.operators import known as K
from pagetrawl.operators import search as S
from pagetrawl.operators.graph import backlink_counts, backlinks_as_of
from pagetrawl.operators.store import latest_pages, new_pages, page_detail
from pagetrawl.plans import ingest as I
from pagetrawl.plans.deltas import Counts
from pagetrawl.plans.lineage import new_folder
from pagetrawl.schemas import PAGES, RAW_PAGES
from pagetrawl.sources.tables import read_batches


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- Counts -------------------------------------------------------------------------------


def test_counts_are_sums_of_changes(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType())])
    counts = Counts(new_folder(spark, "counts"), schema, ["k"])
    assert rows(counts.read(spark)) == []
    changes = [[("a", 1, 5), ("a", 1, 0), ("b", 2, 2)], [("a", -2, -5), ("c", 1, 1), (None, 4, 4)], [], [("b", -2, 0), ("d", 7, 0)]]
    for batch, change in enumerate(changes):
        counts.write(spark.createDataFrame(change, schema), batch)
    after = [[], [("a", 2, 5), ("b", 2, 2)], [("b", 2, 2), ("c", 1, 1), (None, 4, 4)]]
    after += [after[2], [("b", 0, 2), ("c", 1, 1), ("d", 7, 0), (None, 4, 4)]]

    def check():
        for before, expected in enumerate(after):
            assert rows(counts.read(spark, before)) == sorted(expected, key=str)
        assert rows(counts.read(spark)) == sorted(after[4], key=str)
        wanted = spark.createDataFrame([("b", 0), ("b", 1), ("x", 0)], "k string, other int")
        assert rows(counts.read_for(wanted)) == [("b", 0, 2)]
        assert rows(counts.read_for(wanted, before=1)) == [("b", 2, 2)]

    check()
    for fold in (1, 1, 2):
        counts.fold(spark, fold)
        check()
    counts.write(spark.createDataFrame(changes[1], schema), 1)  # a batch below the fold, once more
    counts.write(spark.createDataFrame(changes[3], schema), 3)
    check()
    counts.fold(spark, 3)
    check()


def test_folded_batches_are_not_read(spark):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    counts = Counts(new_folder(spark, "counts"), schema, ["k"])
    for batch in range(4):
        counts.write(spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit(1).cast("long").alias("n")), batch)
    counts.fold(spark, 2)
    files = {f.split("batch_id=")[0].rsplit("/", 2)[-2] + f.split("batch_id=")[1].split("/")[0]
             for f in counts.changes(spark).select(F.input_file_name()).distinct().toPandas()["input_file_name()"]}
    assert files == {"changes2", "changes3"}
    assert counts.changes(spark).count() == 20


# --- Known keys ---------------------------------------------------------------------------


def keyed(spark, low, high):
    return spark.range(low, high).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.lit("x").alias("part"))


def test_absent_is_an_anti_join(spark):
    path = new_folder(spark, "known")
    batches = [(0, 3000), (2500, 2600), (0, 0), (5000, 9000)]
    for n, (low, high) in enumerate(batches):
        K.write_keys(keyed(spark, low, high).unionByName(keyed(spark, low, min(high, low + 5))), path, n)
    items = keyed(spark, 2900, 5100).unionByName(keyed(spark, 2990, 3010)).unionByName(
        spark.createDataFrame([(None, "y"), ("", "z"), ("odd", None)], "id string, part string"))

    def check():
        for before in (None, 0, 1, 2, 3, 4):
            known = keyed(spark, 0, 0)
            for low, high in batches[:before]:
                known = known.unionByName(keyed(spark, low, high))
            assert rows(K.absent(items, path, before)) == rows(new_pages(items, known))

    check()
    K.fold_keys(spark, path, 1)
    check()
    K.fold_keys(spark, path, 2)
    K.write_keys(keyed(spark, 0, 3000), path, 0)
    check()
    assert rows(K.absent(items, new_folder(spark, "none"))) == rows(items)


def test_filters_spare_most_keys(spark):
    path = new_folder(spark, "known")
    for n in range(2):
        K.write_keys(keyed(spark, 40_000 * n, 40_000 * n + 40_000), path, n)
    fresh = keyed(spark, 80_000, 100_000)
    wrong = K.possible(fresh, path).count()
    assert wrong < 20  # of 40,000 tests
    read, stored = K.keys_read(fresh, path).first()
    assert stored == 80_000 and read <= wrong * 200
    few = fresh.limit(50).unionByName(keyed(spark, 7, 9))
    read, _ = K.keys_read(few, path).first()
    assert 2 <= read < 1000
    assert K.absent(few, path).count() == 50
    everything = K.keys_read(keyed(spark, 0, 80_000), path).first()
    assert everything.keys_read == everything.keys_stored == 80_000


# --- Current rows -------------------------------------------------------------------------


def versions(spark, seed, low, high, time):
    draw = random.Random(seed)
    data = [(f"id{i}", f"http://{i}", f"t{seed}", draw.choice(["text " * draw.randint(0, 40), None]), "s", "",
             draw.choice([time, time + 0.5, None]), i) for i in range(low, high) for _ in range(draw.randint(1, 2))]
    return spark.createDataFrame(data, PAGES)


@pytest.fixture(scope="module")
def log(spark):
    path = new_folder(spark, "pages")
    for batch, (low, high, time) in enumerate([(0, 60, 1.0), (30, 90, 2.0), (0, 10, 0.2), (80, 100, 3.0)]):
        for _ in range(2 if batch == 1 else 1):
            C.write_keyed(versions(spark, batch, low, high, time), path, batch, PAGES, buckets=5)
    return path


def test_current_rows_are_the_latest(spark, log):
    plain = read_batches(spark, PAGES, log, keep_batch=True)
    best = {}
    for r in plain.collect():
        rank = (r.indexed_time is not None, r.indexed_time or 0, r.batch_id)
        if r.id not in best or rank > best[r.id][0]:
            best[r.id] = rank, r
    found = C.current_rows(spark, log, PAGES)
    assert found.columns == PAGES.fieldNames()
    assert rows(found) == sorted((tuple(r)[:-1] for _, r in best.values()), key=str)
    timed = plain.filter("indexed_time is not null").drop("batch_id")
    both = latest_pages(timed).join(found, "id").filter(found["indexed_time"].isNotNull())
    assert both.count() > 50


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_is_never_exchanged(spark, log):
    found = C.current_rows(spark, log, PAGES)
    assert "Exchange" not in plan(found) and "content" in plan(found)
    assert found.rdd.getNumPartitions() == 5


def test_lookup_reads_one_bucket(spark, log):
    whole = C.current_rows(spark, log, PAGES)
    found = C.lookup(spark, log, PAGES, ["id35"])
    assert rows(found) == rows(page_detail(whole, "id35")) and found.count() == 1
    shown = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    assert shown.count("SelectedBucketsCount: 1 out of 5") == 2
    assert rows(C.lookup(spark, log, PAGES, ["id1", "id85", "none"])) == rows(page_detail(whole, ["id1", "id85"]))
    assert C.lookup(spark, log, PAGES, []).count() == 0


def test_batches_of_other_sessions_are_seen(spark, log):
    other = spark.newSession()
    before = C.current_rows(other, log, PAGES).count()
    C.write_keyed(versions(spark, 9, 200, 205, 4.0), log, 9, PAGES)
    assert C.current_rows(other, log, PAGES).count() == before + 5 == C.current_rows(spark, log, PAGES).count()
    assert C.current_rows(spark, new_folder(spark, "none"), PAGES).count() == 0


# --- Index statistics and ingest ------------------------------------------------------------


def stats(index):
    return rows(index.term_stats.select("field", "term", "df", "cf")), rows(index.corpus.select("field", "docs", F.round("average", 9)))


def test_index_statistics_follow_the_batches(spark):
    words, draw = ["ax", "bo", "cu", "dy", "ez"], random.Random(4)
    path = new_folder(spark, "index")

    def batch(n):
        draw.seed(n)
        data = [(i, " ".join(draw.choices(words, k=draw.randint(0, 6))), draw.choice(words)) for i in draw.sample(range(40), 15)]
        return spark.createDataFrame(data, "id long, content string, title string")

    for n in (0, 1, 2, 2, 3):
        X.append_index(batch(n), path, n, ("content", "title"))
    compact = new_folder(spark, "compact")
    X.compact_index(spark, path, compact)
    expected = stats(X.read_index(spark, compact))
    assert stats(X.read_appended_index(spark, path)) == expected
    counted = X.read_appended_index(spark, path)
    assert rows(X.term_stats(counted.postings)) == expected[0]
    assert "postings" not in plan(counted.term_stats) and "doc_len" not in plan(counted.corpus)
    X.fold_index_statistics(spark, path, 2)
    X.append_index(batch(1), path, 1, ("content", "title"))
    X.append_index(batch(3), path, 3, ("content", "title"))
    assert stats(X.read_appended_index(spark, path)) == expected


def page(n, *links):
    return (n, f"http://h/{n}", f"<title>p{n}</title><body>word{n % 3}" + "".join(f"<a href='/{x}'>" for x in links))


def test_backlinks_follow_the_batches(spark):
    root, draw = new_folder(spark, "ingest"), random.Random(5)
    batches = [[page(i, *draw.sample(range(40), 4)) for i in draw.sample(range(40), 12)] for _ in range(4)]
    for n, some in enumerate(batches):
        for _ in range(2 if n == 2 else 1):
            I.ingest_batch(spark.createDataFrame(some, RAW_PAGES), root, n, index=False, now=float(n + 1))
        if n == 1:
            I.fold_tables(spark, root, 1, index=False)
    pages, links = I.stored_pages(spark, root), I.stored_links(spark, root)
    assert rows(pages.select("id", "backlinks")) == rows(backlinks_as_of(pages, links))
    assert rows(I.link_counts(root).read(spark)) == rows(backlink_counts(links))
    assert links.count() == links.select("id").distinct().count() and pages.count() == len({p[0] for some in batches for p in some})
    one = pages.first()
    assert rows(I.stored_page_detail(spark, root, [one.id])) == [tuple(one)]


# --- Cleared sessions and paging by key -----------------------------------------------------


def test_cleared_sessions(spark):
    path, to = new_folder(spark, "history"), new_folder(spark, "compacted")

    def append(batch, *found, at=None):
        H.append_history(spark.createDataFrame([(s, f"q{i}", float(i)) for i, s in enumerate(found)], "session_id string, query string, timestamp double"), at or path, batch)

    def left(at=None):
        return sorted((r.session_id or "", r.query) for r in H.read_history(spark, at or path).collect())

    append(0, "a", "b", None, "a")
    assert len(left()) == 4
    for _ in range(2):
        H.clear_sessions(spark.createDataFrame([("a",), ("z",), (None,), ("a",)], "session_id string"), path, 0, upto=0)
        assert left() == [("", "q2"), ("b", "q1")]
    append(1, "a", "b")
    append(0, "a", "b", None, "a")
    assert left() == [("", "q2"), ("a", "q0"), ("b", "q1"), ("b", "q1")]
    H.clear_sessions(spark.createDataFrame([("b",)], "session_id string"), path, 1, upto=1)
    assert left() == [("", "q2"), ("a", "q0")]
    H.compact_history(spark, path, to, 1)
    append(2, "b", at=to)
    assert left(to) == [("", "q2"), ("a", "q0"), ("b", "q0")]


@pytest.mark.parametrize("by", [None, "date_desc", "date_asc", "backlinks_desc", "likes_desc"])
@pytest.mark.parametrize("scored", [True, False])
def test_pages_after_cursors_are_the_whole_order(spark, by, scored):
    draw = random.Random(9)
    data = [(f"p{i}", draw.choice([None, 0.0, 1.0, 2.5]), draw.choice([None, 0, 3]), draw.choice([None, 0, 7]), draw.choice([0.5, 1.5, None]))
            for i in range(47)]
    df = spark.createDataFrame(data, "id string, indexed_time double, backlinks long, likes long, score double")
    df = df if scored else df.drop("score")
    whole = [r.id for r in S.sort_hits(df, by).collect()]
    seen, cursor = [], None
    while page := S.page_after(df, cursor, by, 10).collect():
        seen += [r.id for r in page]
        cursor = S.cursor_of(page[-1], by)
    assert seen == whole and len(set(seen)) == 47
    assert "TakeOrderedAndProject" in plan(S.page_after(df, cursor, by, 10))


# --- Wildcards through pieces ---------------------------------------------------------------


def test_wildcards_through_pieces_are_like(spark):
    draw = random.Random(2)
    words = ["".join(draw.choices("abé9", k=draw.randint(1, 7))) for _ in range(120)]
    postings = spark.createDataFrame([("content", w, i % 30) for i, w in enumerate(words)] + [("title", "abab", 99)], "field string, term string, id long")
    grams = X.term_grams(postings.select("field", "term").distinct())
    for pattern in ["*aba*", "a*b", "*", "ab*", "*é9", "?b?", "*a?b*9*", "aba", "ABA*", "*zzz*", "a", "", "*bab?", "??????", "*a%b*", "*a_b*"]:
        assert rows(S.match_wildcard(postings, pattern, grams=grams)) == rows(S.match_wildcard(postings, pattern))
    path = new_folder(spark, "grams")
    X.write_term_grams(postings, path)
    found = S.match_wildcard(postings, "*bab*", grams=spark.read.parquet(path))
    assert "EqualTo(gram,bab)" in found._jdf.queryExecution().toString()
