"""What larger tables have: several files, repeated URLs, sides that grow when they are multiplied."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from pagetrawl.operators import index as X
from pagetrawl.operators import pairs as N
from pagetrawl.operators import search as S
from pagetrawl.operators import spell as P
from test_registered import tidy

QUERIES, SQL = contract.queries(), contract.oracle_sql()

REPEATED = (
    "backlink_counts", "backlinks_as_of", "cap_links", "clamp", "collection_add", "collection_add_nested",
    "collection_remove_nested", "collection_total_nested", "edge_match", "extract_pages", "ingest_in_batches",
    "ingest_link_counts", "ingest_replayed", "keys_compared", "resolve_edges")


@pytest.fixture(scope="module")
def repeated(sf, tmp_path_factory):
    """The smallest tables, with five URLs stored again with the HTML of other pages."""
    folder = tmp_path_factory.mktemp("repeated")
    for name in os.listdir(sf):
        if name != "pages.parquet":
            os.symlink(f"{sf}/{name}", folder / name)
    con = duckdb.connect()
    pages = f"'{sf}/pages.parquet'"
    con.sql(f"""COPY (SELECT * FROM {pages} UNION ALL
        SELECT n + row_number() OVER (ORDER BY a.page_id) - 1, a.url, b.html
        FROM {pages} a JOIN {pages} b ON b.page_id = a.page_id + 7, (SELECT count(*) AS n FROM {pages})
        WHERE a.page_id IN (0, 3, 4, 12, 20)) TO '{folder}/pages.parquet' (FORMAT parquet)""")
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW \"{name[:-8]}\" AS SELECT * FROM '{folder}/{name}'")
    return str(folder), con


@pytest.mark.parametrize("name", REPEATED)
def test_repeated_urls(spark, repeated, name):
    folder, con = repeated
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    result = con.sql(SQL[name])
    order = [result.columns.index(c) for c in columns]
    assert sorted(tuple(tidy(r[c]) for c in columns) for r in df.collect()) == sorted(
        tuple(tidy(r[i]) for i in order) for r in result.fetchall())


def test_neighbours_of_words_are_not_broadcast(spark):
    """Both sides look as small as their words, and have up to 56 rows for each."""
    vocabulary = spark.range(50).select(F.concat(F.lit("term"), "id").alias("term"), F.col("id").alias("df"))
    queries = spark.range(3).select(F.col("id").alias("query_id"), F.concat(F.lit("tern"), "id").alias("q"))
    plan = P.spell_correct(queries, vocabulary)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_key#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


@pytest.fixture(scope="module")
def in_folders(spark, sf, tmp_path_factory):
    """The smallest tables, with pages and events as folders of several files."""
    folder = tmp_path_factory.mktemp("folders")
    for name in os.listdir(sf):
        if name in ("pages.parquet", "events.parquet"):
            spark.read.parquet(f"{sf}/{name}").repartition(3).write.parquet(f"{folder}/{name}")
        else:
            os.symlink(f"{sf}/{name}", folder / name)
    return str(folder)


@pytest.mark.parametrize("name", ("read_pages", "read_backlinks", "stream_history"))
def test_streams_of_folders(spark, sf, in_folders, name):
    rows = sorted(map(tuple, QUERIES[name](spark, in_folders).collect()))
    assert rows and rows == sorted(map(tuple, QUERIES[name](spark, sf).collect()))


@pytest.mark.parametrize("name", ("extract_wrapped",))
def test_products_are_dealt_out(spark, sf, name):
    """One row group is one task unless it is dealt out before its pages are parsed."""
    assert QUERIES[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_postings_move_once(spark, tmp_path):
    """Counting stays in the text's row; a stored posting carries its positions, and readers of the rest skip them."""
    pages = spark.createDataFrame([(1, "red fox red"), (2, ""), (3, None), (4, "fox")], "id long, content string")
    plan = X.postings(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    X.write_index(pages, f"{tmp_path}/index", ("content",))
    stored = X.read_index(spark, f"{tmp_path}/index")
    counted = stored.postings.select("term", "id", "dl", "tf")
    assert sorted(map(tuple, counted.collect())) == [("fox", 1, 3, 1), ("fox", 4, 1, 1), ("red", 1, 3, 2)]
    assert "positions" not in counted._jdf.queryExecution().executedPlan().toString()
    places = stored.positions.select("term", "id", "position")
    assert sorted(map(tuple, places.collect())) == [("fox", 1, 1), ("fox", 4, 0), ("red", 1, 0), ("red", 1, 2)]
    assert sorted((r.id, r.dl) for r in stored.doc_len.collect()) == [(1, 3), (2, 0), (3, 0), (4, 1)]


def test_sets_of_terms_go_to_the_texts(spark, tmp_path, monkeypatch):
    """No posting and no candidate is moved by its term, in however many passes the sets are taken."""
    texts = [(1, "red fox red"), (2, "fox dog"), (3, None), (4, "dog red fox hen"), (5, "hen fox dog red owl")]
    X.write_index(spark.createDataFrame(texts, "id long, content string"), f"{tmp_path}/sets", ("content",))
    index = X.read_index(spark, f"{tmp_path}/sets")
    asked = ["fox", "red fox", "fox red", "dog fox hen red", "hen owl dog red fox", "absent fox", ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    found = S.rank_batch(queries, index, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange hashpartitioning" in line and "term#" in line for line in plan.splitlines())
    whole = sorted(map(tuple, found.collect()))
    single = sorted((i, r.id, r.score) for i, q in enumerate(asked) if q for r in S.rank(index, q.split(), 3).collect())
    assert [r[:3] for r in whole] == single
    monkeypatch.setattr(S, "PASS_TERMS", 2)
    assert sorted(map(tuple, S.rank_batch(queries, index, 3).collect())) == whole


def test_highlight_steps_back_only_near_the_match(spark):
    """The same text as one pattern over the whole text gives, from a substring."""
    around, terms = 5, ["de", "ther", "a😀b"]
    odd = ["", "de", "xde de", "aaaaaaxde de, DE der", "😀" * 9 + " de " + "😀" * 9, "wide open side", "no\nthe\nDE\nlast line",
           "de de de de de de", "1234567890 ther", "aether a😀b A😀B", "ünde. Ther-de", None, "de" * 40, "x" * 5000 + " de " + "y" * 5000]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, content string")
    either = "|".join(rf"\Q{t}\E" for t in sorted(terms, key=lambda t: (-len(t), t)))
    either = rf"(?<![\p{{L}}\p{{N}}])(?:{either})(?![\p{{L}}\p{{N}}])"
    whole = F.regexp_extract("content", rf"(?ius)(.{{0,{around}}}(?:{either}).{{0,{around}}})", 1)
    out = df.select("id", S.highlight("content", terms, around).alias("a"), F.regexp_replace(whole, rf"(?iu)({either})", "<b>$1</b>").alias("b"))
    assert all(r.a == r.b for r in out.collect())
    plan = df.select(S.highlight("content", terms, around).alias("a"))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract(substring(" in plan


def test_phrase_votes_stay_in_arrays(spark):
    """No row for each occurrence: the places of a term in a text stay together."""
    texts = ["de la de", "la de", "de la", "de xx la", "la de la de", "de de de", "", None, "de la xx de la de"]
    index = X.build_index(spark.createDataFrame(list(enumerate(texts)), "id long, content string"))
    for phrase in (["de", "la"], ["de", "la", "de"], ["de", "de"], ["la"], ["de", "none"]):
        found = S.match_phrase(index.places, phrase)
        assert "_place" not in found._jdf.queryExecution().executedPlan().toString()
        expected = sorted(i for i, t in enumerate(texts) if f" {' '.join(phrase)} " in f" {(t or '')} ")
        assert sorted(r.id for r in found.collect()) == expected
        assert sorted(r.id for r in S.match_phrase(index.positions, phrase).collect()) == expected


def test_texts_are_cut_once_for_their_pairs(spark, tmp_path):
    """A sort over ranges runs its input twice: once to see it, once to move it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pages = spark.createDataFrame([(1, "de la de"), (2, "de la"), (3, "owl de")], "id long, content string")
    index = X.build_index(pages)
    N.write_pairs(pages.mapInArrow(count, pages.schema), index, f"{tmp_path}/pairs", 0.5)
    stored = spark.read.parquet(f"{tmp_path}/pairs/pairs").select("term", "next", "id", "position")
    assert sorted(map(tuple, stored.collect())) == [("de", "la", 1, 0), ("de", "la", 2, 0), ("la", "de", 1, 1)]
    assert seen.value == 3


def test_long_ids_are_stored_once(spark, tmp_path):
    """A posting of a text with a long id holds a number: 64 letters for each posting no longer fit a file's dictionary."""
    def page(*texts):
        rows = [(f"{i:064x}", text) for i, text in texts]
        return spark.createDataFrame(rows, "id string, content string")

    def tables(index):
        return [sorted(map(tuple, df.collect())) for df in (
            index.postings.select("field", "term", "id", "dl", "tf"), index.positions.select("field", "term", "id", "position"),
            index.doc_len.select("field", "id", "dl"), index.term_stats.select("field", "term", "df", "cf"),
            index.texts.select("field", "id", "dl"), index.places.select("field", "term", "id", "positions"), S.rank(index, ["red", "fox"]))]

    first = [(1, "red fox red"), (2, ""), (3, None), (4, "fox"), (5, "dog red fox")]
    after = [(1, "red dog"), (2, "fox red hen"), (3, None), (4, "fox"), (5, "dog red fox"), (6, "fox fox red")]
    X.write_index(page(*after, (6, "red owl")), f"{tmp_path}/once", ("content",))
    assert tables(X.read_index(spark, f"{tmp_path}/once")) == tables(X.build_index(page(*after, (6, "red owl"))))
    X.append_index(page(*first), f"{tmp_path}/batches", 0, ("content",))
    for _ in range(2):
        X.append_index(page(after[0], after[1], after[5]), f"{tmp_path}/batches", 1, ("content",))
    X.compact_index(spark, f"{tmp_path}/batches", f"{tmp_path}/compact")
    whole = tables(X.build_index(page(*after)))
    assert tables(X.read_appended_index(spark, f"{tmp_path}/batches")) == whole
    assert tables(X.read_index(spark, f"{tmp_path}/compact")) == whole
    for name in ("once", "batches", "compact"):
        assert "id" not in spark.read.parquet(f"{tmp_path}/{name}/postings").columns


def test_total_hits_moves_no_long_ids(spark, tmp_path):
    """More hashes than a Parquet file's dictionary takes: the postings stay as small as those of numbers, the total is right."""
    n = 24_000
    numbered = spark.range(n).select("id", F.concat_ws(
        " ", F.lit("red"), F.expr("IF(id % 3 = 0, 'fox', 'hen')"), *(F.concat(F.lit(f"w{k}x"), F.col("id") % (50 + k)) for k in range(8))).alias("content"))
    hashed = numbered.withColumn("id", F.sha2(F.col("id").cast("string"), 256))
    pages = hashed.select("id", F.lit("http://a.example/").alias("url"), F.lit(0.0).alias("indexed_time"),
                          F.when(F.col("content").contains("hen"), 3).otherwise(F.char_length("content") % 4).alias("backlinks"))
    size = {}
    for name, texts in (("numbered", numbered), ("hashed", hashed)):
        path = f"{tmp_path}/{name}"
        X.write_index(texts, path, ("content",))
        size[name] = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{path}/postings") for f in files)
    assert size["hashed"] < 1.5 * size["numbered"]
    wanted = hashed.join(pages.filter("backlinks >= 2"), "id").filter("content LIKE '% fox %'").count()
    found = S.hits(X.read_index(spark, f"{tmp_path}/hashed"), pages, "red fox", min_links=2)
    assert 0 < wanted < n // 3 and S.total_hits(found).collect()[0].total == wanted
    assert S.total_hits(S.hits(X.read_index(spark, f"{tmp_path}/hashed"), pages, "red")).collect()[0].total == n
