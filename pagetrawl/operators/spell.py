"""Spelling suggestions from the vocabulary, query correction, prefix completion."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.functions.text import words
from pagetrawl.plans.skew import salted_join, top_n
from pagetrawl.schemas import MAX_EDITS, SUGGESTIONS

# Letters of a text whose deletions are looked at; with more, only the first ones are.
PREFIX = 10
# Texts this short are close whatever their letters are.
ALWAYS_CLOSE = MAX_EDITS


def _deletions(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``_key``: hashes of the first letters of ``text`` with up to two of them left out.

    Two texts at most ``MAX_EDITS`` = 2 edits apart become equal if at most two letters
    of each are left out, and so do their first ``PREFIX`` letters: an insertion
    shifts a letter out of one side's prefix, which is one deletion on the other.
    A text has at most 56 keys. A collision only adds a candidate.
    """
    pairs = ", ".join(f"struct({i} AS i, {j} AS j)" for j in range(PREFIX + 1) for i in range(max(1, j)))
    placed = df.withColumn("_start", F.substring(text, 1, PREFIX)).withColumn("_at", F.expr(f"explode(array({pairs}))"))
    key = """xxhash64(CASE WHEN _at.j = 0 THEN _start WHEN _at.i = 0 THEN concat(substr(_start, 1, _at.j - 1), substr(_start, _at.j + 1))
        ELSE concat(substr(_start, 1, _at.i - 1), substr(_start, _at.i + 1, _at.j - _at.i - 1), substr(_start, _at.j + 1)) END)"""
    nothing = "length(_start) > CASE WHEN _at.j = 0 THEN 0 WHEN _at.i = 0 THEN 1 ELSE 2 END"
    return placed.filter(f"_at.j <= length(_start) AND {nothing}").withColumn("_key", F.expr(key)).drop("_start", "_at")


def suggest(asked: DataFrame, vocabulary: DataFrame, n: int = SUGGESTIONS) -> DataFrame:
    """``word, term, distance, df, rank``: the ``n`` best terms for each word.

    ``asked`` has ``word``, ``vocabulary`` has ``term, df``. Terms at most two
    edits away are ordered by distance, frequency and text; the word itself is
    left out. Candidates come from equal deletion neighbours, not from all pairs,
    and every close term shares at least one with the word.
    """
    wanted = asked.select("word").filter("word <> ''").distinct()
    terms = _deletions(vocabulary.select("term", "df"), "term")
    # Spark takes both sides for as small as the words before they are multiplied, so it must not broadcast one.
    pairs = terms.hint("merge").join(_deletions(wanted, "word"), "_key").filter(
        F.abs(F.length("word") - F.length("term")) <= MAX_EDITS).select("word", "term", "df")
    # Any two texts of at most two letters are close, and those of one length that
    # share no letter are equally far. Of these the n most frequent are enough, one
    # more in case the word itself is among them: at most 2 (n + 1) rows in all.
    short = vocabulary.withColumn("_l", F.length("term")).filter(F.col("_l").between(1, ALWAYS_CLOSE))
    frequent = top_n(short, ["_l"], [F.desc("df"), F.asc("term")], n + 1).select(
        "term", "df", F.lit(True).alias("_short"))
    short_words = wanted.filter(F.length("word") <= ALWAYS_CLOSE).withColumn("_short", F.lit(True))
    pairs = pairs.unionByName(short_words.join(F.broadcast(frequent), "_short").drop("_short"))
    distance = F.levenshtein("word", "term", MAX_EDITS)
    close = (
        pairs.filter(F.col("word") != F.col("term"))
        .withColumn("distance", distance).filter(F.col("distance") >= 0)
    )
    order = [F.asc("distance"), F.desc("df"), F.asc("term")]
    return top_n(close.select("word", "term", "distance", "df").distinct(), ["word"], order, n)


def spell_correct(queries: DataFrame, vocabulary: DataFrame, keep_known: bool = True) -> DataFrame:
    """``query_id, q, correction``: every word replaced by its best suggestion.

    The correction is null if nothing changes. Words of the vocabulary stay as
    they are, unless ``keep_known`` is off. Each distinct word is looked up
    once, however many queries hold it.
    """
    placed = queries.select("query_id", F.posexplode(words("q")).alias("_pos", "word"))
    asked = placed.select("word").distinct()
    if keep_known:
        asked = asked.join(vocabulary.select(F.col("term").alias("word")).hint("merge"), "word", "left_anti")
    best = suggest(asked, vocabulary, 1).select("word", F.col("term").alias("_best"))
    replaced = salted_join(placed, best, "word", "left", "query_id")
    word_list = F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_best", "word").alias("w"))))
    per_query = replaced.groupBy("query_id").agg(
        F.array_join(F.transform(word_list, lambda x: x.w), " ").alias("_text"),
        F.count("_best").alias("_changes"))
    return queries.select("query_id", "q").join(per_query, "query_id", "left").select(
        "query_id", "q", F.when(F.col("_changes") > 0, F.col("_text")).alias("correction"))


def prefix_suggest(pool: DataFrame, q: str, phrase: str = "phrase") -> DataFrame:
    """Phrases that start with ``q`` in any case; none for an empty ``q``."""
    if not q:
        return pool.limit(0)
    return pool.filter(F.lower(F.col(phrase)).startswith(q.lower()))
