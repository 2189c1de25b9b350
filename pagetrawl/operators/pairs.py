"""Phrases of frequent words: occurrences of two frequent terms next to each other are stored as pairs."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrawl.operators.index import Index, _analysed
from pagetrawl.plans.lineage import stored_once

#: Share of a field's documents from which a term counts as frequent.
FREQUENT = 0.01


@dataclass(frozen=True)
class Pairs:
    """``pairs(field, term, next, id, position)`` of neighbours that are both in ``frequent(field, term)``."""

    pairs: DataFrame
    frequent: DataFrame


def write_pairs(pages: DataFrame, index: Index, path: str, share: float = FREQUENT, fields=("content",)) -> None:
    """The frequent terms of an index and their neighbouring occurrences in its pages, at the new path ``path``.

    Neighbours are read off the text's own row: only pairs of frequent terms are moved, to be sorted.
    """
    spark = pages.sparkSession
    docs = index.corpus.select("field", "docs")
    frequent = index.term_stats.join(docs, "field").filter(F.col("df") >= share * F.col("docs")).select("field", "term")
    frequent.write.parquet(f"{path}/frequent")
    listed = spark.read.schema("field string, term string").parquet(f"{path}/frequent")
    after = listed.withColumnRenamed("term", "next")
    both = _neighbours(pages, fields).join(listed, ["field", "term"], "left_semi").join(after, ["field", "next"], "left_semi")
    order = ["field", "term", "next", "id", "position"]
    # stored before they are sorted: the sort looks at its rows twice, and would cut all texts into terms again
    found = stored_once(both.select(*order), "neighbours")
    found.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("field").parquet(f"{path}/pairs")


def _neighbours(pages: DataFrame, fields) -> DataFrame:
    """``field, id, position, term, next`` of every occurrence but a text's last."""
    near = F.arrays_zip("terms", F.slice("terms", 2, F.greatest(F.size("terms"), F.lit(1))).alias("next"))
    rows = _analysed(pages, fields).select("field", "id", F.posexplode(near).alias("position", "_pair"))
    return rows.select("field", "id", "position", F.col("_pair.terms").alias("term"), F.col("_pair.next").alias("next")).filter("next is not null")


def read_pairs(index: Index, path: str) -> Pairs:
    """What :func:`write_pairs` wrote for ``index``."""
    read = index.positions.sparkSession.read
    pairs = index.positions.select("field", "term", F.col("term").alias("next"), "id", "position")
    return Pairs(
        read.schema(pairs.schema).parquet(f"{path}/pairs"),
        read.schema("field string, term string").parquet(f"{path}/frequent"))


def match_phrase_pairs(index: Index, stored: Pairs, terms: list[str], field: str = "content") -> DataFrame:
    """Documents with the terms next to each other in this order, as ``search.match_phrase`` finds them.

    Neighbours that are both frequent are read as pairs, the other terms as occurrences, of which there
    are few unless a frequent term stands between rare ones. Each votes for the place where the phrase
    would start. No terms, no rows.
    """
    places = sorted(set(terms))
    listed = stored.frequent.filter((F.col("field") == field) & F.col("term").isin(places))
    frequent = {r.term for r in listed.select("term").collect()}  # terms of the phrase
    starts = [i for i in range(len(terms) - 1) if {terms[i], terms[i + 1]} <= frequent]
    covered = {i + j for i in starts for j in (0, 1)}
    alone = [i for i in range(len(terms)) if i not in covered]

    def votes(rows: DataFrame, key, wanted: dict[str, list[int]]) -> DataFrame:
        place = F.create_map(*(x for w, at in wanted.items() for x in (F.lit(w), F.array(*map(F.lit, at)))))
        found = rows.filter(F.col("field") == field).select("id", "position", F.explode(place[key]).alias("_place"))
        return found.select("id", (F.col("position") - F.col("_place")).alias("_start"))

    cast: list[DataFrame] = []
    if starts:
        wanted = {f"{terms[i]} {terms[i + 1]}": [j for j in starts if terms[j:j + 2] == terms[i:i + 2]] for i in starts}
        # one test for each pair of the phrase, which reach the files' statistics
        test = F.lit(False)
        for pair in wanted:
            first, second = pair.split(" ")
            test |= (F.col("term") == first) & (F.col("next") == second)
        cast.append(votes(stored.pairs.filter(test), F.concat_ws(" ", "term", "next"), wanted))
    if alone:
        wanted = {terms[i]: [j for j in alone if terms[j] == terms[i]] for i in alone}
        cast.append(votes(index.positions.filter(F.col("term").isin(sorted(wanted))), F.col("term"), wanted))
    if not cast:
        return index.positions.select("id").limit(0)
    every = cast[0] if len(cast) == 1 else cast[0].unionByName(cast[1])
    counted = every.groupBy("id", "_start").agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col("_n") == len(starts) + len(alone)).select("id").distinct()
