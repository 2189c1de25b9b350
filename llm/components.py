"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b: bigint): the root is the least node that it reaches.

    Alternates two star operations until nothing changes: each node's larger neighbours, then its
    smaller ones, are tied to the least neighbour. The table never has more rows than it began with,
    and the rounds grow with the logarithm of the longest chain. A hub's rows meet one row of its
    least neighbour, a join that Spark can split. Rounds are stored in the shared folder.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = stored(_star(both).where("a <> b").distinct())
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("root"))
        tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        edges = stored(tied.unionByName(least.select("a", F.col("root").alias("b"))).where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now


def _star(both: DataFrame) -> DataFrame:
    """Each node's larger neighbours, tied to the least of the node and its neighbours."""
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
