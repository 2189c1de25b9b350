"""Joins and top-n that stay balanced when a few keys hold most rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one key that a task takes; a key with more is split over several salts.
TARGET_ROWS = 100_000
#: Salts that rows with a null key are dealt to; they match nothing.
NULL_SALTS = 128


def hot_keys(facts: DataFrame, on: str, target: int = TARGET_ROWS) -> DataFrame:
    """``on, _salts``: every key of ``facts`` with more rows than ``target``.

    Counts are combined before they are shuffled. There are fewer such keys than
    all rows by ``target``, so the list is small beside its table, but it is not
    taken to be small enough for a broadcast.
    """
    return hot_of(facts.groupBy(on).count(), on, "count", target)


def hot_of(counts: DataFrame, on: str, count: str, target: int = TARGET_ROWS) -> DataFrame:
    """:func:`hot_keys` where the rows per key are counted already."""
    return counts.filter(F.col(on).isNotNull() & (F.col(count) > target)).select(
        on, F.ceil(F.col(count) / target).cast("int").alias("_salts"))


def salted_join(
    facts: DataFrame,
    dim: DataFrame,
    on: str,
    how: str = "inner",
    salt_by: str | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``facts`` joined to ``dim`` on ``on`` with the hot keys of ``facts`` spread out.

    A row of a hot key gets a salt from a hash of ``salt_by``, which must vary
    within the key; there are as many salts as its rows need at ``TARGET_ROWS``
    each, and the rows of ``dim`` for the key are repeated once per salt. Salts
    come from a hash, not a random number, so a task that is run again gives the
    same rows. ``how`` may be inner, left, left_semi or left_anti: rows of
    ``facts`` with a null key are spread as well.
    """
    hot = hot_keys(facts, on) if hot is None else hot
    hashed = F.xxhash64(salt_by or on)
    salted = (
        facts.join(hot, on, "left")
        .withColumn("_salt", F.pmod(hashed, F.when(F.col(on).isNull(), NULL_SALTS).otherwise(F.coalesce("_salts", F.lit(1)))).cast("int"))
        .drop("_salts")
    )
    repeated = (
        dim.join(hot, on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted.join(repeated, [on, "_salt"], how).drop("_salt")


def top_n(df: DataFrame, by: list[str], order: list, n: int, rank: str = "rank", offset: int = 0) -> DataFrame:
    """The first ``n`` rows of every group after ``offset``, with their rank.

    Spark limits each group before the shuffle as well, so a group's rows are
    never brought together as a whole.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= offset + n)
    return ranked.filter(F.col(rank) > offset) if offset else ranked


def latest(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key: the first in ``order``."""
    return top_n(df, [key], order, 1, "_rank").drop("_rank")
