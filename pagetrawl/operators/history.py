"""Search history, run log and crawl schedule."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrawl.functions.text import falsy
from pagetrawl.functions.times import calendar_text, epoch_now, next_run
from pagetrawl.operators.store import without_keys
from pagetrawl.plans.skew import salted_join, top_n
from pagetrawl.schemas import (
    CLEARED, DEFAULT_INTERVAL, DEFAULT_START_URL, HISTORY, HISTORY_LIMIT, MRU_LIMIT, RUNS_LIMIT,
)
from pagetrawl.sources.tables import read_batches, write_batch


def history_rows(searches: DataFrame) -> DataFrame:
    """History rows with a new id for searches ``session_id, query[, timestamp]``."""
    time = F.col("timestamp") if "timestamp" in searches.columns else epoch_now()
    return searches.select(
        F.uuid().alias("id"), "session_id", "query", time.cast("double").alias("timestamp"))


def append_history(searches: DataFrame, path: str, batch: int) -> None:
    """Searches written as batch ``batch`` of the history at ``path``; a repeated batch replaces itself."""
    write_batch(history_rows(searches), path, batch)


def write_cleared(spark: SparkSession, path: str, sessions: DataFrame, to: str) -> None:
    """The history at ``path`` without the listed sessions, stored as a new history at ``to``."""
    kept = clear_history(read_batches(spark, HISTORY, path), sessions)
    write_batch(kept.select(*HISTORY.fieldNames()), to, 0)


def clear_sessions(sessions: DataFrame, path: str, batch: int, upto: int) -> None:
    """Deletes the searches of the listed sessions in batches up to ``upto`` of the history at ``path``.

    Only a narrow table of cleared sessions is written, as its batch ``batch``; :func:`read_history` leaves
    their searches out. Searches of later batches stay, and a repeated batch replaces itself.
    """
    rows = sessions.select("session_id").filter("session_id is not null").distinct().withColumn("upto", F.lit(upto).cast("long"))
    write_batch(rows, f"{path}-cleared", batch)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history at ``path`` without what was cleared."""
    searches = read_batches(spark, HISTORY, path, keep_batch=True)
    cleared = read_batches(spark, CLEARED, f"{path}-cleared").groupBy("session_id").agg(F.max("upto").alias("upto"))
    known = salted_join(searches, cleared, "session_id", "left", salt_by="id")
    return known.filter("upto is null or batch_id > upto").select(*HISTORY.fieldNames())


def compact_history(spark: SparkSession, path: str, to: str, batch: int = 0) -> None:
    """The history at ``path`` as batch ``batch`` of a new one at ``to``, without what was cleared; later batches go there."""
    write_batch(read_history(spark, path), to, batch)


def recent_history(history: DataFrame, n: int = HISTORY_LIMIT) -> DataFrame:
    """The newest ``n`` searches of every session; a missing time counts as 0."""
    timed = history.withColumn("timestamp", F.coalesce("timestamp", F.lit(0.0)))
    ranked = top_n(timed, ["session_id"], [F.desc("timestamp"), F.asc("id")], n)
    return ranked.select("session_id", "rank", "id", "query", "timestamp")


def mru_queries(history: DataFrame, n: int = MRU_LIMIT) -> DataFrame:
    """The ``n`` queries of every session that were asked last for the first time."""
    first = history.groupBy("session_id", "query").agg(F.min("timestamp").alias("timestamp"))
    return top_n(first, ["session_id"], [F.desc("timestamp"), F.asc("query")], n)


def clear_history(history: DataFrame, sessions: DataFrame) -> DataFrame:
    """The history without the sessions listed in ``session_id``."""
    return without_keys(history, sessions, "session_id", salt_by="id")


def cleared_counts(history: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session_id, deleted`` for every listed session, 0 if it has no history."""
    counted = history.groupBy("session_id").agg(F.count(F.lit(1)).alias("deleted"))
    return sessions.select("session_id").distinct().join(counted, "session_id", "left").select(
        "session_id", F.coalesce("deleted", F.lit(0)).alias("deleted"))


def run_summary(batch: DataFrame, url: str = "url") -> DataFrame:
    """One row ``pages_crawled, errors`` of a crawl batch; rows without URL are errors."""
    missing = F.count_if(F.col(url).isNull() | (F.col(url) == ""))
    return batch.agg((F.count(F.lit(1)) - missing).alias("pages_crawled"), missing.alias("errors"))


def run_row(batch: DataFrame, start_url: str, triggered_by: str, now=None) -> DataFrame:
    """The run-log row of a crawl batch, with its real counts."""
    time = epoch_now() if now is None else F.lit(now).cast("double")
    return run_summary(batch).select(
        F.uuid().alias("id"), F.lit(start_url).alias("start_url"), F.lit("completed").alias("status"),
        "pages_crawled", "errors", F.lit(triggered_by).alias("triggered_by"),
        time.alias("timestamp"), calendar_text(time).alias("time_str"))


def append_run_log(batch: DataFrame, path: str, number: int, start_url: str, triggered_by: str, now=None) -> None:
    """The run-log row of a crawl batch, as batch ``number`` of the table at ``path``."""
    write_batch(run_row(batch, start_url, triggered_by, now), path, number)


def project_runs(runs: DataFrame) -> DataFrame:
    """Run-log rows with their defaults."""
    return runs.select(
        "id",
        F.coalesce("start_url", F.lit("N/A")).alias("start_url"),
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("pages_crawled", F.lit(0)).alias("pages_crawled"),
        F.coalesce("errors", F.lit(0)).alias("errors"),
        F.coalesce("triggered_by", F.lit("unknown")).alias("triggered_by"),
        F.coalesce("timestamp", F.lit(0.0)).alias("timestamp"),
        F.coalesce("time_str", F.lit("")).alias("time_str"))


def recent_runs(runs: DataFrame, n: int = RUNS_LIMIT) -> DataFrame:
    """The newest ``n`` runs."""
    return project_runs(runs.orderBy(F.desc("timestamp"), "id").limit(n))


def schedule_rows(schedules: DataFrame) -> DataFrame:
    """Schedules ``enabled, interval, start_url, last_run, updated_at`` with defaults and next run."""
    filled = schedules.select(
        F.coalesce("enabled", F.lit(False)).alias("enabled"),
        F.coalesce("interval", F.lit(DEFAULT_INTERVAL)).alias("interval"),
        falsy("start_url", F.lit(DEFAULT_START_URL)).alias("start_url"),
        F.coalesce("last_run", F.lit("N/A")).alias("last_run"),
        "updated_at")
    return filled.withColumn("next_run", next_run("enabled", "interval", "updated_at"))
