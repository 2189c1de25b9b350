"""Streams of raw pages and of searches, each micro-batch written once."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagetrawl.operators.history import history_rows
from pagetrawl.plans.ingest import ingest_batch
from pagetrawl.sources.tables import write_batch


def ingest_stream(raw: DataFrame, root: str, checkpoint: str, **options) -> StreamingQuery:
    """Arriving raw pages ingested below ``root``; stops when the input is used up.

    Known pages are looked up in the stored table, not in stream state, because
    a page seen at any time before must not be stored again. ``options`` go to
    :func:`pagetrawl.plans.ingest.ingest_batch`.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, root, batch_id, triggered_by="stream", **options)

    return (
        raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def history_stream(searches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Arriving searches ``session_id, query, timestamp`` appended to the history at ``path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(history_rows(batch), path, batch_id)

    return (
        searches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
