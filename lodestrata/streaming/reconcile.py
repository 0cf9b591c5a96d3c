"""Incremental ingestion as a stream of dropped files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestrata.sources.store import ChunkStore


def upsert_stream(incoming: DataFrame, store: ChunkStore, table: str, checkpoint: str, newest: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Put each micro-batch into a table of the store by key.

    A batch rewrites only the buckets that it has rows for. Putting rows in by
    key twice gives the same table, so a batch that runs again after a failure
    leaves what it would have left running once.
    """

    def put(batch: DataFrame, number: int) -> None:
        store.upsert(table, batch, newest)

    writer = incoming.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
