"""Structured Streaming around the batch fold: each micro-batch is consumed and published once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from chronofold.plans import ingest
from chronofold.sources.logs import LogSource


def consume_stream(changes: DataFrame, name: str, store, decode: Callable[[DataFrame], DataFrame], checkpoint: str, max_batch_size: int = ingest.MAX_BATCH) -> StreamingQuery:
    """Start a query that folds a streaming change log into a store. Offsets up to the store's cursor are
    skipped, so a batch that is run again publishes nothing twice."""

    def batch(df: DataFrame, batch_id: int) -> None:
        ingest.consume(LogSource(df, name), store, decode, max_batch_size=max_batch_size)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
