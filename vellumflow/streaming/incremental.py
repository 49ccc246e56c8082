"""Arrivals written into keyed tables as they come: a stream's micro-batches upserted into the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vellumflow.operators.state import TableStore


def stream_into(arrivals: DataFrame, store: TableStore, table: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, keep_first: Sequence[str] = (), coalesce: Sequence[str] = (), available_now: bool = True) -> StreamingQuery:
    """Every micro-batch of ``arrivals`` upserted into ``table``; only the buckets its keys fall into are rewritten.

    A batch that is run again after a failure changes nothing: the upsert depends on keys and order alone. Late and repeated
    rows are settled by ``order``, so no watermark is needed; the table is the state.
    """

    def write(batch: DataFrame, _: int) -> None:
        store.upsert(table, batch, keys, order, keep_first, coalesce, compete=True)

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()
