"""Adding records to an index as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corvane.sources.index import VectorIndex


def stream_index(
    records: DataFrame,
    index: VectorIndex,
    encode: Callable[[DataFrame], DataFrame],
    checkpoint_path: str,
    name: str = "stream",
    **trigger,
) -> StreamingQuery:
    """Encode and add every micro-batch of a streaming frame; ``index.stats()`` tells the new counts.

    Each micro-batch is an ingest of its own, which a replay after a failure replaces, so every record is stored once.
    Small batches are written together as they become many.
    """

    def add(batch: DataFrame, epoch: int) -> None:
        index.add(encode(batch), ingest=f"{name}-{epoch}")
        index.compact_tiers()

    return (
        records.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint_path)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
