"""Queries that arrive as a stream, answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def answer_stream(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream that answers each batch of queries (query_id, qvec, lo, hi) and writes it to a folder of its own below out.

    A batch that is run again overwrites its folder, so each query is answered once. trigger: as of writeStream.trigger, all that is there by default.
    """

    def write(batch: DataFrame, number: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
