"""Streams into a log store: each micro-batch is one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seqlake.sources.log_store import LogStore


def ingest(stream: DataFrame, store: LogStore, checkpoint: str, as_log: Callable[[DataFrame], DataFrame] = lambda df: df, **trigger) -> StreamingQuery:
    """Append a stream of log rows, which have their numbers, to a store that takes its commits from this stream alone.

    as_log turns a micro-batch into log rows. A commit has the number of its micro-batch, so one that is
    written again after a failure replaces itself.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.commit_as(number + 1, as_log(batch))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
