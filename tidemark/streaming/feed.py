"""Append streams and change streams. An append's batch number is its transaction, so a batch that is run again after a
failure commits once; a change stream's offset is a version."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..lake import Lake


def append_stream(stream: DataFrame, lake: Lake, table: str, checkpoint: str, name: str, **trigger) -> StreamingQuery:
    """Appends a stream's batches to a table, each in one commit."""

    def append(batch: DataFrame, number: int) -> None:
        lake.insert(table, batch, txn=f"{name}:{number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def change_batches(lake: Lake, table: str, start: int, most: int = 100) -> Iterator[tuple[int, int, DataFrame]]:
    """(first, last, changes) of windows of up to `most` versions from `start` to the newest one."""
    newest = lake.version()
    while start <= newest:
        end = min(newest, start + most - 1)
        yield start, end, lake.changes(table, start, end)
        start = end + 1


def follow(lake: Lake, table: str, start: int, handle: Callable[[DataFrame, int], None], most: int = 100) -> int:
    """Hands each window of changes to `handle` with its last version; the version to go on from."""
    for _, end, rows in change_batches(lake, table, start, most):
        handle(rows, end)
        start = end + 1
    return start
