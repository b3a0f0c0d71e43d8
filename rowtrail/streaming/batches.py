"""Provenance for Structured Streaming, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.traced import Traced
from ..session import RowTrail


def trace_batches(trail: RowTrail, stream: DataFrame, query: Callable[[Traced], Traced], sink: Callable[[Traced, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run ``query`` over each micro-batch; ``sink`` gets the traced result and the batch's number.

    The batch's rows are written with their ids first, so a batch that is tried
    again after a failure is traced like the first time.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(query(trail.frame(batch, f"batch {number}")), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
