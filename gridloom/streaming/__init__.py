"""Streaming: cell-wise operators run on streams as they are, since they are plain column
expressions; grids that arrive as whole tiles go through foreachBatch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def per_batch(cells: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Apply an operator to every micro-batch of whole rows and append the result to path."""

    def run(batch: DataFrame, _: int) -> None:
        operator(batch).write.mode("append").parquet(path)

    return cells.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
