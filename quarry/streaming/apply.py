"""Fitted steps and models are projections, so they run on a stream unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def transform_stream(stream: DataFrame, *steps) -> DataFrame:
    """Apply fitted steps (anything with ``transform``) to a streaming DataFrame."""
    for step in steps:
        stream = step.transform(stream)
    return stream


def profile_stream(stream: DataFrame, report: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``report(batch, id)`` on each micro-batch, for example to profile it."""
    return stream.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
