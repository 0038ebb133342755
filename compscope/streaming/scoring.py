"""Batch scoring applied to a stream: row by row, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import Model


def score_stream(
    stream: DataFrame, model: Model, path: str, checkpoint: str, name: str = "score"
) -> StreamingQuery:
    """Score a streaming table into parquet files; takes what is there and stops."""
    return (
        model.score(stream, name, digits=4)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
