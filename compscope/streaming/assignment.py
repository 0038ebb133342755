"""Cluster assignment of a stream of compounds by their group key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def with_cluster(rows: DataFrame, centroids: DataFrame, dataset: str, key: str) -> DataFrame:
    """``rows``, a table or a stream, with the ``cluster_ID`` of the centroid that has their own key, or
    null if there is none (those are left to ``assign_clusters``). A row stays one row."""
    lookup = centroids.groupBy(dataset, key).agg(F.min("cluster_ID").alias("cluster_ID"))
    return rows.join(lookup, [dataset, key], "left").select(*rows.columns, "cluster_ID")


def assign_stream(
    stream: DataFrame, centroids: DataFrame, dataset: str, key: str, path: str, checkpoint: str
) -> StreamingQuery:
    """Assign a stream, scored or not, into parquet files; takes what is there and stops.

    The join with the centroid table keeps no state. The file sink and the checkpoint together give
    every row once, also if a run ends in the middle of a batch and is started again. For equal answers
    after a restart take a stored version of the centroids (``load_leaders``).
    """
    return (
        with_cluster(stream, centroids, dataset, key)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
