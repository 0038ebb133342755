"""Stored key sketches: a parquet table to which every batch of a library is appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sketches import merge_sketches


def add_sketches(sketches: DataFrame, path: str) -> None:
    """Append the sketches of a batch. Spark commits the files of a job together, and a batch that is
    appended again after a failure changes no count."""
    sketches.coalesce(1).write.mode("append").parquet(path)


def load_sketches(spark: SparkSession, path: str) -> DataFrame:
    """One merged sketch per library."""
    return merge_sketches(spark.read.parquet(path))
