"""Stored leader tables: a folder with a version per added library."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that were written to their end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    found = [int(n.removeprefix("version-")) for n in names if n.startswith("version-")]
    return sorted(v for v in found if system.exists(hadoop.Path(f"{path}/version-{v}/record/_SUCCESS")))


def save_leaders(
    spark: SparkSession, leaders: DataFrame, path: str, fingerprint: str, min_similarity: float, note: str = ""
) -> int:
    """Write leaders as the next version, with a record of what they were clustered by, and return its
    number. The record is written last: a version without it does not count, and its number is used
    again. Earlier versions stay as they are, and ``leaders`` may read from them."""
    known = _versions(spark, path)
    if known:
        old = leader_record(spark, path)
        if (old["fingerprint"], old["min_similarity"]) != (fingerprint, min_similarity):
            raise ValueError(f"these leaders are of {old['fingerprint']} at {old['min_similarity']}")
    version = known[-1] + 1 if known else 0
    leaders.write.mode("overwrite").parquet(f"{path}/version-{version}/leaders")
    record = {"fingerprint": fingerprint, "min_similarity": min_similarity, "note": note, "version": version}
    rows = spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1)
    rows.write.mode("overwrite").text(f"{path}/version-{version}/record")
    return version


def _chosen(spark: SparkSession, path: str, version: int | None) -> int:
    known = _versions(spark, path)
    if version is None and known:
        return known[-1]
    if version not in known:
        raise FileNotFoundError(f"no version {'' if version is None else version} of leaders in {path}")
    return version


def leader_record(spark: SparkSession, path: str, version: int | None = None) -> dict:
    version = _chosen(spark, path, version)
    return json.loads(spark.read.text(f"{path}/version-{version}/record").first()["value"])


def load_leaders(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The leaders of a version, the last one by default."""
    return spark.read.parquet(f"{path}/version-{_chosen(spark, path, version)}/leaders")
