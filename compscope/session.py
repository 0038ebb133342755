"""Session set-up and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark's switch that removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str | int = "*", app: str = "compscope", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for lineage cuts: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session (tests) without that setting gets a temporary folder of its own; a
    cluster without it is an error, since a machine-local folder dies with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="compscope-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _run_folder(spark: SparkSession) -> str:
    return os.path.join(shared_folder(spark), "compscope", spark.sparkContext.applicationId)


def checkpoints(spark: SparkSession) -> None:
    """A folder for the checkpoints of iterative fits, if the session has none: the plan of a few hundred rounds
    without one is too deep to be sent."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(os.path.join(_run_folder(spark), "checkpoints"))


def release(spark: SparkSession) -> None:
    """Delete the tables that this application materialised; results read from them are gone too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialise`` returned, when nothing will read it any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a written table are of no further use: they go with the write instead of staying
    until the driver collects garbage. Not beside other threads (``side_by_side``), which share the switch."""
    if (spark.sparkContext.getLocalProperty("spark.scheduler.pool") or "").startswith("side-"):
        yield
        return
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str = "step", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative jobs and freezes values such as partition numbers. The copy is
    a parquet table, so later steps still prune columns, push filters down and see real sizes,
    and a lost executor costs a re-read rather than a re-computation.
    """
    spark = df.sparkSession
    path = os.path.join(_run_folder(spark), f"{name}-{uuid.uuid4().hex}")
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    with _shuffles_removed(spark):
        writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path).select(df.columns)
    table.written_to = path
    return table


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows to all cores in front of heavy per-row work, if the scan has fewer tasks.

    A large table has more input splits than cores already and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
