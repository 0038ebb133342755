"""Assignment of streams, with a run that fails in the middle."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from compscope.streaming.assignment import assign_stream, with_cluster

SCHEMA = "id bigint, lib string, scaffold string"


def test_every_row_once_after_a_failure_in_the_middle(spark, tmp_path):
    centroids = spark.createDataFrame(
        [("A", "s0", 0), ("A", "s1", 1), ("A", "s1", 7), ("B", "s0", 2)], "lib string, scaffold string, cluster_ID int"
    )
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = [(i, "AB"[i % 2], None if i % 7 == 0 else f"s{i % 3}") for i in range(40)]
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(bad):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        broken = F.when(F.col("id") == bad, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("bigint")
        query = assign_stream(stream.withColumn("id", broken), centroids, "lib", "scaffold", out, cp)
        query.awaitTermination(120)

    with pytest.raises(StreamingQueryException):
        run(25)
    done = spark.read.schema(SCHEMA).parquet(out).count()
    assert 0 < done < 40  # some batches are through, others are not
    run(-1)
    run(-1)  # nothing new
    got = {(r["id"], r["cluster_ID"]) for r in spark.read.parquet(out).collect()}
    known = {("A", "s0"): 0, ("A", "s1"): 1, ("B", "s0"): 2}
    assert got == {(i, known.get((lib, s))) for i, lib, s in rows}
    assert spark.read.parquet(out).count() == 40


def test_tables_are_assigned_alike(spark):
    centroids = spark.createDataFrame([("A", "s", 3)], "lib string, scaffold string, cluster_ID int")
    rows = spark.createDataFrame([(1, "A", "s"), (1, "A", "s"), (2, "B", "s"), (3, None, None)], SCHEMA)
    got = sorted((r["id"], r["cluster_ID"]) for r in with_cluster(rows, centroids, "lib", "scaffold").collect() if r["id"] < 3)
    assert got[:2] == [(1, 3), (1, 3)] and got[2] == (2, None)
    assert with_cluster(rows.limit(0), centroids, "lib", "scaffold").count() == 0
    assert with_cluster(rows, centroids.limit(0), "lib", "scaffold").where("cluster_ID IS NULL").count() == 4
