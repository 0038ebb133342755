import threading
import time

import pytest
from pyspark.sql import functions as F

from compscope.operators import models
from compscope.parallel import POOL, side_by_side


def test_results_in_order_properties_inherited(spark):
    sc = spark.sparkContext
    sc.setLocalProperty("compscope.test", "mine")
    seen = []

    def task(i):
        seen.append((sc.getLocalProperty("compscope.test"), sc.getLocalProperty(POOL)))
        return spark.range(i).count()

    assert side_by_side(spark, [lambda i=i: task(i) for i in range(6)], 3) == list(range(6))
    assert {p for p, _ in seen} == {"mine"} and {q for _, q in seen} <= {"side-0", "side-1", "side-2"}
    assert not sc.getLocalProperty(POOL) and not sc.getJobTags()
    sc.setLocalProperty("compscope.test", None)
    assert side_by_side(spark, []) == []


def test_tasks_run_at_the_same_time(spark):
    meet = threading.Barrier(3, timeout=30)
    assert len(side_by_side(spark, [meet.wait] * 3, 3)) == 3


def test_a_failure_ends_the_siblings(spark):
    started = []

    def slow():
        started.append(1)
        # Sleeps for minutes in all, in many jobs.
        for _ in range(100):
            spark.range(0, 8, 1, 8).select(F.expr("java_method('java.lang.Thread', 'sleep', 5000L)")).collect()

    def bad():
        while not started:
            time.sleep(0.05)
        time.sleep(1)
        raise ValueError("a fit failed")

    begin = time.perf_counter()
    with pytest.raises(ValueError, match="a fit failed"):
        side_by_side(spark, [slow, bad, slow, slow], 2)
    assert time.perf_counter() - begin < 60
    assert len(started) <= 2
    assert spark.range(3).count() == 3


def test_cycles_side_by_side_equal_one_after_the_other(spark):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(240).select(
        (F.col("id") % 3 + 1).cast("int").alias("cycle"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
        (F.col("id") % 2).cast("double").alias("label"),
        array_to_vector(F.array(F.col("id") % 2 + F.rand(3) * 0.1, F.rand(5))).alias("a"),
        array_to_vector(F.array(F.rand(7), F.rand(11))).alias("b"),
    )
    from compscope.session import materialise

    rows = materialise(rows, "rows")
    names = ["RandomForest", "ExtraTrees"]

    def scores(df):
        return sorted((r["algo"], r["cycle"], r["ACC"], r["AUC"]) for r in df.collect())

    one = scores(models.cross_validate(rows, 3, models.CLASSIFIER, names, "a", 3, 2, at_once=1))
    assert one == scores(models.cross_validate(rows, 3, models.CLASSIFIER, names, "a", 3, 2, at_once=3))
    assert len(one) == 6
    split = rows.drop("cycle")
    summary, cv = models.benchmark_grid(split, rows, 3, models.CLASSIFIER, ["a", "b"], names, 3, 2)
    assert sorted((r["desc"], r["algo"]) for r in summary.collect()) == [(d, m) for d in "ab" for m in sorted(names)]
    assert scores(cv.where("desc = 'a'")) == one and cv.count() == 12


def test_cycles_are_written_without_a_sort_and_large_fits_wait(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(200).select(
        (F.col("id") % 2 + 1).cast("int").alias("cycle"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
        (F.col("id") % 3 % 2).cast("double").alias("label"),
        array_to_vector(F.array(F.col("id") % 3 % 2 + F.rand(3) * 0.1, F.rand(5))).alias("features"),
    )
    written, widths = [], []
    write, beside = models.materialise, models.side_by_side
    monkeypatch.setattr(models, "materialise", lambda df, name="step", **kw: written.append((name, kw)) or write(df, name, **kw))
    monkeypatch.setattr(models, "side_by_side", lambda s, tasks, n=4: widths.append(n) or beside(s, tasks, n))
    monkeypatch.setattr(models, "FIT_BYTES", 1)
    out = models.cross_validate(rows, 2, models.CLASSIFIER, ["RandomForest", "ExtraTrees"], trees=2, depth=2)
    assert sorted(r["cycle"] for r in out.collect()) == [1, 1, 2, 2]
    assert not any(kw.get("partition_by") for _, kw in written)
    assert [n for n, _ in written].count("cycle") == 2
    # The rows are written side by side; the cycles and the two fits of each are not run so.
    assert widths == [4, 1, 1, 1]
