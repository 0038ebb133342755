"""Independent Spark jobs from several driver threads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target

T = TypeVar("T")
POOL = "spark.scheduler.pool"


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], T]], at_once: int = 4) -> list[T]:
    """The results of ``tasks`` in their order, up to ``at_once`` of them running at a time.

    A thread takes over the caller's local properties, job tags among them. If the caller has chosen no scheduler
    pool, every thread gets one of its own, so that under ``spark.scheduler.mode=FAIR`` the tasks
    share the cluster (in the default mode pools have no effect). All jobs carry one tag: the first
    failure cancels those that run, drops the tasks that wait and is raised.
    """
    tasks = list(tasks)
    if not tasks:
        return []
    sc = spark.sparkContext
    tag = f"side-by-side-{uuid.uuid4().hex}"

    def tagged(i: int, task: Callable[[], T]) -> Callable[[], T]:
        def run() -> T:
            if not sc.getLocalProperty(POOL):
                sc.setLocalProperty(POOL, f"side-{i % at_once}")
            sc.addJobTag(tag)
            return task()

        return inheritable_thread_target(spark)(run)

    with ThreadPoolExecutor(at_once) as pool:
        # The properties of the calling thread are copied here, before a worker thread sets its own.
        running = [pool.submit(tagged(i, task)) for i, task in enumerate(tasks)]
        done, left = wait(running, return_when=FIRST_EXCEPTION)
        failed = next((f for f in running if f in done and f.exception()), None)
        if failed is None:
            return [f.result() for f in running]
        for f in left:
            f.cancel()
        while left:  # a sibling between two jobs is met at its next one
            sc.cancelJobsWithTag(tag)
            left = {f for f in wait(left, timeout=0.2).not_done if not f.cancelled()}
        raise failed.exception()
