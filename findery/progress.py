"""How far the jobs of a session are, told while they run."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import SparkSession

Told = Callable[[str, int, int], None]


@contextmanager
def watch(spark: SparkSession, told: Told, label: str = "", every: float = 0.5) -> Iterator[None]:
    """Calls told(label, tasks done, tasks known so far) from a thread whenever the numbers have changed, and once at the
    end, for the jobs that this thread starts inside the block. Errors of told end the telling, not the jobs."""
    sc = spark.sparkContext
    group, tracker = f"watch-{uuid.uuid4().hex}", sc.statusTracker()
    before = sc.getLocalProperty("spark.jobGroup.id")
    sc.setLocalProperty("spark.jobGroup.id", group)
    over, stages, last = threading.Event(), {}, [None]

    def look() -> None:
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if found := tracker.getStageInfo(stage):
                    stages[stage] = found.numCompletedTasks, found.numTasks
        now = sum(done for done, _ in stages.values()), sum(n for _, n in stages.values())
        if now != last[0]:
            last[0] = now
            told(label, *now)

    def loop() -> None:
        with suppress(Exception):
            while not over.wait(every):
                look()
            look()

    thread = threading.Thread(target=loop, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        sc.setLocalProperty("spark.jobGroup.id", before)
