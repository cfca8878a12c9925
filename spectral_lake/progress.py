"""Progress of Spark jobs for a caller: a job group, polled from a thread of its own."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_GROUP = "spark.jobGroup.id"


class _Counter:
    """Tasks of a group's stages: (finished, known); neither goes down, though Spark forgets old stages."""

    def __init__(self, spark: SparkSession, group: str) -> None:
        self.tracker, self.group = spark.sparkContext.statusTracker(), group
        self.stages: dict[int, tuple[int, int]] = {}

    def now(self) -> tuple[int, int]:
        for job in self.tracker.getJobIdsForGroup(self.group):
            told = self.tracker.getJobInfo(job)
            for stage in told.stageIds if told else ():
                if info := self.tracker.getStageInfo(stage):
                    done, known = self.stages.get(stage, (0, 0))
                    self.stages[stage] = (max(done, info.numCompletedTasks), max(known, info.numTasks))
        return sum(d for d, _ in self.stages.values()), sum(k for _, k in self.stages.values())


@contextmanager
def reported(spark: SparkSession, callback: Callable[[int, int], None] | None, every: float = 0.2) -> Iterator[None]:
    """Call ``callback(finished, known)`` tasks while the block's jobs run, and once more at the end.

    Counts never go down; ``known`` grows as Spark plans further stages, of which some are skipped.  A callback
    that raises is not called again, and ends nothing.
    """
    if callback is None:
        yield
        return
    context, group = spark.sparkContext, f"spectral-lake-{uuid.uuid4().hex}"
    before, counter, over, last = context.getLocalProperty(_GROUP), _Counter(spark, group), threading.Event(), [(-1, -1)]

    def tell() -> bool:
        now = counter.now()
        if now[0] > last[0][0]:
            last[0] = now
            try:
                callback(*now)
            except Exception:  # the caller's own trouble
                return False
        return True

    def watch() -> None:
        while not over.wait(every):
            if not tell():
                return

    thread = threading.Thread(target=watch, daemon=True)
    context.setLocalProperty(_GROUP, group)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        context.setLocalProperty(_GROUP, before)
        tell()
