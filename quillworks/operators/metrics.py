"""Counters and progress of jobs, taken from the pass that does the work."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import quality


class Counters:
    """Sums over everything that was written through ``watch`` since the last reset.

    Watched rows are counted as they pass, in the tasks that write them; no second pass reads them. A frame that is written twice counts for its first time.
    """

    def __init__(self, **counts: Column):
        self.counts = counts
        self.reset()

    def reset(self) -> None:
        self._watched: list[Observation] = []

    def watch(self, df: DataFrame) -> DataFrame:
        seen = Observation(f"counters-{uuid.uuid4().hex}")
        self._watched.append(seen)
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.sum(c).alias(n) for n, c in self.counts.items()))

    def totals(self) -> dict[str, float]:
        """rows and the sum of each count; waits for watched frames that are not written yet. Nulls count 0."""
        told = [x.get for x in self._watched]
        return {name: sum(t.get(name) or 0 for t in told) for name in ("rows", *self.counts)}


def text_counters(before: str, after: str, seconds: str | None = None) -> Counters:
    """What a text processor tells of itself: corrections by length and words, changed texts, and seconds where rows have them."""
    counts = {"total_corrections": quality.corrections(F.col(before), F.col(after)).cast("long"), "changed": (~F.col(before).eqNullSafe(F.col(after))).cast("long")}
    return Counters(**counts, **({"total_seconds": F.col(seconds).cast("double")} if seconds else {}))


def with_progress(spark: SparkSession, action: Callable, report: Callable[[int, int], None], every: float = 0.5):
    """Runs ``action`` and calls ``report(done, all)`` with its tasks while it runs, and once at its end; returns what it returns.

    Tasks are those of the stages that Spark knows of by then, so ``all`` grows from job to job; at the end, stages that were not needed are left out. A report that fails does not stop the action.
    """
    group, ended = f"progress-{uuid.uuid4().hex}", threading.Event()
    tracker = spark.sparkContext.statusTracker()
    done: dict[int, tuple[int, int]] = {}

    def look(at_end: bool = False) -> None:
        for job in tracker.getJobIdsForGroup(group):
            for stage in getattr(tracker.getJobInfo(job), "stageIds", []):
                if told := tracker.getStageInfo(stage):
                    done[stage] = (told.numCompletedTasks, told.numTasks if told.numCompletedTasks or not at_end else 0)
        try:
            report(sum(a for a, _ in done.values()), sum(b for _, b in done.values()))
        except Exception:  # the work goes on whatever listens to it
            pass

    def poll() -> None:
        while not ended.wait(every):
            look()

    spark.sparkContext.setJobGroup(group, "work with progress")
    watcher = threading.Thread(target=poll, daemon=True)
    watcher.start()
    try:
        return action()
    finally:
        ended.set()
        watcher.join()
        look(True)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
