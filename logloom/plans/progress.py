"""Counts of a run while it is written, from the metrics of its finished tasks."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import datetime

from py4j.protocol import Py4JError

from logloom.plans.store import Store


class Watch:
    """Records the lines that the jobs started inside it have written, every few seconds.

    The figures are those that executors report when a task ends, or with their
    heartbeat; lines of a task that is repeated count once. A count is a small file
    written by the driver, so it does not wait for a free core.
    """

    def __init__(self, store: Store, run: str, clock: Callable[[], datetime], every: float):
        if every <= 0:
            raise ValueError("the time between counts must be above zero")
        self.store, self.run, self.clock, self.every = store, run, clock, every
        self.tag = f"import-{uuid.uuid4().hex}"
        self.last = -1
        self._over = threading.Event()
        self._thread = threading.Thread(target=self._poll, daemon=True)

    def __enter__(self) -> Watch:
        self.store.spark.sparkContext.addJobTag(self.tag)
        self._thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.store.spark.sparkContext.removeJobTag(self.tag)
        self._over.set()
        self._thread.join()

    def counts(self) -> tuple[int, int, int]:
        """Lines written, tasks done and tasks known so far."""
        context = self.store.spark.sparkContext._jsc.sc()
        tracker, status = context.statusTracker(), context.statusStore()
        lines = done = tasks = 0
        for job in tracker.getJobIdsForTag(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.get().stageIds() if info.isDefined() else ():
                try:
                    seen = status.lastStageAttempt(stage)
                except Py4JError:
                    continue  # not started, or no longer remembered
                lines += seen.outputRecords()
                done += seen.numCompleteTasks()
                tasks += seen.numTasks()
        return lines, done, tasks

    def _poll(self) -> None:
        while not self._over.wait(self.every):
            lines, done, tasks = self.counts()
            if lines > self.last:
                self.last = lines
                self.store.write_progress(self.run, self.clock(), lines, done, tasks)
