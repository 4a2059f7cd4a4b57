"""Jobs of a workspace: progress, heartbeat and cancellation.

A job's Spark jobs share a job group. A thread beside them reads the status tracker once a `BEAT`, writes how many tasks are done to the progress
file and touches the lock, however long a Spark job takes; a cancel file, which any process may put there, cancels the group. Tables
change by pointers only, so a cancelled job leaves the catalog as its last pointer has it.
"""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

BEAT = 1.0


class Cancelled(RuntimeError):
    """The job was asked to stop."""


class Running:
    """A job while it runs: `with Running(...) as job`, whose state in the catalog is done, failed or cancelled afterwards."""

    def __init__(self, spark: SparkSession, catalog: object, folder: str, kind: str, session_id: int | None, touch: Callable[[], None]):
        self.spark, self.catalog, self.folder, self.kind, self.session_id, self.touch = spark, catalog, folder, kind, session_id, touch
        self.cancelled, self.step, self.began = False, "", time.time()
        self._stop = threading.Event()

    @property
    def cancel_path(self) -> str:
        return os.path.join(self.folder, f"cancel-{self.id}")

    def __enter__(self) -> Running:
        self.id = self.catalog.create_job(self.kind, self.session_id)
        self.group = f"tidemill-{self.kind}-{self.id}"
        self.spark.sparkContext.setJobGroup(self.group, self.kind, interruptOnCancel=True)
        self._thread = threading.Thread(target=self._beat, daemon=True)
        self._thread.start()
        return self

    def at(self, step: str) -> None:
        """Names the step that comes; stops here if the job was cancelled."""
        self.step = step
        if self.cancelled or os.path.exists(self.cancel_path):
            self.cancelled = True
            raise Cancelled(self.kind)

    def progress(self) -> dict:
        """Tasks of the group's running stages, and those done of them."""
        tracker, total, done = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            if info is None or info.status != "RUNNING":
                continue
            for stage in info.stageIds:
                own = tracker.getStageInfo(stage)
                if own is not None:
                    total, done = total + own.numTasks, done + own.numCompletedTasks
        return {"job": self.id, "kind": self.kind, "step": self.step, "done": done, "total": total, "seconds": round(time.time() - self.began, 1)}

    def _beat(self) -> None:
        while not self._stop.wait(BEAT):
            try:
                self.touch()
                beside = os.path.join(self.folder, "progress.next")
                with open(beside, "w", encoding="utf-8") as f:
                    json.dump(self.progress(), f)
                os.replace(beside, os.path.join(self.folder, "progress.json"))
                if os.path.exists(self.cancel_path):
                    self.cancelled = True
                    self.spark.sparkContext.cancelJobGroup(self.group)
            except Exception:  # a beat that fails, as the session ends, must not end the job
                continue

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        self._stop.set()
        self._thread.join()
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name in (self.cancel_path, os.path.join(self.folder, "progress.json")):
            if os.path.exists(name):
                os.unlink(name)
        state = "done" if error is None else "cancelled" if self.cancelled else "failed"
        self.catalog.update_job(self.id, state, progress={"seconds": round(time.time() - self.began, 1)}, error=str(error)[:2000] if state == "failed" else None)
        if self.cancelled and error is not None and not isinstance(error, Cancelled):
            raise Cancelled(self.kind) from error
