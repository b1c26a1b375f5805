"""The monitor of a code base: its loop, and what it reports and takes as plain functions."""

from __future__ import annotations

import threading
import time
from collections import deque
from datetime import UTC, datetime

from pyspark.sql import DataFrame, functions as F

from skarn.plans.ingest import CodeBase, Report
from skarn.functions.exprs import EXTENSIONS
from skarn.sources.files import GitRange
from skarn.streaming.monitor import Gate, Pending

VERSION = "1.0.0"
EVENT_BUFFER = 100


class Events:
    """A bounded event buffer: the newest are dropped when it is full; every subscriber has its own."""

    def __init__(self, size: int = EVENT_BUFFER):
        self.size = size
        self.queues: list[deque] = []

    def subscribe(self) -> deque:
        queue: deque = deque([{"type": "connected", "timestamp": _now(), "details": {"message": "Connected to monitor events"}}])
        self.queues.append(queue)
        return queue

    def unsubscribe(self, queue: deque) -> None:
        self.queues = [q for q in self.queues if q is not queue]

    def publish(self, kind: str, path: str, details: dict | None = None) -> None:
        event = {"type": kind, "file_path": path, "timestamp": _now()} | ({"details": details} if details else {})
        for queue in self.queues:
            if len(queue) < self.size:
                queue.append(event)


def _now() -> str:
    return datetime.now(UTC).isoformat()


class Monitor:
    """Follows a tree: ``run`` polls it and its git repository, ingests what changed and keeps the figures.

    While paused, removals go on and nothing is parsed; what changed meanwhile is found at
    the first poll after.  A poll that fails is repeated with the next one, as the state
    has not moved; paths named by git are queued, and dropped at their third failure.
    """

    def __init__(self, code: CodeBase, git: GitRange | None = None, poll_seconds: float = 5.0, git_seconds: float = 30.0, pending: Pending | None = None):
        self.code, self.git, self.gate, self.events = code, git, Gate(), Events()
        self.poll_seconds, self.git_seconds, self.pending = poll_seconds, git_seconds, pending or Pending()
        self.next_poll = self.next_git = float("-inf")
        self.started, self.running = _now(), True
        self.totals = {"total_batches": 0, "total_changes": 0, "processing_time": 0.0, "errors": 0}
        self.durations: deque = deque(maxlen=1000)
        self.changed = self.errors = 0
        self.last_change: str | None = None
        self.last_error: str | None = None
        self.lock = threading.RLock()  # one ingest at a time

    def poll(self, force: bool = False, only: DataFrame | None = None) -> Report | None:
        """Ingests what changed (of ``only``); None if the monitor is paused and nothing was removed."""
        paused = self.gate.paused and not force
        began = time.monotonic()
        with self.lock:
            report = self.code.ingest(force, only, removals_only=paused)
        took, n = time.monotonic() - began, report.parsed + report.removed
        if n:
            self._count(n, took, bool(report.errors))
            self.durations.extend([took / max(1, report.parsed)] * min(report.parsed, 1000))
            self.changed += n
            self.errors += report.errors
            self.last_change = _now()
            self.events.publish("batch", self.code.root, {"parsed": report.parsed, "removed": report.removed})
        return None if paused and not n else report

    def _count(self, size: int, took: float, failed: bool) -> None:
        for name, value in zip(("total_batches", "total_changes", "processing_time", "errors"), (1, size, took, failed), strict=True):
            self.totals[name] += value

    def _failed(self, error: Exception) -> None:
        self.errors += 1
        self.last_error = f"{type(error).__name__}: {error}"
        self.events.publish("error", self.code.root, {"message": self.last_error})

    def flush(self, now: float) -> list[str]:
        """Ingests the queued paths; the dropped ones, if that failed."""
        taken = self.pending.take(now)
        if not taken:
            return []
        began = time.monotonic()
        try:
            self.poll(only=self.code.spark.createDataFrame([(p,) for p in taken], "path string"))
        except Exception as e:  # noqa: BLE001 - a batch that fails must not end the loop
            self._failed(e)
            self._count(len(taken), time.monotonic() - began, True)
            return self.pending.failed(taken)
        return []

    def step(self, now: float) -> None:
        """One turn of the loop: asks git, flushes and polls, each if it is time."""
        if self.git is not None and now >= self.next_git:
            self.next_git = now + self.git_seconds
            try:
                for row in self.git_changes().where(F.col("path").rlike(f"({'|'.join(e.replace('.', '[.]') for e in EXTENSIONS)})\"?$")).toLocalIterator():
                    self.pending.add(row["path"].strip('"'))
            except Exception as e:  # noqa: BLE001
                self._failed(e)
        if self.pending.due(now):
            self.flush(now)
        if now >= self.next_poll:
            self.next_poll = now + self.poll_seconds
            try:
                self.poll()
            except Exception as e:  # noqa: BLE001
                self._failed(e)

    def run(self, stop: threading.Event, wait: float = 1.0) -> None:
        """Steps until ``stop`` is set, and then flushes what is queued."""
        self.running = True
        while not stop.wait(wait):
            self.step(time.monotonic())
        self.flush(time.monotonic())
        self.running = False

    def git_changes(self) -> DataFrame:
        """(path, action): process for added and modified files, remove for deleted ones."""
        if self.git is None:
            raise ValueError("no git repository is watched")
        rows = self.git.changes(self.code.spark)
        return rows.select("path", F.when(F.col("status") == "D", "remove").otherwise("process").alias("action"))

    def status(self) -> dict:
        return {"running": self.running, "paused": self.gate.paused, "start_time": self.started, "version": VERSION}

    def stats(self) -> dict:
        mean = sum(self.durations) / len(self.durations) if self.durations else 0.0
        n = self.totals["total_batches"]
        metrics = self.totals | {"average_batch_size": self.totals["total_changes"] / n} if n else None
        files = self.code.state.read().count()
        return {
            "files_monitored": files, "files_processed": self.changed, "changes_detected": self.changed, "errors": self.errors, "last_change": self.last_change,
            "processing_time": mean, "average_processing_time": mean, "batch_metrics": metrics, "cache_size": files,
        }

    def files(self) -> dict:
        names = [r["path"] for r in self.code.state.read().select("path").orderBy("path").toLocalIterator()]
        return {"total": len(names), "files": names}

    def file(self, path: str) -> dict:
        return {"path": path, "monitored": bool(self.code.state.read().where(F.col("path") == path).limit(1).count()), "timestamp": _now()}

    def changes(self) -> dict:
        return {"last_change": self.last_change, "changes_detected": self.changed, "files_processed": self.changed}

    def rescan(self, force: bool = True) -> dict:
        self.poll(force)
        return {"status": "rescanned", "path": self.code.root, "force": force, "timestamp": _now()}

    def pause(self) -> dict:
        self.gate.paused = True
        return {"status": "paused", "timestamp": _now()}

    def resume(self) -> dict:
        self.gate.paused = False
        return {"status": "resumed", "timestamp": _now()}
