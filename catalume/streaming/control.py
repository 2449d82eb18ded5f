"""Running categories of work: pause, resume, stop, one at a time, with progress; previews that expire."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from catalume.schema import CATEGORIES
from catalume.streaming.progress import write_batches

EWMA_ALPHA = 0.1


@dataclass
class Run:
    """One generation of a category's work: a streaming query over its chunks, with a checkpoint of its own."""

    generation: int
    checkpoint: str
    query: StreamingQuery | None = None
    state: str = "running"
    done: int = 0
    batches: int = 0
    rate: float = 0.0
    last: float = field(default_factory=time.monotonic)


class Processing:
    """Categories of work as streams of chunks, of which one runs at a time.

    Starting a category while another runs queues it; it starts when that one is through. Pausing
    stops the query, resuming starts it again from its checkpoint, so no chunk is done twice or
    left out. Stopping ends the generation: what a late batch of an old generation hands in is
    dropped, and the next start begins anew.
    """

    def __init__(self, checkpoint: str, source: Callable[[str], DataFrame], sink: Callable[[str, DataFrame, int], None], listener: Callable[[dict], None] | None = None) -> None:
        self.checkpoint, self.source, self.sink, self.listener = checkpoint.rstrip("/"), source, sink, listener
        self.runs: dict[str, Run] = {}
        self.queued: list[str] = []
        self.generations = dict.fromkeys(CATEGORIES, 0)
        self.lock = threading.RLock()

    def start(self, category: str) -> str:
        """Starts the category, or queues it behind the one that is active; the state that it is in then."""
        if category not in CATEGORIES:
            raise ValueError(f"unknown category: {category}")
        with self.lock:
            if self.active(category):
                return self.runs[category].state
            if any(self.active(c) for c in CATEGORIES):
                if category not in self.queued:
                    self.queued.append(category)
                return "queued"
            self.generations[category] += 1
            self.runs[category] = Run(self.generations[category], f"{self.checkpoint}/{category}-{uuid.uuid4().hex}")
            self._go(category)
            return "running"

    def active(self, category: str) -> bool:
        run = self.runs.get(category)
        return run is not None and (run.state == "paused" or run.state == "running" and run.query is not None and run.query.isActive)

    def _go(self, category: str) -> None:
        run = self.runs[category]
        run.state, run.last = "running", time.monotonic()
        run.query = write_batches(self.source(category), lambda df, k: self._batch(category, run.generation, df, k), run.checkpoint)

    def _batch(self, category: str, generation: int, df: DataFrame, number: int) -> None:
        run = self.runs.get(category)
        if run is None or run.generation != generation or run.state == "stopped":
            return  # stale: its generation is over
        n = df.count()
        self.sink(category, df, number)
        now = time.monotonic()
        speed = n / max(now - run.last, 1e-9)
        run.rate = speed if run.rate == 0 else EWMA_ALPHA * speed + (1 - EWMA_ALPHA) * run.rate
        run.done, run.batches, run.last = run.done + n, run.batches + 1, now
        if self.listener:
            self.listener(self.progress(category))

    def pause(self, category: str) -> None:
        with self.lock:
            run = self.runs.get(category)
            if run and run.state == "running" and run.query is not None and run.query.isActive:
                run.state = "paused"
                run.query.stop()

    def resume(self, category: str) -> None:
        with self.lock:
            run = self.runs.get(category)
            if run and run.state == "paused":
                self._go(category)

    def stop(self, category: str) -> None:
        """Ends the category's generation, running, paused or queued, and lets the next queued one start."""
        with self.lock:
            self.queued = [c for c in self.queued if c != category]
            run = self.runs.get(category)
            if run and run.state in ("running", "paused"):
                run.state = "stopped"
                self.generations[category] += 1
                if run.query is not None:
                    run.query.stop()
            self._next()

    def stop_all(self) -> None:
        with self.lock:
            self.queued = []
            for category in CATEGORIES:
                self.stop(category)

    def wait(self, timeout: float = 600.0) -> None:
        """Returns when nothing runs or waits any more; paused categories are not waited for."""
        until = time.monotonic() + timeout
        while time.monotonic() < until:
            running = [r.query for r in self.runs.values() if r.state == "running" and r.query is not None and r.query.isActive]
            for query in running:
                query.awaitTermination(max(0, min(5, int(until - time.monotonic()))))
            with self.lock:
                self._next()
                if not self.queued and not any(r.state == "running" and r.query is not None and r.query.isActive for r in self.runs.values()):
                    return
        raise TimeoutError("work is still running")

    def _next(self) -> None:
        for run in self.runs.values():
            if run.state == "running" and run.query is not None and not run.query.isActive:
                error = run.query.exception()
                run.state = "failed" if error else "done"
        if self.queued and not any(self.active(c) for c in CATEGORIES):
            self.start(self.queued.pop(0))

    def progress(self, category: str) -> dict:
        """What a progress event carries: state, generation, rows and batches done, rows a second (smoothed)."""
        run = self.runs.get(category)
        state = "queued" if category in self.queued else run.state if run else "idle"
        return {"category": category, "state": state, "generation": run.generation if run else 0, "done": run.done if run else 0, "batches": run.batches if run else 0, "rate": run.rate if run and state == "running" else 0.0}


class Previews:
    """Previews of rescans: one for each folder, consumed when applied, not valid for longer than `seconds`."""

    def __init__(self, seconds: float = 1800.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.seconds, self.clock = seconds, clock
        self.held: dict[int, tuple[float, DataFrame]] = {}

    def put(self, folder_id: int, found: DataFrame) -> None:
        """Keeps the preview in place of any other of the folder."""
        self.held[folder_id] = (self.clock(), found)

    def take(self, folder_id: int) -> DataFrame:
        if folder_id not in self.held:
            raise LookupError(f"no pending rescan preview for folder {folder_id}")
        made, found = self.held.pop(folder_id)
        if self.clock() - made > self.seconds:
            raise TimeoutError(f"the rescan preview is older than {self.seconds / 60:g} minutes; preview again")
        return found
