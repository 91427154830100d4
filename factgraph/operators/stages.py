"""Stages of the pipeline that are tried again, and the mode in which files come in.

A stage is a name, a function of a document and how often and when it is tried again. ``run`` drives one document through one
stage and returns the row of its state that follows; ``due`` states are what a poll picks up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from ..functions.times import BASE_SECONDS, MAX_ATTEMPTS


@dataclass(frozen=True)
class Stage:
    name: str
    execute: Callable[[str], None]
    max_retries: int = MAX_ATTEMPTS
    base_seconds: int = BASE_SECONDS

    def backoff_seconds(self, attempt: int) -> int:
        return self.base_seconds * 2 ** (attempt - 1)


@dataclass
class Outcome:
    document_id: str
    status: str
    stage: str
    retry_count: int
    next_retry_at: datetime | None
    error: BaseException | None


@dataclass
class Registry:
    """Stages by name, in the order in which they follow each other."""

    stages: dict[str, Stage] = field(default_factory=dict)

    def add(self, stage: Stage) -> None:
        self.stages[stage.name] = stage

    def run(self, document_id: str, stage: str, retry_count: int, now: datetime) -> Outcome:
        """One attempt: done, or to be tried again later, or given up."""
        own = self.stages[stage]
        try:
            own.execute(document_id)
        except Exception as error:
            attempt = retry_count + 1
            if attempt > own.max_retries:
                return Outcome(document_id, "FAILED_FATAL", stage, attempt, None, error)
            return Outcome(document_id, "RETRYING", stage, attempt, now + timedelta(seconds=own.backoff_seconds(attempt)), error)
        return Outcome(document_id, "DONE", stage, 0, None, None)

    def run_from(self, document_id: str, stage: str, retry_count: int, now: datetime) -> Outcome:
        """From a stage on to the last, or to the first that fails."""
        names = list(self.stages)
        for name in names[names.index(stage) :]:
            out = self.run(document_id, name, retry_count if name == stage else 0, now)
            if out.error is not None:
                return out
        return Outcome(document_id, "QUERYABLE", names[-1], 0, None, None)


#: How long a mode holds without being set again.
MODE_HOURS = 24


@dataclass
class Mode:
    """Realtime or bulk. Bulk jobs need the mode and a directory; while one is active there is no way back to realtime."""

    mode: str = "realtime"
    directory: str | None = None
    active: bool = False
    set_at: datetime | None = None

    def _live(self, now: datetime) -> None:
        if self.set_at is not None and now - self.set_at > timedelta(hours=MODE_HOURS):
            self.mode, self.directory, self.active, self.set_at = "realtime", None, False, None

    def switch(self, mode: str, now: datetime) -> None:
        self._live(now)
        if mode not in ("realtime", "bulk"):
            raise ValueError("a mode is 'realtime' or 'bulk'")
        if mode == "realtime" and self.active:
            raise ValueError("a bulk job is active")
        self.mode, self.set_at = mode, now

    def start(self, directory: str, now: datetime) -> None:
        self._live(now)
        if self.mode != "bulk":
            raise ValueError("not in bulk mode")
        if not (directory or "").strip():
            raise ValueError("a directory is needed")
        self.directory, self.active, self.set_at = directory, True, now

    def stop(self) -> None:
        self.active = False

    def trigger(self, now: datetime) -> dict:
        """How streams run: bulk jobs work off what is there, realtime goes on."""
        self._live(now)
        return {"availableNow": True} if self.mode == "bulk" else {"processingTime": "2 seconds"}
