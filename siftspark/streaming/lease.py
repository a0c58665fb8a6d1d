"""One writer at a time and the run log, in storage that all machines share.

A lease is a commit of its own log: the number of the commit that took it is its token, which only grows. Whoever holds
it checks the token before each commit to a table, so a writer that was taken for dead can write nothing once another lease was
given. A lease is never taken over by age: one that is held too long is refused with a hint, and somebody must ``clear`` it. While
a file ``ACTION_REQUIRED`` lies beside it nobody is given one.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..sources.commits import CommitLog
from ..sources.tables import exists
from .increment import LOCK_SECONDS, LockHeld, RunLog

#: Fixed value: the name of the file that stops writers.
BLOCK = "ACTION_REQUIRED"


class Lease:
    def __init__(self, spark: SparkSession, root: str, token: int, purpose: str):
        self.spark, self.root, self.token, self.purpose = spark, root, token, purpose
        self.log = CommitLog(spark, root)

    def check(self) -> None:
        """Raises unless this lease is still the newest and writers are not stopped; the guard of a table's commits."""
        blocked(self.spark, self.root)
        version, state = self.log.newest()
        if version != self.token or state["released"]:
            raise LockHeld(f"the lease {self.token} for {self.purpose} is over: {version} was given since")


def blocked(spark: SparkSession, root: str) -> None:
    if exists(spark, f"{root}/{BLOCK}"):
        raise LockHeld(f"writers are stopped: {root}/{BLOCK} must be dealt with and removed first")


@contextmanager
def lease(spark: SparkSession, root: str, purpose: str, *, longest: float = LOCK_SECONDS, now: float | None = None) -> Iterator[Lease]:
    """The lease at ``root`` for as long as the block runs; ``LockHeld`` at once if another writer has it."""
    if not (purpose or "").strip():
        raise ValueError("a purpose is needed")
    at = time.time() if now is None else now
    blocked(spark, root)
    log = CommitLog(spark, root)
    version, state = log.newest()
    if state and not state["released"]:
        late = f" for more than {longest / 3600:g} h: look into it, it is not taken over" if at - state["since"] > longest else ""
        raise LockHeld(f"another writer holds the lease{late}: {state['purpose']}, token {version}")
    if not log.put(version + 1, {"purpose": purpose.strip(), "since": at, "released": False}):
        raise LockHeld("another writer was faster")
    held = Lease(spark, root, version + 1, purpose.strip())
    try:
        yield held
    finally:
        # only if nobody has cleared it
        if log.newest()[0] == held.token:
            log.put(held.token + 1, {"purpose": held.purpose, "since": at, "released": True})


def clear(spark: SparkSession, root: str) -> bool:
    """Ends a lease whose holder is gone; whether there was one. Its holder, should it still run, fails at its next commit."""
    log = CommitLog(spark, root)
    version, state = log.newest()
    return bool(state) and not state["released"] and log.put(version + 1, state | {"released": True})


class SharedRunLog(RunLog):
    """The run log as commits, so that runs on several machines see one."""

    def __init__(self, spark: SparkSession, root: str):
        self.log = CommitLog(spark, root)

    def read(self) -> dict[str, float]:
        return self.log.newest()[1] or {}

    def stamp(self, phase: str, at: float | None = None) -> None:
        moment = time.time() if at is None else at
        self.log.commit(lambda rows: (rows or {}) | {phase: moment})
