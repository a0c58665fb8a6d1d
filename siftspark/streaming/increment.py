"""Incremental embedding as a stream, the run log, and one writer at a time."""

from __future__ import annotations

import fcntl
import json
import os
import time
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ingest import META_KEY, MODEL, VECTOR_KEY, VERSION, eligible, enrich_messages, incremental_actions, meta_rows, prepared
from ..sources.services import Embedder, embed_column
from ..sources.tables import VersionedTable

#: A day less a quarter of an hour.
FRESH_SECONDS = 24 * 3600 - 15 * 60
LOCK_SECONDS = 4 * 3600


def embed_changed(rows: DataFrame, meta: VersionedTable, vectors: VersionedTable, make: Callable[[], Embedder], now: str, dims: int) -> DataFrame:
    """Embeds the missing and stale among ``rows`` and upserts both tables; the rows that were done are returned.

    Of several rows of one id, as when a batch has two files with it, the last by ``ingested_at``, then by hash, is taken.
    Only the new rows are written; running it again on the same rows does nothing."""
    last = [F.col(c).desc_nulls_last() for c in ("ingested_at", "text_hash") if c in rows.columns or c == "text_hash"]
    # dealt by id before cleaned bodies and documents are made: only the texts are moved
    one = prepared(eligible(rows).repartition("id")).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*last))).where("_n = 1").drop("_n")
    todo = incremental_actions(one, meta.read(), model=MODEL, version=VERSION).where("action <> 'skip'")
    # the changed rows only: each is embedded once and read twice
    done = embed_column(todo.select("id", "thread_id", "in_reply_to", "references_header", "cleaned_body", "cleaned_chars", "content_hash", "text_hash", "document", F.col("document").alias("text")), make).drop("text").persist()
    vectors.upsert(done.select(F.col("id").cast("string").alias("message_id"), "embedding"), VECTOR_KEY)
    meta.upsert(meta_rows(done.withColumn("id", F.col("id").cast("string")), now, dims), META_KEY)
    return done


def stream_embeddings(source: DataFrame, meta: VersionedTable, vectors: VersionedTable, make: Callable[[], Embedder], checkpoint: str, dims: int, clock: Callable[[], str] | None = None):
    """Runs ``embed_changed`` over all that has arrived since the last run, in micro-batches, and stops.

    A batch that failed is done again; its upserts have the same keys, so nothing doubles."""
    clock = clock or (lambda: datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))

    def each(batch: DataFrame, _: int) -> None:
        embed_changed(batch, meta, vectors, make, clock(), dims).unpersist()

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def enrich(messages: VersionedTable, done: DataFrame) -> None:
    """Writes the messages that ``done`` changes."""
    old = messages.read().join(done.select("id"), "id", "left_semi")
    messages.upsert(enrich_messages(old, done), ["id"])


# --- run log and lock -----------------------------------------------------------------------------


class RunLog:
    """When each phase last succeeded: one JSON file on the driver, replaced whole."""

    def __init__(self, path: str):
        self.path = path

    def read(self) -> dict[str, float]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path) as f:
            return json.load(f)

    def stamp(self, phase: str, at: float | None = None) -> None:
        rows = self.read() | {phase: time.time() if at is None else at}
        with open(self.path + ".next", "w") as f:
            json.dump(rows, f)
        os.replace(self.path + ".next", self.path)

    def due(self, phase: str = "daily", now: float | None = None) -> bool:
        last = self.read().get(phase)
        return last is None or (time.time() if now is None else now) - last >= FRESH_SECONDS

    def can_skip(self, phase: str, now: float | None = None) -> bool:
        """A phase that succeeded after the last whole run, and not too long ago, need not be repeated."""
        rows = self.read()
        return phase in rows and not self.due(phase, now) and rows[phase] > rows.get("daily", 0)


def run_phases(log: RunLog, phases: list[tuple[str, Callable[[], None], bool]], now: float | None = None) -> dict[str, str]:
    """Runs (name, function, required) in order, resuming at the first that has not succeeded.

    A failure of a required phase ends the run; others are noted. The whole run is stamped only if every required
    phase has succeeded."""
    said: dict[str, str] = {}
    for name, run, required in phases:
        if log.can_skip(name, now):
            said[name] = "skipped"
            continue
        try:
            run()
        except Exception as e:
            said[name] = f"failed: {' '.join(str(e).split())[:160]}"
            if required:
                return said
        else:
            said[name] = "done"
            log.stamp(name, now)
    log.stamp("daily", now)
    return said


class LockHeld(RuntimeError):
    pass


@contextmanager
def writer_lock(path: str):
    """One writer at a time, on the driver's machine. A lock that is held is never taken over."""
    with open(path, "a+") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            age = time.time() - os.path.getmtime(path)
            raise LockHeld("another writer holds the lock" + (" for more than 4 h: look into it" if age > LOCK_SECONDS else "")) from e
        f.truncate(0)
        f.write(str(os.getpid()))
        f.flush()
        yield


def guarded(path: str, allowed: tuple[str, ...]) -> str:
    """A path that may be written: its last part is on the list."""
    if os.path.basename(path.rstrip("/")) not in allowed:
        raise PermissionError(f"{path} is not among the tables that may be written")
    return path


def spark_time(spark: SparkSession) -> None:
    """Dates are compared and read in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
