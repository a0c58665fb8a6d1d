"""Runs that write: backfills of vectors, merges of archives, and the daily phases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.candidates import in_shard
from ..operators.ingest import META_KEY, VECTOR_KEY, candidates, eligible, incremental_actions, incremental_counts, legacy_counts, legacy_reasons, merge_missing, meta_rows, prepared, require_incremental, with_text
from ..sources import schemas
from ..sources.services import Embedder, embed_column
from ..sources.tables import read, writable
from ..streaming.increment import embed_changed, enrich
from .disk import refresh_indexes, upsert_identifiers

#: Rows that a dry run shows.
PREVIEW = 20


@dataclass
class Choice:
    """Which messages a backfill takes: one shard of several, a band of lengths (legacy path only), so many at most."""

    shards: int = 0
    shard: int = 0
    max_chars: int | None = None
    min_chars: int | None = None
    limit: int | None = None
    skip_auth: bool = True


def _rows(spark: SparkSession, root: str, choice: Choice) -> DataFrame:
    messages, text = read(spark, f"{root}/messages", schemas.MESSAGES), read(spark, f"{root}/text", schemas.MESSAGE_TEXT)
    rows = eligible(with_text(messages, text), choice.skip_auth)
    return rows.where(in_shard("id", choice.shards, choice.shard)) if choice.shards else rows


def backfill(spark: SparkSession, root: str, make: Callable[[], Embedder] | None, *, now: str, dims: int, legacy: bool = False, dry: bool = False, choice: Choice = Choice()) -> dict:
    """Embeds what is missing or has changed, and writes vectors and records: the counts, the first candidates and how
    many were embedded. ``dry`` writes nothing and calls no embedder. A run that was cut short goes on where it stopped.

    The incremental path embeds cleaned replies with their header and keeps hashes of their content; the legacy path
    subject and body, by the hash of the text alone, within ``choice``'s band of lengths."""
    rows = _rows(spark, root, choice)
    meta = writable(spark, f"{root}/meta", schemas.META)
    if legacy:
        reasons = legacy_reasons(rows, meta.read(), choice.max_chars, choice.min_chars)
        todo, counts = reasons.where("reason = 'due'"), legacy_counts(reasons)
    else:
        require_incremental(rows, meta.read())
        actions = incremental_actions(prepared(rows), meta.read())
        todo, counts = actions.where("action <> 'skip'"), incremental_counts(actions)
    out = counts.first().asDict() | {"first": [r["id"] for r in candidates(todo.select("id"), PREVIEW).collect()], "embedded": 0}
    if dry:
        return out
    if make is None:
        raise ValueError("a run that writes needs an embedder")
    picked = candidates(todo.select("id"), choice.limit)
    vectors = writable(spark, f"{root}/vectors", schemas.VECTORS)
    if legacy:
        chosen = todo.join(picked, "id", "left_semi").select("id", F.col("payload").alias("document"), F.col("payload_hash").alias("text_hash"), F.lit(None).cast("string").alias("content_hash"), F.col("payload").alias("text"))
        done = embed_column(chosen, make).drop("text").persist()
        vectors.upsert(done.select(F.col("id").alias("message_id"), "embedding"), VECTOR_KEY)
        meta.upsert(meta_rows(done, now, dims, incremental=False), META_KEY)
    else:
        done = embed_changed(rows.join(picked, "id", "left_semi"), meta, vectors, make, now, dims)
        enrich(writable(spark, f"{root}/messages", schemas.MESSAGES), done)
        upsert_identifiers(spark, root, done.select("id"))
    out["embedded"] = done.count()
    done.unpersist()
    return out


def merge_archives(spark: SparkSession, root: str, others: list[str], *, compat: bool = False, dry: bool = False) -> dict[str, int]:
    """Copies the records and vectors that only ``others`` have into the archive at ``root``; the sums of the counters."""
    total: dict[str, int] = {}
    for other in others:
        meta, vectors = writable(spark, f"{root}/meta", schemas.META), writable(spark, f"{root}/vectors", schemas.VECTORS)
        theirs = read(spark, f"{other}/meta", schemas.META), read(spark, f"{other}/vectors", schemas.VECTORS)
        all_meta, all_vectors, counts = merge_missing(meta.read(), vectors.read(), *theirs, compat=compat)
        for name, n in counts.first().asDict().items():
            total[name] = total.get(name, 0) + n
        if not dry:
            # only what is new is written
            have = meta.read().select(*META_KEY)
            new_vectors = all_vectors.join(vectors.read().select(*VECTOR_KEY), VECTOR_KEY, "left_anti").persist()
            meta.upsert(all_meta.join(have, META_KEY, "left_anti"), META_KEY)
            vectors.upsert(new_vectors, VECTOR_KEY)
            new_vectors.unpersist()
    return total


def daily_phases(spark: SparkSession, root: str, make: Callable[[], Embedder], *, now: str, dims: int, probe: Callable[[], None] | None = None, fetch: dict[str, Callable[[], None]] | None = None) -> list[tuple[str, Callable[[], None], bool]]:
    """The phases of a daily run for ``streaming.increment.run_phases``, in order: headers and bodies come from the callables
    in ``fetch`` (what fetches mail is not part of this library), classify and bills may fail, embedding must not and
    begins only if ``probe`` finds its service."""
    fetch = fetch or {}

    def nothing() -> None:
        return None

    def bodies() -> None:
        fetch.get("bodies-fts", nothing)()
        refresh_indexes(spark, root)

    def embed() -> None:
        if probe is not None:
            probe()
        backfill(spark, root, make, now=now, dims=dims)

    return [
        ("headers", fetch.get("headers", nothing), True),
        ("bodies-fts", bodies, True),
        ("classify", fetch.get("classify", nothing), False),
        ("bills", fetch.get("bills", nothing), False),
        ("embed", embed, True),
    ]
