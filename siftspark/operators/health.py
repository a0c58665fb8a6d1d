"""Health of an archive: coverage, integrity, samples of search, and the exit code."""

from __future__ import annotations

import fcntl
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import is_real_rank
from ..functions.text import collapse


def coverage(messages: DataFrame, meta: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: messages, embeddings, distinct embedded ids, and messages without an embedding record."""
    gap = messages.select("id").join(meta.select(F.col("message_id").alias("id")), "id", "left_anti").agg(F.count("*").alias("coverage_gap"))
    embedded = meta.agg(F.countDistinct("message_id").alias("embedded_ids"))
    counts = messages.agg(F.count("*").alias("messages")).crossJoin(vectors.agg(F.count("*").alias("embeddings")))
    return counts.crossJoin(embedded).crossJoin(gap)  # one row each


def integrity(messages: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: null and repeated ids, records of unknown messages."""
    per_id = messages.groupBy("id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids"))
    nulls = messages.agg(F.count_if(F.col("id").isNull()).alias("null_ids"))
    orphans = meta.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_anti").agg(F.count("*").alias("orphan_records"))
    return per_id.crossJoin(nulls).crossJoin(orphans)


def smoke(hits: DataFrame) -> DataFrame:
    """Hits and how many of them have a vector rank, for each query."""
    real = is_real_rank("vec_rank")
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.count_if(real).alias("vec_real"), F.count_if(~real).alias("vec_missing"))


def clip_subject(c, n: int = 120):
    short = collapse(c)
    return F.when(F.length(short) <= n, short).otherwise(F.concat(F.left(short, F.lit(n - 1)), F.lit("…")))


@dataclass
class Report:
    opened: bool
    messages: int = 0
    embeddings: int = 0
    embedded_ids: int = 0
    coverage_gap: int = 0
    backups: bool | None = None
    #: For each sample query: hits of the text search with their first subjects, and of the hybrid search with vector ranks.
    texts: list[dict] = field(default_factory=list)
    hybrids: list[dict] = field(default_factory=list)
    writers: list[str] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        """2 if nothing could be opened, 1 if integrity is broken; gaps only warn."""
        return 2 if not self.opened else 1 if self.problems else 0

    def to_dict(self) -> dict:
        return asdict(self) | {"exit_code": self.exit_code}

    def lines(self) -> list[str]:
        plain = [f"{k}: {v}" for k, v in self.to_dict().items() if not isinstance(v, list)]
        plain += [f"text search {t['query']!r}: {t['hits']} hits; {' | '.join(t['subjects'])}" for t in self.texts]
        plain += [f"hybrid search {h['query']!r}: {h['hits']} hits, {h['vec_real']} with a vector rank, {h['vec_missing']} without" for h in self.hybrids]
        return plain + [f"writer: {w}" for w in self.writers] + [f"problem: {p}" for p in self.problems] + [f"warning: {w}" for w in self.warnings]


def run_health(messages: DataFrame | None, meta: DataFrame | None, vectors: DataFrame | None) -> Report:
    if messages is None or meta is None or vectors is None:
        return Report(False)
    c, i = coverage(messages, meta, vectors).first(), integrity(messages, meta).first()
    out = Report(True, c["messages"], c["embeddings"], c["embedded_ids"], c["coverage_gap"])
    out.problems += [f"{i[k]} {k.replace('_', ' ')}" for k in ("repeated_ids", "null_ids") if i[k]]
    out.warnings += [f"{i['orphan_records']} orphan records"] if i["orphan_records"] else []
    out.warnings += [f"{c['coverage_gap']} messages without an embedding"] if c["coverage_gap"] else []
    return out


def lock_holders(locks: list[str]) -> list[str]:
    """The writer locks among the given files that a process holds now, on this machine; nothing is stopped."""
    held = []
    for path in locks:
        if not os.path.exists(path):
            continue
        with open(path) as f:
            try:
                fcntl.flock(f, fcntl.LOCK_SH | fcntl.LOCK_NB)
            except OSError:
                held.append(f"{path} (process {f.read().strip() or 'unknown'})")
    return held
