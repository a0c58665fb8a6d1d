"""The whole health run: tables, samples of both searches, the embedding service, backups and writers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.health import Report, clip_subject, lock_holders, run_health, smoke
from ..operators.lexical import match, phrase_table
from ..functions.query_terms import phrases
from ..sources.services import Embedder, ServiceError
from ..sources.tables import exists
from .ask import hybrid_search
from .retrieve import WEIGHTS, Store

#: Sample queries, and how many subjects of each are shown.
TEXT_QUERIES, HYBRID_QUERIES, SHOWN = ("bill", "invoice"), ("utility bill", "invoice"), 5


def text_sample(spark: SparkSession, store: Store, queries: Sequence[str] = TEXT_QUERIES, shown: int = SHOWN) -> list[dict]:
    """Hits of each query in the text index, and the subjects of the first."""
    found = match(store.index, phrase_table(spark, {i: phrases(q) for i, q in enumerate(queries)}), WEIGHTS).persist()
    counts = {r["query_id"]: r["hits"] for r in found.groupBy("query_id").agg(F.count("*").alias("hits")).collect()}
    out = []
    for i, q in enumerate(queries):
        first = found.where(F.col("query_id") == i).orderBy(F.round("score", 9).desc(), "id").limit(shown)
        subjects = first.join(store.messages.select("id", clip_subject("subject").alias("subject")), "id", "left").orderBy(F.round("score", 9).desc(), "id")
        out.append({"query": q, "hits": counts.get(i, 0), "subjects": [r["subject"] or "" for r in subjects.collect()]})
    found.unpersist()
    return out


def hybrid_sample(spark: SparkSession, store: Store, now: str, embed: Embedder | None, queries: Sequence[str] = HYBRID_QUERIES, shown: int = SHOWN) -> list[dict]:
    """Hits of each query, and how many have a real vector rank; ``embed`` left out or failing, none has."""
    out = []
    for q in queries:
        hits = hybrid_search(spark, store, q, now=now, embed=embed, k=shown, expand=False)
        row = smoke(hits).first()
        out.append({"query": q} | ({k: row[k] for k in ("hits", "vec_real", "vec_missing")} if row else {"hits": 0, "vec_real": 0, "vec_missing": 0}))
    return out


def checkup(
    spark: SparkSession,
    store: Store | None,
    messages: DataFrame | None,
    meta: DataFrame | None,
    vectors: DataFrame | None,
    *,
    now: str,
    embed: Embedder | None = None,
    probe: Callable[[], None] | None = None,
    backups: str | None = None,
    locks: Sequence[str] = (),
    hybrid: bool = True,
) -> Report:
    """``run_health``, then what a search of the archive gives. ``probe`` raises where the embedding service is down; that,
    missing backups and running writers only warn."""
    out = run_health(messages, meta, vectors)
    if backups is not None:
        out.backups = exists(spark, backups)
        out.warnings += [] if out.backups else [f"no backups at {backups}"]
    if not out.opened or store is None:
        return out
    out.texts = text_sample(spark, store)
    if store.index.lengths.isEmpty():
        out.warnings.append("the text index is empty")
    if not out.embeddings:
        out.warnings.append("no embeddings")
    if not hybrid:
        out.warnings.append("the hybrid search was left out")
    else:
        if probe is not None:
            try:
                probe()
            except (ServiceError, OSError) as e:
                embed = None
                out.warnings.append(f"{' '.join(str(e).split())[:160]}; hybrid search goes without vectors")
        out.hybrids = hybrid_sample(spark, store, now, embed)
        if embed is not None and out.embeddings and not any(h["vec_real"] for h in out.hybrids):
            out.warnings.append("no hit of the hybrid search has a vector rank")
    out.writers = lock_holders(list(locks))
    out.warnings += [f"a writer runs: {w}" for w in out.writers]
    return out
