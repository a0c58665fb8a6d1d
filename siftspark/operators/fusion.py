"""Fusing ranked lists: reciprocal ranks, recency, filters, reranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import MISSING_RANK, ScoreError, checked_scores, recency, rrf
from ..functions.text import hit_document
from ..sources.tables import local_table


def ranked(scored: DataFrame, k: int, name: str, score: Column | None = None) -> DataFrame:
    """The best ``k`` of every query with ranks 1.. in column ``name``; equal scores by id. Scores are equal to nine
    decimals, as the last digits of a sum depend on the order in which tasks add it up."""
    order = Window.partitionBy("query_id").orderBy(F.round(score if score is not None else F.col("score"), 9).desc(), "id")
    return scored.withColumn(name, F.row_number().over(order).cast("long")).where(F.col(name) <= k)


def fuse(fts: DataFrame, vec: DataFrame, ids: DataFrame | None = None, with_ids: DataFrame | None = None) -> DataFrame:
    """(query_id, id, fts_rank, vec_rank, ids_rank, rrf): the union of the lists, missing ranks at the constant.

    The identifier term counts for the queries in the table ``with_ids`` (query_id) only; for all, if ``ids`` is given alone."""
    both = fts.select("query_id", "id", "fts_rank").join(vec.select("query_id", "id", "vec_rank"), ["query_id", "id"], "full")
    value = rrf("fts_rank", "vec_rank")
    if ids is None:
        both = both.withColumn("ids_rank", F.lit(None).cast("long"))
    else:
        both = both.join(ids.select("query_id", "id", "ids_rank"), ["query_id", "id"], "full")
        three = rrf("fts_rank", "vec_rank", "ids_rank")
        if with_ids is not None:
            both = both.join(with_ids.select("query_id", F.lit(True).alias("_asks")), "query_id", "left")
        value = three if with_ids is None else F.when(F.col("_asks"), three).otherwise(value)
    missing = lambda c: F.coalesce(c, F.lit(MISSING_RANK)).cast("long").alias(c)
    return both.select("query_id", "id", missing("fts_rank"), missing("vec_rank"), missing("ids_rank"), value.alias("rrf"))


def decayed(fused: DataFrame, messages: DataFrame, now: str, except_for: DataFrame | None = None) -> DataFrame:
    """Fused rows with rrf times the recency of the message's date; those of the queries in the table ``except_for``
    (query_id; those with a date window) stay as they are."""
    dates = messages.select("id", F.col("date_utc").alias("date"))
    rows, factor = fused.join(dates, "id", "left"), recency("date", now)
    if except_for is not None:
        rows = rows.join(except_for.select("query_id", F.lit(True).alias("_dated")), "query_id", "left")
        factor = F.when(F.col("_dated"), F.lit(1.0)).otherwise(factor)
    return rows.withColumn("rrf", F.col("rrf") * factor).select(*fused.columns)


def positioned(fused: DataFrame) -> DataFrame:
    """``pos`` 1.. by rrf, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id")
    return fused.withColumn("pos", F.row_number().over(order).cast("long"))


def rerank_order(hits: DataFrame, top: int = 20) -> DataFrame:
    """Hits with ``rerank`` scores for the first ``top``: those by score, then the tail as it was, its scores null."""
    tail = F.col("pos") > top
    score = F.when(~tail, F.coalesce("rerank", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(tail, score.desc_nulls_last(), F.when(~tail, F.col("rrf")).desc_nulls_last(), F.when(tail, F.col("pos")), "id")
    rows = hits.withColumn("rerank", F.when(~tail, F.col("rerank")))
    return rows.withColumn("pos", F.row_number().over(order).cast("long"))


def rerank(hits: DataFrame, queries: dict[object, str], scorer: Callable[[str, Sequence[str]], Sequence[float]] | None, top: int = 20) -> tuple[DataFrame, dict[object, str]]:
    """Hits in reranked order and each query's mode. A scorer that fails or answers in a wrong shape leaves that
    query's order as it was, with mode ``fail_open``; only the scorer's own call is guarded."""
    if scorer is None:
        return hits.withColumn("rerank", F.lit(None).cast("double")), dict.fromkeys(queries, "none")
    # at most ``top`` rows for each query
    head = hits.where(F.col("pos") <= top).select("query_id", "id", "pos", hit_document("subject", "snippet").alias("document")).orderBy("query_id", "pos").collect()
    scores, modes = [], {}
    for query_id, query in queries.items():
        rows = [r for r in head if r["query_id"] == query_id]
        try:
            got = checked_scores(scorer(query, [r["document"] for r in rows]), len(rows))
        except (ScoreError, ArithmeticError, OSError, RuntimeError, TypeError, ValueError):
            modes[query_id] = "fail_open"
            continue
        modes[query_id] = "live"
        scores += [(query_id, r["id"], s) for r, s in zip(rows, got)]
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    table = local_table(hits.sparkSession, scores, f"query_id {kinds['query_id']}, id {kinds['id']}, rerank double")
    joined = hits.drop("rerank").join(F.broadcast(table), ["query_id", "id"], "left")
    live = [q for q, m in modes.items() if m == "live"]
    return rerank_order(joined.where(F.col("query_id").isin(live)), top).unionByName(joined.where(~F.col("query_id").isin(live))), modes
