"""Conversations around hits: one hit per thread, the thread's spine, whole threads, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import MISSING_RANK, is_live


def thread_key(thread: Column | str = "thread_id", row_id: Column | str = "id") -> Column:
    """The thread, or ``msg:<id>`` for a message without one."""
    t = (F.col(thread) if isinstance(thread, str) else thread).cast("string")
    i = (F.col(row_id) if isinstance(row_id, str) else row_id).cast("string")
    return F.coalesce(F.nullif(t, F.lit("")), F.concat(F.lit("msg:"), i))


def pack(hits: DataFrame, k: int) -> DataFrame:
    """The first hit of each thread in order of ``pos``, then the first ``k`` of those."""
    first = Window.partitionBy("query_id", thread_key()).orderBy("pos")
    alone = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    order = Window.partitionBy("query_id").orderBy("pos")
    return alone.withColumn("pack_pos", F.row_number().over(order).cast("long")).where(F.col("pack_pos") <= k)


def spine_members(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """(thread_id, id, part, nth): of each thread in ``threads`` the root and its last three.

    The root is the member whose id is the thread's, else the earliest; members stand by date, nulls first, then id.
    """
    inside = messages.where("thread_id is not null").join(threads.select("thread_id").distinct(), "thread_id", "left_semi").select("thread_id", "id", "date_utc")
    own = F.col("id").cast("string") == F.col("thread_id").cast("string")
    by_date = [F.col("date_utc").asc_nulls_first(), F.col("id").asc()]
    root = Window.partitionBy("thread_id").orderBy(F.when(own, 0).otherwise(1), *by_date)
    late = Window.partitionBy("thread_id").orderBy(F.col("date_utc").desc_nulls_last(), F.col("id").desc())
    placed = inside.withColumn("r", F.row_number().over(root)).withColumn("l", F.row_number().over(late))
    first = placed.where("r = 1").select("thread_id", "id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("nth"))
    last = placed.where("l <= 3").select("thread_id", "id", F.lit(1).alias("part"), (3 - F.col("l")).cast("long").alias("nth"))
    return first.unionByName(last)


def expand_spine(packed: DataFrame, hits: DataFrame, messages: DataFrame) -> DataFrame:
    """The pack, then for each of its threads the root, the last three and the thread's other hits that the pack lacks.

    (query_id, id, out_pos, in_pack, fts_rank, vec_rank, rrf, rerank); rows that were not hits have missing ranks and
    rrf 0. Every id comes once.
    """
    threads = packed.where("thread_id is not null").select("query_id", "thread_id", "pack_pos")
    spine = threads.join(spine_members(messages, threads), "thread_id").select("query_id", "id", "pack_pos", "part", "nth")
    others = hits.join(threads, ["query_id", "thread_id"]).select("query_id", "id", "pack_pos", F.lit(2).alias("part"), F.col("pos").alias("nth"))
    extra = spine.unionByName(others).join(packed.select("query_id", "id"), ["query_id", "id"], "left_anti")
    once = Window.partitionBy("query_id", "id").orderBy("pack_pos", "part", "nth")
    extra = extra.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    rows = packed.select("query_id", "id", F.lit(0).cast("long").alias("pack_pos"), F.lit(0).alias("part"), F.col("pack_pos").alias("nth"), F.lit(True).alias("in_pack"))
    rows = rows.unionByName(extra.withColumn("in_pack", F.lit(False)))
    order = Window.partitionBy("query_id").orderBy("pack_pos", "part", "nth")
    rows = rows.withColumn("out_pos", F.row_number().over(order).cast("long"))
    facts = hits.select("query_id", "id", "fts_rank", "vec_rank", "rrf", "rerank")
    out = rows.join(facts, ["query_id", "id"], "left")
    missing = lambda c: F.coalesce(c, F.lit(MISSING_RANK)).cast("long").alias(c)
    return out.select("query_id", "id", "out_pos", "in_pack", missing("fts_rank"), missing("vec_rank"), F.coalesce("rrf", F.lit(0.0)).alias("rrf"), "rerank")


def get_thread(messages: DataFrame, key: object) -> DataFrame:
    """All members of a thread, or the one message of that id, in order."""
    return messages.where((F.col("thread_id") == F.lit(key)) | (F.col("id") == F.lit(key))).orderBy(F.col("date_utc").asc_nulls_first(), "id")


def citations(hits: DataFrame) -> DataFrame:
    """(query_id, id, citation): distinct ids by live rerank where a query has any, then rrf, then id."""
    score = F.when(is_live("rerank"), F.col("rerank"))
    live = F.max(is_live("rerank").cast("int")).over(Window.partitionBy("query_id")) == 1
    best = hits.where("id is not null").withColumn("_r", F.when(live, F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0)))
    one = best.groupBy("query_id", "id").agg(F.max(F.struct("_r", F.coalesce("rrf", F.lit(0.0)).alias("_f"))).alias("s"))
    order = Window.partitionBy("query_id").orderBy(F.col("s._r").desc(), F.col("s._f").desc(), "id")
    return one.withColumn("citation", F.row_number().over(order).cast("long")).select("query_id", "id", "citation")


def allowed_only(candidates: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates (id, pos) that exist, each once at its first place, in order."""
    first = candidates.groupBy("id").agg(F.min("pos").alias("pos"))
    return first.join(allowed.select("id").distinct(), "id", "left_semi")
