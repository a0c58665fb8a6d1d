"""Hybrid retrieval as one plan: lexical, vector and identifier lists, fused, decayed, packed and expanded.

Batch first: every step takes all queries at once, keyed by ``query_id``. Queries are a table; what is read from their
texts (phrases, lanes, identifiers, dates) is read by column expressions. A few queries of the driver, as a served search
has, take the same steps, but each ranked list, which is short, is settled before the next step plans over it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identifiers import asks_identifier, identifiers_asked
from ..functions.query_terms import date_bounds_of, lane_of
from ..operators.fusion import decayed, fuse, positioned, ranked, rerank
from ..operators.lexical import SUBJECT_BOOST, Index, identifier_match, match, phrases_of
from ..operators.thread_pack import expand_spine, pack
from ..operators.vector import knn
from ..sources.tables import local_table, settled

# Lengths of the three lists, and of the result.
FTS_K = VEC_K = IDS_K = 50
DEFAULT_K = 20
#: Queries of the driver whose lists are settled: at most 150 hits each come to the driver.
MOST_SETTLED = 100
WEIGHTS = {"subject": SUBJECT_BOOST, "body": 1.0, "from_addr": 1.0}


@dataclass
class Store:
    """Messages (id, thread_id, date_utc, from_addr, subject, snippet, lane), their index, vectors (message_id,
    embedding) and, optionally, identifiers, chunks (message_id, chunk_id, vec_rowid) and the
    vectors' rows (id, vec_rowid). ``lookup`` gives the messages of a list of ids
    without reading all."""

    messages: DataFrame
    index: Index
    vectors: DataFrame
    identifiers: Index | None = None
    chunks: DataFrame | None = None
    rowids: DataFrame | None = None
    lookup: Callable[[list], DataFrame] | None = None


@dataclass
class Query:
    query_id: int
    text: str
    vector: list[float] | None = None
    lane: str | None = None
    after: str | None = None
    before: str | None = None


def query_table(spark: SparkSession, queries: Sequence[Query]) -> DataFrame:
    """(query_id, text, lane, after, before)"""
    if any(not (q.text or "").strip() for q in queries):
        raise ValueError("an empty query")
    return local_table(spark, [(q.query_id, q.text, q.lane, q.after, q.before) for q in queries], "query_id long, text string, lane string, after string, before string")


def read_queries(queries: DataFrame) -> DataFrame:
    """(query_id, text, want, inferred, lo, hi, dated, asks) of a table of queries: the lane that is wanted and whether it was
    inferred, date bounds and whether there are any, whether it asks for an identifier."""
    lo, hi = date_bounds_of(F.col("after"), F.col("before"))
    given = F.col("lane").isNotNull()
    want = lane_of(F.col("text"), F.col("lane"))
    rows = queries.select("query_id", "text", want.alias("want"), given.alias("given"), lo.alias("lo"), hi.alias("hi"), asks_identifier(F.col("text")).alias("asks"))
    return rows.select("query_id", "text", "want", (~F.col("given") & F.col("want").isNotNull()).alias("inferred"), "lo", "hi", F.coalesce("lo", "hi").isNotNull().alias("dated"), "asks")


def filters(read: DataFrame) -> DataFrame:
    """(query_id, variant, want, lo, hi): the filters of each query; variant 1 is without an inferred lane."""
    own = read.select("query_id", F.lit(0).alias("variant"), "want", "lo", "hi")
    return own.unionByName(read.where("inferred").select("query_id", F.lit(1).alias("variant"), F.lit(None).cast("string").alias("want"), "lo", "hi"))


def _filtered(found: DataFrame, messages: DataFrame, limits: DataFrame) -> DataFrame:
    """``found`` (query_id, id, ...) once for each variant whose filters the message passes."""
    facts = messages.select("id", "lane", "date_utc")
    date = F.coalesce("date_utc", F.lit(""))
    lane = F.col("want").isNull() | (F.lower(F.coalesce("lane", F.lit(""))) == F.lower("want"))
    inside = lane & (F.col("lo").isNull() | (date >= F.col("lo"))) & (F.col("hi").isNull() | (date <= F.col("hi")))
    return found.join(facts, "id", "left").join(limits, "query_id").where(inside).select(*found.columns, "variant")


def lexical_list(store: Store, queries: DataFrame, limits: DataFrame, k: int = FTS_K) -> DataFrame:
    """(query_id, variant, id, fts_rank) for queries (query_id, text): filters come before the top k and leave the statistics alone.
    Queries of one text are matched once, and those of one text and one filter ranked once, however many they are."""
    texts = queries.groupBy("text").agg(F.min("query_id").alias("first"))
    found = match(store.index, phrases_of(texts, "first", "text"), WEIGHTS)
    asked = limits.join(queries.select("query_id", "text").join(texts, "text").select("query_id", "first"), "query_id")
    kinds = asked.groupBy("first", "want", "lo", "hi").agg(F.min(F.struct("query_id", "variant")).alias("one"))
    own = kinds.select(F.col("first").alias("query_id"), F.col("one").alias("variant"), "want", "lo", "hi")
    order = Window.partitionBy("variant").orderBy(F.round("score", 9).desc(), "id")
    best = _filtered(found, store.messages, own).withColumn("fts_rank", F.row_number().over(order).cast("long")).where(F.col("fts_rank") <= k)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("first", "want", "lo", "hi")]
    of = asked.alias("a").join(kinds.alias("k"), same).select("a.query_id", "a.variant", "k.one")
    return of.join(best.select(F.col("variant").alias("one"), "id", "fts_rank"), "one").select("query_id", "id", "variant", "fts_rank")


def vector_list(near: DataFrame, messages: DataFrame, limits: DataFrame) -> DataFrame:
    """(query_id, variant, id, vec_rank): neighbours that pass the filters, renumbered. The filter stays after the
    top k, which defines results."""
    order = Window.partitionBy("query_id", "variant").orderBy("vec_rank")
    kept = _filtered(near.select("query_id", "id", "vec_rank"), messages, limits)
    return kept.withColumn("vec_rank", F.row_number().over(order).cast("long"))


def retrieve(
    spark: SparkSession,
    store: Store,
    queries: Sequence[Query] | DataFrame,
    *,
    k: int = DEFAULT_K,
    now: str,
    scorer: Callable[[str, Sequence[str]], Sequence[float]] | None = None,
    top: int = 20,
    expand: bool = True,
    vec_hits: Callable[[Sequence[Query] | DataFrame, int], DataFrame] | None = None,
    held: list[DataFrame] | None = None,
) -> DataFrame:
    """Hits in order of ``out_pos``: the pack of at most ``k`` threads, then (if ``expand``) its threads' spines.

    ``queries``: a list, or a table (query_id, text, lane, after, before) of any number, whose neighbours ``vec_hits`` gives
    as (query_id, id, vec_rank); a scorer takes a list only. A lane that was inferred and leaves all three lists of a query empty
    is dropped for that query; where it only leaves the vector list empty, that list alone is taken without the lane. Both
    variants are ranked in one pass. For up to ``MOST_SETTLED`` queries nothing stays behind; otherwise the ranked lists are persisted
    and appended to ``held``, for the caller to unpersist.
    """
    listed = None if isinstance(queries, DataFrame) else list(queries)
    if listed is None and scorer is not None:
        raise ValueError("a scorer takes a list of queries")
    k = max(1, k)
    few = listed is not None and len(listed) <= MOST_SETTLED
    kind = store.messages.schema["id"].dataType.simpleString()

    def kept(df: DataFrame) -> DataFrame:
        if few:
            return settled(df)
        df = df.persist()
        if held is not None:
            held.append(df)
        return df

    def of_ids(*lists: DataFrame) -> DataFrame:
        """The messages of the ids in the lists, or all."""
        if not few or store.lookup is None:
            return store.messages
        ids = sorted({r[0] for df in lists for r in df.select("id").collect()})
        return settled(store.lookup(ids))

    table = queries if listed is None else query_table(spark, listed)
    read = kept(read_queries(table))
    limits = kept(filters(read))

    if vec_hits:
        near = vec_hits(queries, VEC_K)
    else:
        near = knn(store.vectors, [(q.query_id, q.vector) for q in listed or [] if q.vector is not None], VEC_K)
    near = near.select("query_id", F.col("id").cast(kind).alias("id"), "vec_rank")
    if few:
        near = settled(near)
    fts = kept(lexical_list(store, read, limits))
    vec = kept(vector_list(near, of_ids(near), limits))
    if store.identifiers is not None and not (few and not read.where("asks").count()):
        found = identifier_match(store.identifiers, read.where("asks").select("query_id", identifiers_asked(F.col("text")).alias("identifiers")))
        ids = kept(ranked(found, IDS_K, "ids_rank").select("query_id", F.col("id").cast(kind).alias("id"), "ids_rank"))
    else:
        ids = local_table(spark, [], f"query_id long, id {kind}, ids_rank long")

    # which variant each list of a query takes: one row for each query, with marks of what the lane left
    have = lambda df, name: df.select("query_id", F.lit(True).alias(name)).distinct()
    left = limits.where("variant = 1").select("query_id").join(have(vec.where("variant = 0"), "v"), "query_id", "left")
    left = left.join(have(fts.where("variant = 0"), "f"), "query_id", "left").join(have(ids, "i"), "query_id", "left")
    turn = left.select("query_id", F.col("v").isNull().alias("free_vec"), (F.col("v").isNull() & F.col("f").isNull() & F.col("i").isNull()).alias("free_fts"))

    def chosen(rows: DataFrame, flag: str) -> DataFrame:
        return rows.join(turn, "query_id", "left").where(F.col("variant") == F.coalesce(F.col(flag), F.lit(False)).cast("int"))

    fused = fuse(chosen(fts, "free_fts"), chosen(vec, "free_vec"), ids, with_ids=read.where("asks"))
    known = store.messages
    if few:
        fused = settled(fused)
        known = of_ids(fused)
    fused = decayed(fused, known, now, except_for=read.where("dated"))
    columns = ["id", "thread_id", F.col("date_utc").alias("date"), F.col("from_addr").alias("from"), "subject", "snippet", "lane"]
    hits = kept(positioned(fused).join(known.select(*columns), "id", "left"))
    hits, _ = rerank(hits, {q.query_id: q.text for q in listed or []}, scorer, top)
    packed = pack(hits, k)
    if expand:
        out = expand_spine(packed, hits, store.messages)
    else:
        out = packed.select("query_id", "id", F.col("pack_pos").alias("out_pos"), F.lit(True).alias("in_pack"), "fts_rank", "vec_rank", "rrf", "rerank")
    if few:
        out = settled(out)
        known = of_ids(out)
    out = out.join(known.select(*columns), "id", "left")
    if store.chunks is not None:
        out = out.join(first_chunks(store.chunks, store.rowids).withColumn("id", F.col("id").cast(kind)), "id", "left")
    else:
        out = out.withColumn("chunk_id", F.lit(None).cast("string"))
    # fixed names
    fields = ["chunk_id", "thread_id", "date", "from", "subject", "snippet", "fts_rank", "vec_rank", "rrf", "rerank", "lane"]
    out = out.select("query_id", "out_pos", F.col("id").alias("message_id"), *fields)
    return settled(out) if few else out


def first_chunks(chunks: DataFrame, rowids: DataFrame | None = None) -> DataFrame:
    """(id, chunk_id): the smallest chunk id of each message. Messages that no chunk names get that of their vector's row, where
    ``rowids`` (id, vec_rowid) tells it."""
    some = chunks.where(F.coalesce("chunk_id", F.lit("")) != "")
    named = some.where("message_id is not null").groupBy(F.col("message_id").alias("id")).agg(F.min("chunk_id").alias("chunk_id"))
    if rowids is None or "vec_rowid" not in chunks.columns:
        return named
    by_row = some.where("vec_rowid is not null").groupBy("vec_rowid").agg(F.min("chunk_id").alias("chunk_id"))
    other = rowids.select("id", "vec_rowid").join(by_row, "vec_rowid").groupBy("id").agg(F.min("chunk_id").alias("chunk_id"))
    return named.unionByName(other.join(named, "id", "left_anti"))


def subject_then_body(spark: SparkSession, store: Store, query: str, k: int) -> DataFrame:
    """Subject matches first, then body matches, each id once, up to ``k``."""
    from ..operators.lexical import subject_scan

    # the first k of each list are enough, and all that ever meets in one task
    subject = subject_scan(store.messages, query).orderBy("id").limit(k).select("id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("nth"))
    asked = query_table(spark, [Query(0, query, lane="none")])
    body = lexical_list(store, asked, filters(read_queries(asked)), k).select("id", F.lit(1).alias("part"), F.col("fts_rank").alias("nth"))
    once = subject.unionByName(body).groupBy("id").agg(F.min(F.struct("part", "nth")).alias("at")).orderBy("at", "id").limit(k)
    return once.withColumn("pos", F.row_number().over(Window.orderBy("at", "id")).cast("long")).select("id", "pos")


