"""The registered queries of the retrieval library: each runs library operators over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import candidates as C
from ..functions import identifiers, query_terms, scores, text, threads
from ..functions import vectors as V
from ..operators import answers, fusion, health, ingest, lexical, thread_pack, vector
from ..operators.segments import SegmentedIndex
from ..sources import schemas, scorers, services, tables
from ..sources.tables import VersionedTable, local_table, shared_folder, vector_dims
from . import archive, disk
from .retrieve import Query as Asked
from .retrieve import filters, first_chunks, lexical_list, query_table, read_queries, retrieve, subject_then_body, vector_list

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

TERMS = {1: "that the and", 2: "der die und", 3: "que de la", 4: "with"}
#: The vector searches ask for every vector whose id is divisible by this.
EVERY = 50


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.messages(spark, sf_dir)


def _round(df: DataFrame, *columns: str) -> DataFrame:
    # a negative zero is zero
    return df.withColumns({c: F.round(c, 9) + F.lit(0.0) for c in columns})


# --- scalar functions -----------------------------------------------------------------------------


def _reply() -> Column:
    """A reply around a document: a quoted line above, history and a signature below."""
    return F.concat(F.lit("> before\r\n"), "body", F.lit("\r\n-- \r\nAda\r\nOn Tue, 1 Apr 2025, Ada <ada@example.com> wrote:\r\n> earlier\r\n"))


@query
def clean_newlines(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", F.sha2(text.normalize_newlines(_reply()), 256).alias("normal"))


@query
def clean_body(spark, sf_dir):
    both = text.let(text.clean_body(_reply()), lambda c: F.struct(F.length(c).cast("long").alias("cleaned_chars"), text.sha256(c).alias("content_hash")))
    return _docs(spark, sf_dir).select("id", both.alias("c")).select("id", "c.*")


@query
def strip_signature(spark, sf_dir):
    signed = F.concat("subject", F.lit("\nSent from my iPhone 9\nmore"))
    return _docs(spark, sf_dir).select("id", text.strip_signature(signed).alias("unsigned"))


@query
def snippet(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", text.snippet("body").alias("snippet"), answers.best_snippet(F.left("subject", F.lit(6)), "body", "subject").alias("best"))


@query
def embed_text(spark, sf_dir):
    payload = text.embed_text("subject", "body")
    return _docs(spark, sf_dir).select("id", F.length(payload).cast("long").alias("n"), text.sha256(payload).alias("text_hash"))


@query
def query_text(spark, sf_dir):
    return archive.table(spark, sf_dir, "benchmark").select("item_id", text.query_text("text").alias("payload"))


@query
def hit_document(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", text.hit_document("subject", "snippet").alias("document"))


@query
def rerank_pairs(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", text.rerank_pair(F.lit("the boat"), text.hit_document("subject", "snippet")).alias("prompt"))


@query
def document_text(spark, sf_dir):
    doc = text.document_text("subject", "from_addr", "lane", F.lit("bob@example.com"), "date_utc", "lane", "body", 16000)
    return _docs(spark, sf_dir).select("id", text.sha256(doc).alias("text_hash"), text.format_from("from_addr", "lane").alias("sender"))


@query
def format_date(spark, sf_dir):
    day = F.left("date_utc", F.lit(10))
    zoned = F.concat(day, F.lit("T23:30:00-02:00"))
    return _docs(spark, sf_dir).select("id", text.format_date(day).alias("day"), text.format_date(zoned).alias("zoned"), text.format_date("lane").alias("other"))


@query
def model_names(spark, sf_dir):
    tag = F.when(F.col("id") % 2 == 0, "Qwen3-Embedding:8b").otherwise(F.concat(F.upper("lane"), F.lit(":v1")))
    return _docs(spark, sf_dir).select("id", text.model_id(tag).alias("model_id"), text.model_tag(text.model_id(tag)).alias("tag"))


@query
def redacted_detail(spark, sf_dir):
    detail = F.when(F.col("id") % 3 == 0, F.concat(F.lit("api_key="), "lane")).otherwise(F.col("lane"))
    return _docs(spark, sf_dir).select("id", text.redact(detail).alias("detail"), text.clip_error("body", 60).alias("error"))


@query
def index_tokens(spark, sf_dir):
    t = text.tokens("body")
    return _docs(spark, sf_dir).select("id", F.size(t).cast("long").alias("n_tokens"), F.array_join(F.slice(t, 1, 5), " ").alias("head"))


@query
def thread_fields(spark, sf_dir):
    i = F.col("id").cast("string")
    refs = F.when(F.col("id") % 4 == 0, F.concat(F.lit(" <r"), i, F.lit("@x> <p"), i, F.lit("@x>")))
    reply = F.when(F.col("id") % 4 <= 1, F.concat(F.lit("p"), i, F.lit("@x")))
    own = F.when(F.col("id") % 4 <= 2, F.concat(F.lit("<"), i, F.lit("@x>")))
    rows = _docs(spark, sf_dir).select("id", refs.alias("refs"), reply.alias("reply"), own.alias("own"))
    return rows.select("id", threads.thread_id("refs", "reply", "own", "id").alias("thread"), threads.normalize_message_id("reply").alias("in_reply_to"), F.size(threads.message_id_tokens("refs")).cast("long").alias("n_refs"))


@query
def identifier_extract(spark, sf_dir):
    i = F.col("id").cast("string")
    body = F.concat(F.lit("Invoice #"), F.lpad(i, 5, "0"), F.lit(" and INV-A"), i, F.lit(", inv-a"), i, F.lit("; parcel 123-456-78 at "), "subject")
    found = identifiers.extract_identifiers(body, "lane")
    return _docs(spark, sf_dir).select("id", F.array_join(found, "|").alias("identifiers"))


@query
def identifier_report(spark, sf_dir):
    return ingest.identifier_report(archive.table(spark, sf_dir, "pages"), ["url", "html"])


@query
def auth_shaped(spark, sf_dir):
    subject = F.when(F.col("id") % 3 == 0, F.concat(F.lit("Your one-time password, "), "subject")).otherwise(F.col("subject"))
    lane = F.when(F.col("id") % 5 == 0, "OTP").otherwise(F.col("lane"))
    return _docs(spark, sf_dir).select("id", C.auth_shaped(lane, subject).alias("auth"))


@query
def shard_count(spark, sf_dir):
    shard = F.coalesce(*(F.when(C.in_shard("id", 7, r), F.lit(r)) for r in range(7)))
    return _docs(spark, sf_dir).select(shard.cast("long").alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))


@query
def length_bands(spark, sf_dir):
    n = F.length(text.embed_text("subject", "body"))
    kept = lambda low, high: F.coalesce(C.length_skip(n, high, low), F.lit("due"))
    return _docs(spark, sf_dir).select("id", kept(None, 1000).alias("at_most"), kept(1000, None).alias("over"), kept(1500, 2000).alias("band"))


@query
def recency(spark, sf_dir):
    date = F.when(F.col("id") % 9 == 0, "no date").otherwise(F.col("date_utc"))
    return _round(_docs(spark, sf_dir).select("id", scores.recency(date, "2025-06-01T00:00:00Z").alias("recency")), "recency")


@query
def rerank_scores(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("Yes.", "no", "0.73", "87", "-3", "1, 2, 3", "maybe", "<think>no</think>yes"))), (F.col("id") % 8 + 1).cast("int"))
    x = F.col("id") % 5 - 2.0
    return _round(_docs(spark, sf_dir).select("id", scores.parse_score(said).alias("score"), scores.yes_no(x, -x).alias("yes_no")), "score", "yes_no")


@query
def l2_normalize(spark, sf_dir):
    v = V.l2_normalize(F.transform("embedding", lambda x: x * 3))
    return archive.vectors(spark, sf_dir).select("message_id", F.round(V.norm(v), 9).alias("norm"), F.round(F.element_at(v, 1), 6).alias("first"))


@query
def adapt_dims(spark, sf_dir):
    v = V.adapt_dims("embedding", 16)
    return archive.vectors(spark, sf_dir).select("message_id", F.size(v).cast("long").alias("dims"), F.round(F.element_at(v, 16), 6).alias("last"))


# --- filters, joins, counts -----------------------------------------------------------------------


@query
def lane_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where(C.lane_is("lane", "DE")).select("id", "lane")


@query
def date_window(spark, sf_dir):
    lo, hi = query_terms.date_bounds("2024-06-01", "2024-06-30")
    date = F.when(F.col("id") % 13 != 0, F.col("date_utc"))
    rows = _docs(spark, sf_dir).select("id", date.alias("date"))
    return rows.select("id", C.in_dates("date", lo, hi).alias("inside"), C.in_dates("date", None, hi).alias("before"), C.in_dates("date", "2024-06-01", None).alias("after"))


@query
def text_join(spark, sf_dir):
    d = _docs(spark, sf_dir)
    body = d.select("id", "subject", F.when(F.col("id") % 4 != 0, F.col("body")).otherwise("  ").alias("body"), "from_addr")
    rows = ingest.with_text(d.select("id", F.when(F.col("id") % 2 == 0, F.col("subject")).alias("subject"), "lane"), body)
    return ingest.eligible(rows).select("id", "subject", F.length("body").cast("long").alias("n"))


@query
def corpus_counts(spark, sf_dir):
    toxic = archive.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("auth").alias("flag"))
    rows = _docs(spark, sf_dir).join(toxic, "id", "left").withColumn("lane", F.coalesce("flag", "lane"))
    return ingest.corpus_counts(rows)


@query
def meta_join(spark, sf_dir):
    rows = ingest.with_meta(_docs(spark, sf_dir).select("id"), archive.meta(spark, sf_dir))
    return rows.select("id", "meta_present", F.col("meta_quote_stripped").cast("long").alias("quote_stripped"))


@query
def coverage(spark, sf_dir):
    return health.coverage(_docs(spark, sf_dir), archive.meta(spark, sf_dir), archive.vectors(spark, sf_dir))


@query
def integrity(spark, sf_dir):
    """Vectors whose document is not there are the orphans."""
    return health.integrity(_docs(spark, sf_dir), archive.vectors(spark, sf_dir).select("message_id"))


@query
def vector_dimensions(spark, sf_dir):
    return vector_dims(archive.vectors(spark, sf_dir))


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).withColumn("cleaned_body", text.clean_body("body")).withColumn("content_hash", text.sha256("cleaned_body"))
    return ingest.incremental_actions(rows, archive.meta(spark, sf_dir))


@query
def incremental_action(spark, sf_dir):
    return _actions(spark, sf_dir).select("id", "action")


@query
def incremental_counts(spark, sf_dir):
    return ingest.incremental_counts(_actions(spark, sf_dir))


@query
def candidate_reasons(spark, sf_dir):
    return ingest.legacy_reasons(_docs(spark, sf_dir), archive.meta(spark, sf_dir), max_chars=4000, min_chars=200).select("id", "reason", "changed")


@query
def candidate_counts(spark, sf_dir):
    return ingest.legacy_counts(ingest.legacy_reasons(_docs(spark, sf_dir), archive.meta(spark, sf_dir), max_chars=4000, min_chars=200))


@query
def candidate_batch(spark, sf_dir):
    todo = _actions(spark, sf_dir).where("action <> 'skip'")
    return ingest.candidates(todo.select("id", "action"), 100)


@query
def merge_missing(spark, sf_dir):
    """Counters of a merge of all records into those of labelled messages; the other archive has vectors of the ids of
    pages only."""
    meta, vec = archive.meta(spark, sf_dir), archive.vectors(spark, sf_dir)
    labelled = archive.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"))
    paged = archive.table(spark, sf_dir, "pages").select(F.col("page_id").alias("message_id"))
    mine, mine_vec = (x.join(labelled, "message_id", "left_semi") for x in (meta, vec))
    merged, vectors, counts = ingest.merge_missing(mine, mine_vec, meta, vec.join(paged, "message_id", "left_semi"))
    sizes = merged.agg(F.count("*").alias("records")).crossJoin(vectors.agg(F.count("*").alias("vectors")))  # one row each
    return counts.crossJoin(sizes)


# --- search ---------------------------------------------------------------------------------------


def _scores(spark: SparkSession, sf_dir: str, weights: dict[str, float]) -> DataFrame:
    phrases = lexical.phrase_table(spark, {q: query_terms.phrases(t) for q, t in TERMS.items()})
    return lexical.match(archive.index(spark, sf_dir), phrases, weights)


@query
def fts_hit_count(spark, sf_dir):
    return _scores(spark, sf_dir, {"subject": 1, "body": 1, "from_addr": 1}).groupBy("query_id").agg(F.count("*").alias("hits"))


@query
def bm25_top50(spark, sf_dir):
    return _round(fusion.ranked(_scores(spark, sf_dir, {"subject": 1, "body": 1, "from_addr": 1}).withColumn("score", F.round("score", 9)), 50, "fts_rank"), "score")


@query
def bm25_subject_boost(spark, sf_dir):
    boosted = _scores(spark, sf_dir, {"subject": 5, "body": 1, "from_addr": 1}).withColumn("score", F.round("score", 9))
    return fusion.ranked(boosted, 50, "fts_rank")


@query
def bm25_lane_filter(spark, sf_dir):
    asked = query_table(spark, [Asked(q, t, lane="de" if q == 2 else "en") for q, t in TERMS.items()])
    return lexical_list(archive.store(spark, sf_dir, porter=False, identifiers=False), asked, filters(read_queries(asked))).drop("variant")


@query
def bm25_stemmed(spark, sf_dir):
    """Every benchmark passage's first words, in other forms, over the stemmed index."""
    words = F.slice(text.tokens("text"), 1, 2)
    said = F.array_join(F.transform(words, lambda w: F.concat(w, F.when(F.length(w) % 2 == 0, "s").otherwise("ing"))), " ")
    asked = archive.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(said, F.lit(" thes")).alias("text"))
    found = lexical.match(archive.index(spark, sf_dir, porter=True), lexical.phrases_of(asked, "query_id", "text"), {"subject": 5, "body": 1, "from_addr": 1})
    return _round(fusion.ranked(found.withColumn("score", F.round("score", 9)), 50, "fts_rank"), "score")


@query
def index_upkeep(spark, sf_dir):
    """The first hits in an index that was kept up to date: of all documents, then with the labelled ones changed, the toxic ones deleted and
    two more changes of the first lines, each as a segment of its own; four of them are merged on the way."""
    m = _docs(spark, sf_dir).select("id", "subject", "body", "from_addr")
    labels = archive.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    index = SegmentedIndex(spark, f"{shared_folder(spark)}/upkeep-{uuid.uuid4().hex}", ["subject", "body", "from_addr"], id_type="long")
    index.upsert(tables.spread(m))
    marked = m.join(labels.select("id").distinct(), "id", "left_semi")
    index.upsert(marked.withColumn("body", F.concat(F.lit("that the and with "), F.coalesce("body", F.lit("")))))
    index.delete(labels.where("toxic = 1"))
    for word in ("that", "with"):
        index.upsert(m.where(F.lower("subject").contains(word)).withColumn("subject", F.lit(f"{word} the")))
    found = lexical.match(index.read(), lexical.phrase_table(spark, {q: query_terms.phrases(t) for q, t in TERMS.items()}), {"subject": 5, "body": 1, "from_addr": 1})
    return _round(fusion.ranked(found.withColumn("score", F.round("score", 9)), 50, "fts_rank"), "score")


@query
def benchmark_batch(spark, sf_dir):
    """Every benchmark passage as a query, with all of its phrases, over the whole archive."""
    phrases = lexical.phrases_of(archive.table(spark, sf_dir, "benchmark"), "item_id", "text")
    return lexical.holders(archive.index(spark, sf_dir), phrases).groupBy("query_id").agg(F.count("*").alias("hits"))


@query
def subject_like(spark, sf_dir):
    return lexical.subject_scan(_docs(spark, sf_dir), "the %re")


@query
def subject_then_body_hits(spark, sf_dir):
    return subject_then_body(spark, archive.store(spark, sf_dir, porter=False, identifiers=False), "that the", 20)


@query
def identifier_hits(spark, sf_dir):
    i = F.col("id").cast("string")
    rows = _docs(spark, sf_dir).select("id", F.concat(F.lit("INV-A"), i, F.lit(" and 123-456-"), F.lpad(F.col("id") % 7, 2, "0")).alias("body"))
    index = lexical.identifier_index(rows, "id", ["body"])
    asked = local_table(spark, [(1, "parcel 123-456-03?"), (2, "INV-A17 123-456-01")], "query_id long, text string")
    found = lexical.identifier_match(index, asked.select("query_id", identifiers.identifiers_asked(F.col("text")).alias("identifiers")))
    ranks = fusion.ranked(found, 50, "ids_rank")
    counts = found.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("id").alias("low"), F.max("id").alias("high"))
    return ranks.select("query_id", "id", "ids_rank").join(counts, "query_id")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, v, words): the vectors that are queries, each with one of the texts of ``TERMS``."""
    words = F.pmod(F.floor(F.col("vec_id") / EVERY), F.lit(len(TERMS))) + 1
    return archive.table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"), words.alias("words"))


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return vector.knn_table(archive.vectors(spark, sf_dir), _asked(spark, sf_dir), k)


@query
def knn_top50(spark, sf_dir):
    return _round(_near(spark, sf_dir, 50), "distance")


@query
def knn_by_cells(spark, sf_dir):
    """As ``knn_top50``, over cells of which a query opens only those that can hold one of its nearest."""
    root = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    cells = vector.make_cells(archive.vectors(spark, sf_dir), f"{root}/rows")
    near, _ = vector.knn_cells(cells, _asked(spark, sf_dir), 50, root)
    return _round(near, "distance")


@query
def cosine_search(spark, sf_dir):
    return _round(vector.with_text(_near(spark, sf_dir, 10), _docs(spark, sf_dir)), "score", "distance")


@query
def knn_post_filter(spark, sf_dir):
    lo, hi = query_terms.date_bounds("2024-02-01", None)
    limits = _asked(spark, sf_dir).select("query_id", F.lit(0).alias("variant"), F.lit("en").alias("want"), F.lit(lo).alias("lo"), F.lit(hi).cast("string").alias("hi"))
    return vector_list(_near(spark, sf_dir, 50), _docs(spark, sf_dir), limits).drop("variant")


def _fused(spark: SparkSession, sf_dir: str, with_ids: bool = False) -> DataFrame:
    lists = fusion.ranked(_scores(spark, sf_dir, {"subject": 5, "body": 1, "from_addr": 1}).withColumn("score", F.round("score", 9)), 50, "fts_rank")
    fts = _asked(spark, sf_dir).select("query_id", "words").join(lists.withColumnRenamed("query_id", "words"), "words")
    ids = None
    if with_ids:
        ids = fts.where("id % 5 = 0").select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("id")).cast("long").alias("ids_rank"))
    return fusion.fuse(fts, _near(spark, sf_dir, 50), ids)


@query
def rrf_fuse(spark, sf_dir):
    return _round(_fused(spark, sf_dir), "rrf")


@query
def rrf_identifiers(spark, sf_dir):
    return _round(_fused(spark, sf_dir, True), "rrf")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused, decayed and positioned, with threads; a vector without a message is a hit too."""
    m = _docs(spark, sf_dir)
    fused = fusion.decayed(_fused(spark, sf_dir), m, archive.NOW).withColumn("rrf", F.round("rrf", 12))
    return fusion.positioned(fused).join(m.select("id", "thread_id", "date_utc"), "id", "left").withColumn("rerank", F.when(F.col("pos") % 7 != 0, F.col("id") % 10 / 10.0))


@query
def hybrid_rrf(spark, sf_dir):
    return _round(_hits(spark, sf_dir).where("pos <= 20").select("query_id", "id", "pos", "fts_rank", "vec_rank", "rrf"), "rrf")


@query
def rerank_head_tail(spark, sf_dir):
    return fusion.rerank_order(_hits(spark, sf_dir)).select("query_id", "id", "pos", "rerank")


@query
def thread_packs(spark, sf_dir):
    return thread_pack.pack(_hits(spark, sf_dir), 20).select("query_id", "id", "pack_pos")


@query
def thread_root_last3(spark, sf_dir):
    m = _docs(spark, sf_dir)
    return thread_pack.spine_members(m, m.select("thread_id").where("thread_id is not null"))


@query
def conversation_spine(spark, sf_dir):
    """Root and last three turns of every conversation."""
    t = archive.table(spark, sf_dir, "conversations")
    date = F.when(F.col("turn") != 1, F.lpad(F.col("turn").cast("string"), 6, "0"))
    m = t.select(F.col("conv_id").alias("thread_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), date.alias("date_utc"))
    return thread_pack.spine_members(m, m.select("thread_id"))


@query
def thread_spine(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return _round(thread_pack.expand_spine(thread_pack.pack(hits, 5), hits, _docs(spark, sf_dir)), "rrf")


@query
def get_thread(spark, sf_dir):
    return thread_pack.get_thread(_docs(spark, sf_dir), 40).select("id", "thread_id", "date_utc")


@query
def citation_order(spark, sf_dir):
    return thread_pack.citations(_hits(spark, sf_dir).where("pos <= 30"))


@query
def allowed_citations(spark, sf_dir):
    said = _docs(spark, sf_dir).select((F.col("id") * 3).alias("id"), F.col("id").alias("pos"))
    return thread_pack.allowed_only(said, _docs(spark, sf_dir))


@query
def search_smoke(spark, sf_dir):
    return health.smoke(_hits(spark, sf_dir))


@query
def prompt_blocks(spark, sf_dir):
    cited = thread_pack.citations(_hits(spark, sf_dir)).where("citation <= 8")
    m = _docs(spark, sf_dir).withColumn("lane", F.when(F.col("id") % 4 == 0, "otp").otherwise(F.col("lane")))
    return answers.prompt_block(cited, m.withColumn("prompt_body", answers.best_body(F.lit(""), "body", "snippet"))).select("query_id", F.sha2("block", 256).alias("block_hash"), F.length("block").cast("long").alias("n"))


@query
def audit_log(spark, sf_dir):
    words = spark.createDataFrame([*TERMS.items()], "words long, query string")
    asked = _asked(spark, sf_dir).join(words, "words").select("query_id", "query").union(spark.createDataFrame([(-1, "nothing")], "query_id long, query string"))
    cited = thread_pack.citations(_hits(spark, sf_dir)).where("citation <= 8")
    return answers.audit_rows(cited, asked, archive.NOW, "test", 8)


# --- what the driver reads of a query, scorers, sources, writers ------------------------------------


def _each(f, kind: str):
    """A function of one value on the driver, applied to a column in batches."""
    return F.pandas_udf(lambda x: x.map(f), kind)


@query
def query_reading(spark, sf_dir):
    """What a search reads of a query's text: every passage of ``benchmark`` as a query."""
    said = F.concat(F.when(F.col("item_id") % 4 == 0, "invoice INV-").when(F.col("item_id") % 4 == 1, "from Ada Lovelace 123-456-").otherwise(""), F.col("item_id").cast("string"), F.lit(" "), "text")
    rows = archive.table(spark, sf_dir, "benchmark").select("item_id", said.alias("q"))
    return rows.select(
        "item_id",
        query_terms.lane_of(F.col("q")).alias("lane"),
        identifiers.asks_identifier(F.col("q")).alias("is_identifier"),
        F.array_join(F.transform(lexical.phrases_in(F.col("q")), lambda p: F.array_join(p, " ")), "|").alias("phrases"),
    )


@query
def scorer_answers(spark, sf_dir):
    """Scores from answers of every shape that a scorer gives: log probabilities, pairs of logits, texts; and token limits."""
    i = F.col("id").cast("double")
    logprobs = _each(lambda x: scores.yes_no_from_logprobs([{"token": " Yes", "logprob": -(x % 7)}] + ([{"token": "no", "logprob": -(x % 5)}] if x % 3 else [])), "double")
    pairs = _each(lambda x: scores.checked_scores([[x % 4, x % 6]], 1)[0], "double")
    said = _each(lambda x: scorers.answered_score({"response": "<think>no</think>yes" if x % 2 else f"{x % 100:.0f}"}), "double")
    tokens = _each(lambda x: services.clamp_tokens(int(x)), "long")
    rows = _docs(spark, sf_dir).select("id", logprobs(i).alias("logprobs"), pairs(i).alias("pairs"), said(i).alias("said"), tokens(i).alias("tokens"))
    return _round(rows, "logprobs", "pairs", "said")


@query
def clipped_subjects(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", health.clip_subject("subject", 40).alias("subject"))


@query
def message_lookup(spark, sf_dir):
    """Messages that lack a subject, sender or snippet, with those of their text."""
    d = _docs(spark, sf_dir)
    lacking = d.select("id", F.when(F.col("id") % 2 == 0, F.col("subject")).alias("subject"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("from_addr")).alias("from_addr"), F.when(F.col("id") % 5 == 0, "short").when(F.col("id") % 5 != 1, F.col("snippet")).alias("snippet"))
    return disk.messages_for_search(lacking, d.select("id", "subject", "from_addr", "body")).select("id", "subject", "from_addr", "snippet")


@query
def conformed(spark, sf_dir):
    """Pages as messages: columns under another name, of another type, and missing ones."""
    pages = archive.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("FROM"), F.length("html").alias("size_bytes"))
    return schemas.conform(pages, schemas.MESSAGES).select("id", "from_addr", "size_bytes", "lane", "has_attachments")


@query
def migrated(spark, sf_dir):
    """Labels as records of embeddings, with the columns that they lack added."""
    labels = archive.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("message_id"), F.col("quality").cast("int").alias("quote_stripped"))
    new, _ = schemas.migrate(labels, schemas.META)
    lacking = schemas.missing_columns(labels, schemas.INCREMENTAL_META)
    return new.select("message_id", "quote_stripped", "dims", "model_version", "content_hash", F.lit(len(lacking)).cast("long").alias("lacked"))


@query
def upserted_records(spark, sf_dir):
    """Records after an upsert that has each stale one twice."""
    meta = archive.meta(spark, sf_dir)
    stale = meta.where("text_hash = 'stale'")
    new = stale.withColumn("text_hash", F.lit("new")).union(stale.withColumn("text_hash", F.lit("newer")))
    return tables.upsert(meta, new, ingest.META_KEY).select("message_id", "text_hash")


@query
def enriched_messages(spark, sf_dir):
    """Messages after an update of the labelled ones; a reply header stays where there is no new one."""
    d = _docs(spark, sf_dir).select("id", F.col("thread_id").cast("string").alias("thread_id"), F.col("from_addr").alias("in_reply_to"), F.lit(None).cast("string").alias("references_header"), F.lit("").alias("cleaned_body"), F.lit(0).cast("long").alias("cleaned_chars"), F.lit("old").alias("content_hash"))
    new = archive.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("t").alias("thread_id"), F.when(F.col("quality") == 1, "<r@x>").alias("in_reply_to"), F.lit("<s@x>").alias("references_header"), F.lit("c").alias("cleaned_body"), F.lit(1).cast("long").alias("cleaned_chars"), F.lit("new").alias("content_hash"))
    return ingest.enrich_messages(d, new)


@query
def identifier_text(spark, sf_dir):
    """Identifiers of every message from all of its texts."""
    i = F.col("id").cast("string")
    d = _docs(spark, sf_dir)
    messages = d.select("id", F.concat(F.lit("INV-S"), i).alias("subject"), F.concat(F.lit("<"), i, F.lit("@x>")).alias("message_id_header"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("123-456-"), F.lpad(F.col("id") % 100, 2, "0"))).alias("cleaned_body"), F.lit("").alias("snippet"))
    return disk.identifier_rows(messages, d.select("id", F.concat(F.lit("invoice "), F.lpad(i, 4, "0")).alias("body")))


@query
def chunk_of_message(spark, sf_dir):
    """The first chunk of every message, for turns of conversations as chunks."""
    turns = archive.table(spark, sf_dir, "conversations")
    return first_chunks(turns.select(F.col("conv_id").alias("message_id"), F.concat_ws("-", "conv_id", F.lpad(F.col("turn").cast("string"), 4, "0")).alias("chunk_id")))


@query
def candidate_preview(spark, sf_dir):
    """What a dry run shows."""
    return ingest.candidates(_actions(spark, sf_dir).where("action <> 'skip'").select("id", "action"), 20)


@query
def shard_sql(spark, sf_dir):
    """``in_id_shard`` as a function of SQL."""
    C.register_sql(spark)
    _docs(spark, sf_dir).select("id").createOrReplaceTempView("siftspark_ids")
    return spark.sql("SELECT id, in_id_shard(CAST(id AS STRING), 4, 1) AS mine FROM siftspark_ids")


@query
def message_by_id(spark, sf_dir):
    """One message with what a prompt may show of it."""
    from .ask import with_prompt_body

    d = _docs(spark, sf_dir)
    one = with_prompt_body(d.drop("body").where("id = 40"), d.select("id", "body"))
    return one.select("id", "subject", F.sha2("prompt_body", 256).alias("body_hash"), C.auth_shaped("lane", "subject").alias("auth"))


@query
def draft_of_message(spark, sf_dir):
    return answers.draft_row(_docs(spark, sf_dir), 40, "thanks", archive.NOW).select("id", "message_id", "created_at", "text", "status")


@query
def health_report(spark, sf_dir):
    """The counts and findings of a health run over the archive."""
    got = health.run_health(_docs(spark, sf_dir), archive.meta(spark, sf_dir), archive.vectors(spark, sf_dir))
    rows = [(name, int(getattr(got, name))) for name in ("messages", "embeddings", "embedded_ids", "coverage_gap", "exit_code")] + [("problems", len(got.problems))]
    return spark.createDataFrame(rows, "name string, n long")


@query
def hits_prompt(spark, sf_dir):
    """The prompt of each conversation's turns as hits, cut where it grows too long."""
    hits = archive.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("hits"))
    made = F.pandas_udf(lambda found: found.map(lambda rows: answers.hits_messages("who?", [{"turn": int(r["turn"]), "text": r["text"]} for r in rows], 600)[1]["content"]), "string")
    return hits.select("conv_id", F.sha2(made("hits"), 256).alias("prompt_hash"))


# --- whole plans ------------------------------------------------------------------------------------


@query
def hybrid_retrieve(spark, sf_dir):
    """The whole plan over a table of queries: inferred and given lanes, dates, fallback, packs and spines."""
    asked = _asked(spark, sf_dir)
    near = lambda queries, k: vector.knn_table(archive.vectors(spark, sf_dir), asked, k)
    return _round(retrieve(spark, archive.store(spark, sf_dir), archive.queries_of(asked), now=archive.NOW, vec_hits=near), "rrf")


def _embedded(spark: SparkSession, sf_dir: str) -> tuple[VersionedTable, DataFrame]:
    """The records after a stream of files with all messages was embedded, and the messages."""
    from ..streaming.increment import stream_embeddings

    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = _docs(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    source = schemas.conform(rows.drop("thread_id", "snippet"), schemas.MESSAGES)
    arrived = source.join(rows.select("id", "body"), "id")
    arrived.write.mode("overwrite").parquet(f"{root}/in")
    meta, vec = VersionedTable(spark, f"{root}/meta", schemas.META), VersionedTable(spark, f"{root}/vectors", schemas.VECTORS)
    stream = spark.readStream.schema(arrived.schema).parquet(f"{root}/in")

    def make():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    stream_embeddings(stream, meta, vec, make, f"{root}/checkpoint", 2, lambda: archive.NOW).awaitTermination()
    return meta, spark.read.parquet(f"{root}/in")


@query
def stream_available_now(spark, sf_dir):
    """Embeds whatever changed among the messages as a stream of files, and shows the records it wrote."""
    meta, _ = _embedded(spark, sf_dir)
    return meta.read().select("message_id", "model", "text_hash", "char_count", "dims", "quote_stripped", "content_hash")


@query
def stream_again(spark, sf_dir):
    """What a second run over the same messages would do."""
    meta, rows = _embedded(spark, sf_dir)
    return ingest.incremental_counts(ingest.incremental_actions(ingest.prepared(ingest.eligible(rows)), meta.read()))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
