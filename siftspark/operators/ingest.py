"""Incremental embedding: preparing rows, deciding what to do with each, counting, merging shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.candidates import has_body, incremental_action, length_skip
from ..functions.identifiers import extract_identifiers
from ..functions.text import CHAR_CAP, clean_body, document_text, embed_text, sha256
from ..functions.threads import normalize_message_id, thread_id
from ..sources.schemas import INCREMENTAL_MESSAGES, INCREMENTAL_META, missing_columns
from ..sources.tables import update, upsert

MODEL, VERSION = "qwen3-embedding-8b", "v1"
#: What names a row of the tables of vectors and of records.
VECTOR_KEY, META_KEY = ["message_id"], ["message_id", "model", "model_version"]


def with_text(messages: DataFrame, text: DataFrame) -> DataFrame:
    """Messages with the body (and fallbacks for subject and sender) of their full-text row; inner, as in all writers."""
    body = text.select("id", "body", F.col("subject").alias("_subject"), F.col("from_addr").alias("_from"))
    got = messages.join(body, "id")
    filled = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), f) for c, f in (("subject", "_subject"), ("from_addr", "_from")) if c in messages.columns}
    return got.withColumns(filled).drop("_subject", "_from")


def eligible(rows: DataFrame, skip_auth: bool = True) -> DataFrame:
    """With a body, and outside the sign-in lane if that is skipped."""
    ok = has_body("body")
    return rows.where(ok & (F.lower(F.coalesce("lane", F.lit(""))) != "auth") if skip_auth else ok)


def prepared(rows: DataFrame, cap: int = CHAR_CAP) -> DataFrame:
    """Adds cleaned body, hashes, thread fields and the document to embed."""
    out = rows.withColumn("cleaned_body", clean_body("body"))
    return out.withColumns(
        {
            "cleaned_chars": F.length("cleaned_body").cast("long"),
            "content_hash": sha256("cleaned_body"),
            "thread_id": thread_id("references_header", "in_reply_to", "message_id_header", "id"),
            "in_reply_to": normalize_message_id("in_reply_to"),
            "references_header": F.nullif(F.trim("references_header"), F.lit("")),
            "document": document_text("subject", "from_addr", "from_name", "to_addrs", "date_utc", "lane", "cleaned_body", cap),
        }
    ).withColumn("text_hash", sha256("document"))


def with_meta(rows: DataFrame, meta: DataFrame, model: str = MODEL, version: str = VERSION) -> DataFrame:
    """Left join with the embedding records of one model and version."""
    own = meta.where((F.col("model") == model) & (F.col("model_version") == version))
    have = [F.col(c).alias(f"meta_{c}") for c in ("text_hash", "content_hash", "quote_stripped")]
    return rows.join(own.select(F.col("message_id").alias("id"), F.lit(True).alias("meta_present"), *have), "id", "left").withColumn("meta_present", F.coalesce("meta_present", F.lit(False)))


def incremental_actions(rows: DataFrame, meta: DataFrame, **which: str) -> DataFrame:
    """Prepared rows with ``action`` missing, stale or skip."""
    joined = with_meta(rows, meta, **which)
    return joined.withColumn("action", incremental_action("meta_present", "meta_quote_stripped", "meta_content_hash", "content_hash"))


def incremental_counts(actions: DataFrame) -> DataFrame:
    """One row: what a run would do."""
    legacy = (F.col("action") == "skip") & (F.trim(F.coalesce("meta_content_hash", F.lit(""))) == "")
    return actions.agg(
        F.count("*").alias("examined"),
        F.count_if(F.col("action") == "missing").alias("missing"),
        F.count_if(F.col("action") == "stale").alias("stale"),
        F.count_if((F.col("action") == "skip") & ~legacy).alias("skipped_quote_stripped"),
        F.count_if(legacy).alias("skipped_legacy_embedded"),
        F.count_if(F.col("action") != "skip").alias("candidates"),
    )


def legacy_reasons(rows: DataFrame, meta: DataFrame, max_chars: int | None = None, min_chars: int | None = None, **which: str) -> DataFrame:
    """Rows with ``reason``: already, too_long, too_short or due, in that order of tests; ``changed`` marks new hashes."""
    text = with_meta(rows.withColumn("payload", embed_text("subject", "body")), meta, **which)
    text = text.withColumn("payload_hash", sha256("payload"))
    already = F.coalesce(F.col("meta_text_hash") == F.col("payload_hash"), F.lit(False))
    reason = F.when(already, "already").otherwise(F.coalesce(length_skip(F.length("payload"), max_chars, min_chars), F.lit("due")))
    return text.withColumn("reason", reason).withColumn("changed", (F.col("reason") == "due") & F.col("meta_present"))


def legacy_counts(reasons: DataFrame) -> DataFrame:
    return reasons.agg(
        F.count("*").alias("examined"),
        F.count_if(F.col("reason") == "already").alias("already"),
        F.count_if(F.col("reason") == "too_long").alias("too_long"),
        F.count_if(F.col("reason") == "too_short").alias("too_short"),
        F.count_if("changed").alias("hash_changed"),
        F.count_if(F.col("reason") == "due").alias("due"),
    )


def corpus_counts(joined: DataFrame) -> DataFrame:
    """One scan for what is joined, in the sign-in lane, and without a body."""
    auth = F.lower(F.coalesce("lane", F.lit(""))) == "auth"
    return joined.agg(F.count("*").alias("joined"), F.count_if(auth).alias("auth"), F.count_if(~has_body("body")).alias("empty"))


def candidates(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """In order of id; the limit comes after every filter."""
    out = rows.orderBy("id")
    return out if limit is None else out.limit(limit)


def meta_rows(embedded: DataFrame, now: str, dims: int, *, model: str = MODEL, version: str = VERSION, incremental: bool = True) -> DataFrame:
    """Embedding records of embedded rows (id, text_hash, document, content_hash). The legacy path stores no content hash."""
    base = embedded.select(
        F.col("id").alias("message_id"), F.lit(model).alias("model"), F.lit(version).alias("model_version"), F.lit(now).alias("created_at"),
        "text_hash", F.length("document").cast("long").alias("char_count"), F.lit(dims).cast("long").alias("dims"),
        (F.col("content_hash") if incremental else F.lit(None).cast("string")).alias("content_hash"),
    )
    if not incremental:
        return base.withColumn("quote_stripped", F.lit(0))
    return base.withColumns({"quote_stripped": F.lit(1), "embed_model": F.lit(model), "embed_dim": F.lit(dims).cast("long"), "instruct_version": F.lit("v1"), "source": F.lit("message")})


def require_incremental(messages: DataFrame, meta: DataFrame) -> None:
    lacking = missing_columns(messages, INCREMENTAL_MESSAGES) + missing_columns(meta, INCREMENTAL_META)
    if lacking:
        raise ValueError(f"the incremental path needs the columns {', '.join(lacking)}; migrate the tables first")


def enrich_messages(messages: DataFrame, done: DataFrame) -> DataFrame:
    """Messages with the prepared fields of ``done``; reply headers only where there are new ones."""
    return update(messages, done, "id", ["thread_id", "in_reply_to", "references_header", "cleaned_body", "cleaned_chars", "content_hash"], ("in_reply_to", "references_header"))


def write_embeddings(vectors: DataFrame, meta: DataFrame, new_vectors: DataFrame, new_meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after an upsert by their keys."""
    return upsert(vectors, new_vectors, VECTOR_KEY), upsert(meta, new_meta, META_KEY)


def identifier_report(messages: DataFrame, text_cols: list[str]) -> DataFrame:
    """One row: rows examined, rows with and without identifiers."""
    found = messages.select(F.size(extract_identifiers(*text_cols)).alias("n"))
    return found.agg(F.count("*").alias("examined"), F.count_if(F.col("n") > 0).alias("updated"), F.count_if(F.col("n") == 0).alias("empty"))


#: What a merge copies in compatibility mode; such rows count as legacy afterwards.
_SEVEN = [*META_KEY, "created_at", "text_hash", "char_count", "dims"]


def merge_missing(primary_meta: DataFrame, primary_vectors: DataFrame, other_meta: DataFrame, other_vectors: DataFrame, *, compat: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both primary tables with what only the other has, and one row of counters.

    A record is taken if the primary lacks its key and the other has its vector; a vector that the primary has
    stays. ``compat`` copies seven columns only, losing what the incremental path stores.
    """
    columns = [c for c in other_meta.columns if not compat or c in _SEVEN]
    held = other_vectors.select("message_id", F.lit(True).alias("held")).distinct()
    known = primary_meta.select(*META_KEY, F.lit(True).alias("known")).distinct()
    examined = other_meta.select(*columns).join(known, META_KEY, "left").join(held, "message_id", "left")
    fresh = examined.where("known is null and held is not null")
    counts = examined.agg(
        F.count("*").alias("examined"),
        F.count_if(F.col("known").isNull() & F.col("held").isNotNull()).alias("inserted"),
        F.count_if(F.col("known").isNotNull()).alias("skipped"),
        F.count_if(F.col("known").isNull() & F.col("held").isNull()).alias("missing_vector"),
    )
    meta = primary_meta.unionByName(fresh.select(*columns), allowMissingColumns=True)
    vectors = other_vectors.join(fresh.select("message_id").distinct(), "message_id", "left_semi").join(primary_vectors.select("message_id"), "message_id", "left_anti")
    return meta, primary_vectors.unionByName(vectors), counts
