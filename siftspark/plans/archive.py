"""The benchmark tables as a message archive.

A document is a message: its first line the subject, its language the lane, a day of 2024 or 2025 its date; four
consecutive ids are a thread, except that every eleventh message has none. Vectors belong to the document of
their id. Documents that are labelled toxic play the sign-in mail.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..operators.lexical import Index, build_index, identifier_index, read_index, write_index, write_vocabulary
from ..sources.tables import exists, shared_folder, spread
from .retrieve import Store

NOW = "2026-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    first = F.left(F.get(F.split("text", "\n", 2), F.lit(0)), F.lit(120))
    return d.select(
        F.col("doc_id").alias("id"),
        first.alias("subject"),
        F.col("text").alias("body"),
        F.concat("source", F.lit("@example.com")).alias("from_addr"),
        F.col("lang").alias("lane"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 720).cast("int")), "yyyy-MM-dd'T00:00:00Z'").alias("date_utc"),
        F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") - F.col("doc_id") % 4).alias("thread_id"),
        snippet("text").alias("snippet"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("message_id"), "embedding")


def _written(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], Index]) -> str:
    """Where this session has written an index of the tables in a folder: once, for as long as the documents' files stay as they are."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(where)))
    key = spark.sparkContext.applicationId, sf_dir, name, files
    if key not in _indexes:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        write_index(make(), path)
        _indexes[key] = path
    return _indexes[key]


_indexes: dict[tuple, str] = {}


def index(spark: SparkSession, sf_dir: str, *, porter: bool = False) -> Index:
    """The index of the documents; with ``porter`` for queries whose words are stemmed."""
    fields = ["subject", "body", "from_addr"]
    path = _written(spark, sf_dir, "text", lambda: build_index(spread(messages(spark, sf_dir).select("id", *fields)), fields))
    found = read_index(spark, path)
    if not porter:
        return found
    if not exists(spark, f"{path}/vocabulary"):
        write_vocabulary(spark, path)
    return replace(found, porter=True, vocabulary=spark.read.parquet(f"{path}/vocabulary"))


def store(spark: SparkSession, sf_dir: str, *, porter: bool = True, identifiers: bool = True) -> Store:
    """The archive; most queries with a SQL twin take the index unstemmed."""
    m, ids = messages(spark, sf_dir), None
    if identifiers:
        ids = read_index(spark, _written(spark, sf_dir, "identifiers", lambda: identifier_index(spread(m.select("id", "body")), "id", ["body"])))
    return Store(m.drop("body"), index(spark, sf_dir, porter=porter), vectors(spark, sf_dir), ids)


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding records of the documents that have a vector: every 7th is stale, every 5th is from before content hashes."""
    from ..functions.text import clean_body, sha256

    d = messages(spark, sf_dir).join(vectors(spark, sf_dir).select(F.col("message_id").alias("id")), "id")
    old = F.col("id") % 5 == 0
    return d.select(
        F.col("id").alias("message_id"),
        F.lit("qwen3-embedding-8b").alias("model"),
        F.lit("v1").alias("model_version"),
        F.lit(NOW).alias("created_at"),
        F.when(F.col("id") % 7 == 0, "stale").otherwise(sha256("body")).alias("text_hash"),
        F.length("body").cast("long").alias("char_count"),
        F.lit(64).cast("long").alias("dims"),
        F.when(old, F.lit(None).cast("string")).when(F.col("id") % 7 == 0, "stale").otherwise(sha256(clean_body("body"))).alias("content_hash"),
        F.when(old, 0).otherwise(1).alias("quote_stripped"),
    )


#: Texts, lanes and date windows: words of several lanes, inferred and given lanes, dates, and lanes that match nothing.
KINDS = [
    ("that the and", None, None, None),
    ("der die und", "de", None, None),
    ("que de la", None, "2024-06-01", "2025-03-31"),
    ("the invoice", None, None, None),
    ("with are", "en", "2024-03-01", None),
]


def queries_of(ids: DataFrame) -> DataFrame:
    """A query for each ``query_id``: its multiple of 50 tells which of ``KINDS``."""
    kinds = F.array(*(F.struct(*(F.lit(x).cast("string").alias(c) for c, x in zip(("text", "lane", "after", "before"), kind))) for kind in KINDS))
    return ids.select("query_id", F.get(kinds, F.pmod(F.floor(F.col("query_id") / 50), F.lit(len(KINDS))).cast("int")).alias("q")).select("query_id", "q.*")
