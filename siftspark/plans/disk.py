"""An archive on disk: one folder with messages, text, vectors, records and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identifiers import extract_identifiers
from ..operators.answers import best_snippet
from ..operators.lexical import Index, build_index, read_index, stemmed
from ..operators.segments import SegmentedIndex
from ..sources import schemas
from ..sources.tables import exists, read, writable
from .retrieve import Store

FIELDS = ["subject", "body", "from_addr"]


#: Where the identifiers of a message come from.
IDENTIFIER_COLUMNS = ["subject", "cleaned_body", "body", "snippet", "message_id_header"]


def identifier_rows(messages: DataFrame, text: DataFrame) -> DataFrame:
    """(id, message_id, identifiers) of every message: its header id, and its identifiers in order with a space between."""
    both = messages.select("id", "subject", "message_id_header", "cleaned_body", "snippet").join(text.select("id", "body"), "id", "left")
    header = F.coalesce("message_id_header", F.lit(""))
    return both.select("id", header.alias("message_id"), F.array_join(extract_identifiers(*IDENTIFIER_COLUMNS), " ").alias("identifiers"))


def upsert_identifiers(spark: SparkSession, root: str, changed: DataFrame | None = None) -> dict[str, int]:
    """Computes the identifiers of the messages whose ``id`` is in ``changed`` (all of them by default) and writes those
    rows only; the counts of what was examined, has identifiers or a header id, and has neither."""
    messages, text = read(spark, f"{root}/messages", schemas.MESSAGES), read(spark, f"{root}/text", schemas.MESSAGE_TEXT)
    if changed is not None:
        messages = messages.join(changed.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    rows = identifier_rows(messages, text).persist()
    some = (F.col("identifiers") != "") | (F.col("message_id") != "")
    found = rows.agg(F.count("*").alias("examined"), F.count_if(some).alias("updated"), F.count_if(~some).alias("empty")).first().asDict()
    writable(spark, f"{root}/messages_ids", schemas.MESSAGE_IDS).upsert(rows, ["id"])
    rows.unpersist()
    return found


def refresh_indexes(spark: SparkSession, root: str) -> dict[str, int]:
    """Brings both indexes up to date with the messages and text of the archive: that of the text stemmed, that of identifiers not. Only
    what is new or has changed is indexed; the counts of it, by index."""
    text = read(spark, f"{root}/text", schemas.MESSAGE_TEXT)
    found = SegmentedIndex(spark, f"{root}/index", FIELDS, porter=True).refresh(text)
    upsert_identifiers(spark, root)
    ids = SegmentedIndex(spark, f"{root}/identifiers", ["identifiers"]).refresh(read(spark, f"{root}/messages_ids", schemas.MESSAGE_IDS))
    return found | {f"identifiers_{name}": n for name, n in ids.items()}


def migrate_table(spark: SparkSession, path: str, schema: T.StructType) -> list[str]:
    """Adds the columns of ``schema`` that the Parquet table at ``path`` lacks, by a copy that becomes its first version, and
    names them. A table that lacks none is left as it is."""
    if exists(spark, f"{path}/versions") or not exists(spark, path):
        return []
    added = schemas.migrate(read(spark, path), schema)[1]
    if added:
        writable(spark, path, schema)
    return added


def messages_for_search(messages: DataFrame, text: DataFrame) -> DataFrame:
    """Messages with the fallbacks of their text row for subject, sender and snippet."""
    t = text.select("id", F.col("subject").alias("_s"), F.col("from_addr").alias("_f"), F.col("body").alias("_b"))
    got = messages.join(t, "id", "left")
    some = lambda c, f: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f))
    got = got.withColumns({"subject": some("subject", "_s"), "from_addr": some("from_addr", "_f")})
    return got.withColumn("snippet", best_snippet("snippet", "_b", "subject")).drop("_s", "_f", "_b")


def open_store(spark: SparkSession, root: str) -> Store:
    """The archive's store; parts that are not there are empty."""

    def table(name: str, schema) -> DataFrame:
        path = f"{root}/{name}"
        return read(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)

    def index(name: str, fields: list[str], porter: bool) -> Index | None:
        path = f"{root}/{name}"
        if exists(spark, f"{path}/versions"):
            return SegmentedIndex(spark, path, fields, porter).read()
        return read_index(spark, path) if exists(spark, f"{path}/lengths") else None

    messages, text = table("messages", schemas.MESSAGES), table("text", schemas.MESSAGE_TEXT)
    found = index("index", FIELDS, True) or stemmed(build_index(text, FIELDS))
    identifiers = index("identifiers", ["identifiers"], False)
    if identifiers is None and exists(spark, f"{root}/messages_ids"):
        identifiers = build_index(table("messages_ids", schemas.MESSAGE_IDS), ["identifiers"])
    chunks = table("chunk_map", schemas.CHUNK_MAP) if exists(spark, f"{root}/chunk_map") else None

    def lookup(ids: list) -> DataFrame:
        """The few messages and texts of these ids: the scan skips what cannot have them."""
        return messages_for_search(messages.where(F.col("id").isin(ids)), text.where(F.col("id").isin(ids)))

    return Store(messages_for_search(messages, text), found, table("vectors", schemas.VECTORS), identifiers, chunks, lookup=lookup)
