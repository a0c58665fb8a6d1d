"""Schemas of the message archive, and conforming any table to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name.rstrip("_"), kind, True) for name, kind in fields.items()])


MESSAGES = _schema(
    id=_S, source=_S, folder=_S, date_utc=_S, from_addr=_S, from_name=_S, to_addrs=_S, cc_addrs=_S, subject=_S, snippet=_S,
    size_bytes=_L, lane=_S, urgent=_I, junk=_I, injection_flag=_I, body_path=_S, jsonl_offset=_L, jsonl_len=_L, uid=_S, flags=_S,
    present_on_server=_I, message_id_header=_S, in_reply_to=_S, content_hash=_S, ingested_at=_S, thread_id=_S,
    references_header=_S, cleaned_body=_S, cleaned_chars=_L, has_attachments=_I,
)
MESSAGE_TEXT = _schema(id=_S, subject=_S, body=_S, from_addr=_S)
MESSAGE_IDS = _schema(id=_S, message_id=_S, identifiers=_S)
META = _schema(
    message_id=_S, model=_S, model_version=_S, created_at=_S, text_hash=_S, char_count=_L, dims=_L, embed_model=_S, embed_dim=_L,
    embed_quant=_S, instruct_version=_S, quote_stripped=_I, content_hash=_S, chunk_id=_S, source=_S,
)
VECTORS = T.StructType([T.StructField("message_id", _S), T.StructField("embedding", T.ArrayType(T.FloatType()))])
CHUNKS = _schema(chunk_id=_S, message_id=_S, chunk_index=_L, text=_S, char_count=_L, content_hash=_S, quote_stripped=_I, source=_S, created_at=_S)
CHUNK_MAP = _schema(chunk_id=_S, vec_rowid=_L, message_id=_S)
ATTACHMENTS = _schema(id=_S, message_id=_S, filename=_S, mime_type=_S, size_bytes=_L, content_hash=_S, path=_S, created_at=_S)
RUNS = _schema(id=_S, started_at=_S, finished_at=_S, actor=_S, host=_S, tool=_S, step=_S, status=_S, detail=_S)
AUDIT = _schema(ts=_S, actor=_S, query=_S, k=_L, hit_count=_L, hit_ids=_S, detail=_S)
DRAFTS = _schema(id=_S, message_id=_S, created_at=_S, text=_S, path=_S, status=_S)
BILLS = _schema(id=_S, message_id=_S, vendor=_S, amount_cents=_L, currency=_S, due_date=_S, account_hint=_S, status=_S)
HIT = _schema(
    message_id=_S, chunk_id=_S, thread_id=_S, date=_S, from_=_S, subject=_S, snippet=_S, fts_rank=_L, vec_rank=_L, rrf=_D, rerank=_D, lane=_S
)

#: Values that columns take where a table lacks them.
DEFAULTS = {"model_version": "v1", "dims": 1024, "char_count": 0, "quote_stripped": 0, "has_attachments": 0, "urgent": 0, "junk": 0, "injection_flag": 0}
#: Other names under which a column may come.
ALIASES = {"date_utc": ("date",), "from_addr": ("from",)}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones from an alias, else the default, else null."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for field in schema:
        name = next((have[n] for n in (field.name, *ALIASES.get(field.name, ())) if n in have), None)
        value = F.col(f"`{name}`") if name else F.lit(DEFAULTS.get(field.name))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Those of ``required`` that incremental writers must refuse to do without."""
    return [c for c in required if c not in df.columns]


#: What the incremental path needs of each table.
INCREMENTAL_MESSAGES = ["thread_id", "in_reply_to", "references_header", "cleaned_body", "cleaned_chars", "content_hash"]
INCREMENTAL_META = ["embed_model", "embed_dim", "instruct_version", "quote_stripped", "content_hash"]


def migrate(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns of ``schema`` that it lacks added (nothing is dropped or changed), and their names.

    Applying it again adds nothing.
    """
    added = [f for f in schema if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(DEFAULTS.get(f.name)).cast(f.dataType) for f in added}) if added else df, [f.name for f in added]
