"""Conversation keys from message headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_TOKEN = r"(?U)<[^<>\s]+>"


def message_id_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(_TOKEN), F.lit(0))


def first_message_id(c: Column | str) -> Column:
    return F.get(message_id_tokens(c), F.lit(0))


def normalize_message_id(c: Column | str) -> Column:
    """The first ``<id@host>``; an address without white space is wrapped; other text as it is; empty is null."""
    text = strip(c)
    bare = text.contains("@") & ~text.contains(" ")
    wrapped = F.concat(F.lit("<"), F.regexp_replace(text, "^[<>]+|[<>]+$", ""), F.lit(">"))
    return F.coalesce(first_message_id(text), F.when(bare, F.when(text.startswith("<") & text.endswith(">"), text).otherwise(wrapped)), F.nullif(text, F.lit("")))


def thread_id(references: Column | str, in_reply_to: Column | str, message_id_header: Column | str, row_id: Column | str) -> Column:
    """The root of the conversation: first reference, else what is replied to, else the own id, else the row's."""
    row = F.nullif(strip(F.col(row_id).cast("string") if isinstance(row_id, str) else row_id.cast("string")), F.lit(""))
    return F.coalesce(first_message_id(references), normalize_message_id(in_reply_to), normalize_message_id(message_id_header), row)
