"""Identifiers in text: UUIDs, parcel numbers, invoice tokens and numbers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Fixed values.
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
PARCEL = r"\b\d{3,4}-\d{3,4}-\d{2,4}\b"
INVOICE_TOKEN = r"\bINV[-_][A-Za-z0-9][-A-Za-z0-9]{1,}\b"
INVOICE = r"\b(?:inv(?:oice)?[\s#:.-]*)(\d{3,}[A-Za-z0-9-]*)\b"


def _first_seen(found: Column) -> Column:
    """Distinct whatever the case, the first spelling of each, in order."""
    trimmed = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")
    both = F.struct(trimmed.alias("own"), F.transform(trimmed, lambda x: F.lower(x)).alias("low"))
    return let(both, lambda b: F.transform(F.array_distinct(b["low"]), lambda x: F.element_at(b["own"], F.array_position(b["low"], x).cast("int"))))


def extract_identifiers(*parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("\n", *(F.nullif(c, F.lit("")) for c in cols))

    def every(pattern: str, group: int, flags: str) -> Column:
        return F.regexp_extract_all(text, F.lit(f"(?{flags}){pattern}"), F.lit(group))

    invoices = F.arrays_zip(every(INVOICE, 0, "iU").alias("a"), every(INVOICE, 1, "iU").alias("b"))
    both = F.flatten(F.transform(invoices, lambda x: F.array(x["a"], x["b"])))
    return _first_seen(F.concat(every(UUID, 0, "U"), every(PARCEL, 0, "U"), every(INVOICE_TOKEN, 0, "iU"), both))


def is_identifier_query(query: str | None) -> bool:
    q = (query or "").strip()
    return bool(q) and any(re.search(p, q, f) for p, f in ((UUID, 0), (PARCEL, 0), (INVOICE_TOKEN, re.I), (INVOICE, re.I)))


def query_identifiers(query: str | None) -> list[str]:
    """The identifiers of a query, each once whatever the case."""
    text, out = query or "", {}
    for pattern, flags in ((UUID, 0), (PARCEL, 0), (INVOICE_TOKEN, re.I)):
        for m in re.finditer(pattern, text, flags):
            out.setdefault(m[0].strip().lower(), m[0].strip())
    for m in re.finditer(INVOICE, text, re.I):
        for token in (m[0].strip(), m[1]):
            out.setdefault(token.lower(), token)
    return [x.replace('"', " ").strip() for x in out.values() if x]


def asks_identifier(query: Column) -> Column:
    """As ``is_identifier_query``."""
    q = F.coalesce(query, F.lit(""))
    return q.rlike(f"(?U){UUID}") | q.rlike(f"(?U){PARCEL}") | q.rlike(f"(?iU){INVOICE_TOKEN}") | q.rlike(f"(?iU){INVOICE}")


def identifiers_asked(query: Column) -> Column:
    """As ``query_identifiers``."""
    plain = F.transform(extract_identifiers(query), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(" "))))
    return F.filter(plain, lambda x: x != "")
