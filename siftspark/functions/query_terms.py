"""What is read from a query's text: phrases, lane, dates; of one query on the driver, or of a table of queries as columns."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Words that put a query into the money lane, and capitalised words that are no names.
MONEY_WORDS = frozenset(
    """invoice invoices bill bills billing payment payments paid pay receipt receipts refund refunds amount due usd dollar dollars
    charge charges statement statements tax taxes payroll wire ach balance fee fees debit credit subscription purchase checkout
    overdue vendor sdge utility utilities""".split()
)
NOT_NAMES = frozenset(
    """the this that from your what when where who how about please email mail message subject inbox today yesterday week month
    year hello thanks thank regards""".split()
)
# Names, and names after words that lead to one.
_NAME = r"\b([A-Z][a-z]{2,})\b"
_TWO_NAMES = r"\b([A-Z][a-z]{2,})\s+([A-Z][a-z]{2,})\b"
_TO_NAME = r"\b(?:from|to|fwd|forward(?:ed)?(?:\s+to)?)\s+([A-Z][a-z]{2,})\b"
#: Fixed value: a word of a query.
QUERY_WORD = r"[A-Za-z0-9_]+(?:[-.][A-Za-z0-9_]+)*"


def infer_lane(query: str | None, explicit: str | None = None) -> str | None:
    """An explicit lane wins (empty, none, null and * mean no filter); else money words, then names, decide."""
    if explicit is not None:
        lane = explicit.strip().lower()
        return None if lane in ("", "none", "null", "*") else lane
    q = (query or "").strip()
    if "$" in q or any(w.lstrip("$") in MONEY_WORDS for w in re.findall(r"[A-Za-z$]+", q.lower())):
        return "money"
    if re.search(_TWO_NAMES, q) or re.search(_TO_NAME, q):
        return "people"
    return "people" if any(n.lower() not in NOT_NAMES for n in re.findall(_NAME, q)) else None


def fold_tokens(text: str) -> list[str]:
    """As the index folds and splits text."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", flat)


def phrases(query: str | None) -> list[list[str]]:
    """Phrases that a hit must all have. Query words are ASCII letters, digits and _ joined by - or .; each is one
    phrase of its index tokens. Without such a word the whole query is one."""
    found = re.findall(QUERY_WORD, query or "") or [query or ""]
    return [t for t in map(fold_tokens, found) if t]


def date_bounds(after: str | None, before: str | None) -> tuple[str | None, str | None]:
    """Bounds for comparing date text; a day as upper bound means up to its last microsecond."""
    lo, hi = (after or "").strip() or None, (before or "").strip() or None
    if hi and re.fullmatch(r"\d{4}-\d{2}-\d{2}", hi):
        hi += "T23:59:59.999999Z"
    return lo, hi


# --- of a table of queries --------------------------------------------------------------------------


def lane_of(query: Column, explicit: Column | None = None) -> Column:
    """As ``infer_lane``."""
    q = strip(query)
    words = F.transform(F.regexp_extract_all(F.lower(q), F.lit("[a-z$]+"), F.lit(0)), lambda w: F.ltrim(w, F.lit("$")))
    money = q.contains("$") | F.arrays_overlap(words, F.array(*map(F.lit, sorted(MONEY_WORDS))))
    names = F.regexp_extract_all(q, F.lit(f"(?U){_NAME}"), F.lit(1))
    people = q.rlike(f"(?U){_TWO_NAMES}") | q.rlike(f"(?U){_TO_NAME}") | F.exists(names, lambda n: ~F.lower(n).isin(*sorted(NOT_NAMES)))
    found = F.when(money, "money").when(people, "people")
    if explicit is None:
        return found
    lane = F.lower(strip(explicit))
    return F.when(explicit.isNull(), found).when(~lane.isin("", "none", "null", "*"), lane)


def date_bounds_of(after: Column, before: Column) -> tuple[Column, Column]:
    """As ``date_bounds``."""
    lo, hi = F.nullif(strip(after), F.lit("")), F.nullif(strip(before), F.lit(""))
    return lo, F.when(hi.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(hi, F.lit("T23:59:59.999999Z"))).otherwise(hi)
