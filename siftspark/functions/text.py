"""Message text as Column expressions: cleaning, hashing, snippets and embedding payloads."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHAR_CAP, SNIPPET_CHARS = 16000, 180

# Where a reply's quoted history begins, and where a signature does. Flags: i case-insensitive,
# m lines, d only \n ends a line, U Unicode classes.
REPLY_SPLITS = (
    r"(?imdU)^On [^\n]{0,240} wrote:\s*$",
    r"(?imdU)^-{2,}\s*Original Message\s*-{2,}\s*$",
    r"(?mdU)^_{5,}\s*$",
    r"(?imdU)^Begin forwarded message:\s*$",
    r"(?imdU)^From:\s[^\n]+\n(?:Sent|Date):\s[^\n]+\n(?:To:\s[^\n]+\n)?(?:Subject:\s)",
)
SIGNATURES = (
    r"(?mdU)^-- \s*$",
    r"(?imdU)^Sent from my iPhone[^\n]*$",
    r"(?imdU)^Sent from my iPad[^\n]*$",
    r"(?imdU)^Get Outlook for [^\n]*$",
    r"(?imdU)^Sent from Mail for Windows[^\n]*$",
)
#: What a text has, in lower case, if a pattern matches: letters that no other character folds to.
_NEEDED = dict(zip(REPLY_SPLITS + SIGNATURES, ("wrote:", "--", "_____", "forwarded", "from:", "-- ", "phone", "pad", "outloo", "ndow")))
QUERY_INSTRUCTION = "Instruct: Given a mail search query, retrieve the most relevant email.\nQuery: "
#: Other names of the standard embedding model.
MODEL_ALIASES = ("qwen3-embedding:8b", "qwen3-embedding", "qwen3-embedding:latest", "qwen3-embedding-8b")
MODEL_ID, MODEL_TAG = "qwen3-embedding-8b", "qwen3-embedding:8b"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value of ``c``, which is computed once however often ``body`` names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Without Unicode white space at both ends. A text without any there is not searched."""
    space = r"(?U)[\s\x1c-\x1f]"
    ends = lambda t: F.left(t, F.lit(1)).rlike(space) | F.right(t, F.lit(1)).rlike(space)
    return let(_text(c), lambda t: F.when(ends(t), F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")).otherwise(t))


def _replaced(c: Column, pattern: str, new: str, needed: str) -> Column:
    """Texts without ``needed``, which every match has, are not searched."""
    return let(c, lambda t: F.when(F.contains(t, F.lit(needed)), F.regexp_replace(t, pattern, new)).otherwise(t))


def normalize_newlines(c: Column | str) -> Column:
    return _replaced(_text(c), "\r\n?", "\n", "\r")


def _cut(c: Column, patterns: tuple[str, ...]) -> Column:
    """Up to the earliest match of any pattern. Most texts lack what the patterns need, and are not searched."""

    def cut(both: Column) -> Column:
        text = both["text"]
        first = F.least(*(F.when(F.contains(both["low"], F.lit(_NEEDED[p])), F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0))) for p in patterns))
        return F.left(text, F.coalesce(first - 1, F.length(text)))

    return let(c, lambda text: let(F.struct(text.alias("text"), F.lower(text).alias("low")), cut))


def strip_quotes(c: Column | str) -> Column:
    def unquoted(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda line: ~F.ltrim(F.translate(line, "\t", " ")).startswith(">"))
        return F.when(F.contains(text, F.lit(">")), F.array_join(lines, "\n")).otherwise(text)

    return let(_cut(normalize_newlines(c), REPLY_SPLITS), unquoted)


def strip_signature(c: Column | str) -> Column:
    return _cut(normalize_newlines(c), SIGNATURES)


def clean_body(c: Column | str) -> Column:
    return _replaced(strip(strip_signature(strip_quotes(c))), "\n{3,}", "\n\n", "\n\n\n")


def sha256(c: Column | str) -> Column:
    return F.sha2(_text(c), 256)


def collapse(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(_text(c), r"(?U)[\s\x1c-\x1f]+", " "))


def snippet(c: Column | str, n: int = SNIPPET_CHARS) -> Column:
    return let(collapse(c), lambda short: F.when(F.length(short) <= n, short).otherwise(F.concat(F.left(short, F.lit(n - 1)), F.lit("…"))))


def clip_error(c: Column | str, n: int = 180) -> Column:
    return F.left(collapse(c), F.lit(n))


def _joined(a: Column, b: Column, between: str) -> Column:
    pair = F.struct(a.alias("a"), b.alias("b"))
    return let(pair, lambda p: F.when((p["a"] != "") & (p["b"] != ""), F.concat(p["a"], F.lit(between), p["b"])).otherwise(F.concat(p["a"], p["b"])))


def embed_text(subject: Column | str, body: Column | str, cap: int = CHAR_CAP) -> Column:
    return F.left(_joined(strip(subject), strip(body), "\n\n"), F.lit(cap))


def hit_document(subject: Column | str, short: Column | str, cap: int = 1500) -> Column:
    """What a reranker sees of a hit: subject and snippet, never the body."""
    return F.left(_joined(strip(subject), strip(short), "\n"), F.lit(cap))


#: Fixed value: how a reranker is told its task unless it is told otherwise.
RERANK_INSTRUCTION = "Given a mail search query, retrieve the most relevant email."


def rerank_pair(query: Column | str, document: Column | str, instruction: str = RERANK_INSTRUCTION) -> Column:
    """A query and a document as one prompt of a reranker."""
    return F.concat(F.lit(f"<Instruct>: {instruction}\n<Query>: "), _text(query), F.lit("\n<Document>: "), _text(document))


def query_text(c: Column | str) -> Column:
    return F.concat(F.lit(QUERY_INSTRUCTION), strip(c))


def model_id(c: Column | str) -> Column:
    tag = F.lower(strip(c))
    return F.when((tag == "") | tag.isin(*MODEL_ALIASES), MODEL_ID).otherwise(F.translate(tag, ":", "-"))


def model_tag(c: Column | str) -> Column:
    tag = strip(c)
    return F.when((tag == "") | (F.lower(tag) == MODEL_ID), MODEL_TAG).otherwise(tag)


def redact(c: Column | str) -> Column:
    """Details that look like a secret are replaced."""
    return F.when(_text(c).rlike(r"(?i)(password|passwd|secret|token|api[_-]?key|authorization|bearer)"), "<redacted>").otherwise(_text(c))


# --- documents with a header ----------------------------------------------------------------------


def format_date(c: Column | str) -> Column:
    """ISO dates in UTC to the second with ``Z``; other text as it is. Dates without a zone are UTC."""
    text = strip(c)
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    at = F.try_to_timestamp(F.when(iso, text))
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), text)


def format_from(addr: Column | str, name: Column | str) -> Column:
    a, n = strip(normalize_newlines(addr)), strip(normalize_newlines(name))
    low_a, low_n = F.lower(a), F.lower(n)
    both = (
        F.when(low_a == low_n, a)
        .when(a.contains("<"), F.when(F.contains(low_a, low_n), a).otherwise(F.concat_ws(" ", n, a)))
        .otherwise(F.concat(n, F.lit(" <"), a, F.lit(">")))
    )
    return F.when((a != "") & (n != ""), both).otherwise(F.concat(a, n))


def document_text(subject, from_addr, from_name, to_addrs, date, lane, body, cap: int | None = None) -> Column:
    part = lambda c: strip(normalize_newlines(c))
    header = F.concat(
        F.lit("Subject: "), part(subject), F.lit("\nFrom: "), format_from(from_addr, from_name), F.lit("\nTo: "), part(to_addrs),
        F.lit("\nDate: "), format_date(normalize_newlines(date)), F.lit("\nLane: "), part(lane),
    )
    whole = let(part(body), lambda b: F.when(b != "", F.concat(header, F.lit("\n\n"), b)).otherwise(header))
    return whole if cap is None else F.left(whole, F.lit(cap))


# --- tokens ---------------------------------------------------------------------------------------


def _folds() -> tuple[str, str]:
    """Letters with one diacritic or more, of the Latin blocks, and their base letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BASE = _folds()


def fold(c: Column | str) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(_text(c)), _MARKED, _BASE)


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits of the folded text, in order."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
