"""URL filter: rules by host and path, then a weighted vocabulary found by Aho-Corasick.

A url whose host and path fit a rule gets the verdict of the longest such rule. Any other is searched for the
strict and soft terms of the vocabulary in one pass; a hit counts where letters or digits stand on neither side
of it. Every term has a weight, and a url whose distinct terms weigh the limit together is rejected: one strict term
weighs it alone, of soft ones it takes several.

Defined cases: a null url, or one without ``://``, has empty host and path and is searched as it is (null: allowed);
repeated rows are judged each; null ids are kept; urls of any length are searched whole; bytes that are not UTF-8 become
U+FFFD; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

STRICT = ("adult", "casino", "escort", "hentai", "phishing", "porn", "sex", "viagra", "warez", "xxx")
SOFT = (
    "ads", "bet", "bets", "bonus", "buy", "cheap", "cialis", "clicks", "coupon", "crack", "credit", "deal", "deals",
    "diet", "discount", "free", "gamble", "jackpot", "keygen", "loan", "loans", "lottery", "meds", "payday",
    "pharma", "pills", "poker", "popup", "prize", "promo", "replica", "slots", "spam", "torrent", "track",
    "tracker", "win", "winner",
)
SOFT_LIMIT = 2
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


#: Terms of a vocabulary at most: it goes to every task.
MOST_TERMS = 200_000


def hits(automaton, url: str) -> dict[str, float]:
    """The distinct terms of a lower-cased url, and their weights."""
    found: dict[str, float] = {}
    for end, (term, weight) in automaton.iter(url):
        start = end - len(term) + 1
        if (start == 0 or not url[start - 1].isalnum()) and (end + 1 == len(url) or not url[end + 1].isalnum()):
            found[term] = weight
    return found


def automaton_of(weights: dict[str, float]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term, weight in weights.items():
        out.add_word(term, (term, weight))
    out.make_automaton()
    return out


def weights_of(vocabulary: DataFrame) -> dict[str, float]:
    """The weights of a table (term, weight): terms as urls are searched for, A-Z lower-cased; of a term that comes twice the greater
    weight, empty terms and null weights left out. A table of more than ``MOST_TERMS`` rows is an error, never cut."""
    rows = vocabulary.select(F.col("term").cast("string"), F.col("weight").cast("double")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has at most {MOST_TERMS} terms")
    out: dict[str, float] = {}
    for term, weight in rows:
        if term and weight is not None:
            term = term.translate({c: c + 32 for c in range(65, 91)})
            out[term] = max(weight, out.get(term, weight))
    return out


def _judged(rules, weights, limit):
    order = sorted(rules, key=lambda r: -(len(r[1]) + len(r[2])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(weights)
        for batch in batches:
            out = []
            for url, host, path in zip(*(batch.column(x).to_pylist() for x in ("url", "host", "path"))):
                url = (url or b"").decode(errors="replace")
                fit = next((r for r in order if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), None)
                found = hits(automaton, url.translate({c: c + 32 for c in range(65, 91)})) if weights else {}
                a, b = (sorted(t for t, w in found.items() if (w >= limit) is strict) for strict in (True, False))
                out.append((fit and fit[1] + fit[2], fit[0] if fit else "block" if sum(found.values()) >= limit else "allow", a, b))
            types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            cols = list(zip(*out)) or [()] * 4
            keep = [batch.column(x) for x in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(x, t) for x, t in zip(cols, types))], names=["page_id", "host", "path", "rule", "verdict", "strict", "soft"])

    return run


def url_filter(pages: DataFrame, *, rules=RULES, vocabulary: DataFrame | None = None, limit: float = SOFT_LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, and the strict and soft terms found. ``vocabulary``: a table (term,
    weight); a term of weight ``limit`` or more is strict. By default the terms of ``STRICT`` weigh ``limit``, those of ``SOFT`` 1."""
    weights = dict.fromkeys(SOFT, 1.0) | dict.fromkeys(STRICT, float(limit)) if vocabulary is None else weights_of(vocabulary)
    url = F.col(url_col)
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        url.cast("binary").alias("url"),
        F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), upper, lower).alias("host"),
        F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    return rows.mapInArrow(lean(_judged(rules, weights, limit)), "page_id long, host string, path string, rule string, verdict string, strict array<string>, soft array<string>")
