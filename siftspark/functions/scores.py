"""Ranking arithmetic as Column expressions, and checks of what scorers return."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K, MISSING_RANK, RECENCY_DECAY = 60, 1000, 0.002


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rrf(fts: Column | str, vec: Column | str, ids: Column | str | None = None, *, k: int = RRF_K, missing: int = MISSING_RANK) -> Column:
    part = lambda c: F.lit(1.0) / (F.lit(k) + F.coalesce(_col(c), F.lit(missing)))
    return part(fts) + part(vec) if ids is None else part(fts) + part(vec) + part(ids)


def parse_iso(c: Column | str) -> Column:
    """A timestamp of ISO text; without a zone it is UTC (the session's zone must be UTC); else null."""
    text = F.trim(_col(c))
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    return F.try_to_timestamp(F.when(iso, text))


def recency(date: Column | str, now: str, decay: float = RECENCY_DECAY) -> Column:
    """exp(-decay * days of age); 1 for future, missing and unreadable dates."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(parse_iso(date))) / F.lit(86_400_000_000.0)
    return F.coalesce(F.exp(F.lit(-decay) * F.greatest(age, F.lit(0.0))), F.lit(1.0))


def yes_no(yes: Column | str, no: Column | str) -> Column:
    return F.exp(_col(yes)) / (F.exp(_col(yes)) + F.exp(_col(no)))


def is_live(score: Column | str) -> Column:
    """A finite number."""
    s = _col(score).cast("double")
    return F.coalesce(~F.isnan(s) & (F.abs(s) < F.lit(math.inf)), F.lit(False))


def is_real_rank(rank: Column | str) -> Column:
    return F.coalesce(_col(rank).between(1, MISSING_RANK - 1), F.lit(False))


def parse_score(c: Column | str) -> Column:
    """A reranker's text as a score in [0, 1]; null where it is neither yes or no nor one number."""
    text = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"(?is)<think>.*?</think>", ""))
    word = F.lower(F.regexp_extract(text, r"(?i)\b(yes|no)\b", 1))
    number = F.regexp_extract(text, r"-?\d+(?:\.\d+)?", 0)
    x = F.when(number != "", number).cast("double")
    squashed = F.when(x < 0, 0.0).when(x <= 1, x).when(x <= 100, x / 100).otherwise(1 / (1 + F.exp(-x)))
    garbage = text.rlike(r"-?\d+(?:\.\d+)?\s*,\s*-?\d+")
    return F.when(garbage, F.lit(None).cast("double")).when(word == "yes", 1.0).when(word == "no", 0.0).otherwise(squashed)


class ScoreError(ValueError):
    """A scorer's answer is not one finite number for each document."""


def checked_scores(raw: object, n: int) -> list[float]:
    """``raw`` as ``n`` finite floats; pairs are yes and no logits. Anything else is refused."""
    if hasattr(raw, "tolist"):
        raw = raw.tolist()
    if isinstance(raw, (int, float)) and not isinstance(raw, bool) and n == 1:
        raw = [raw]
    if not isinstance(raw, (list, tuple)) or len(raw) != n:
        raise ScoreError(f"expected a list of {n} scores")
    out = []
    for x in raw:
        if isinstance(x, (list, tuple)) and len(x) == 2 and all(_is_number(v) for v in x):
            top = max(x)
            x = math.exp(x[0] - top) / (math.exp(x[0] - top) + math.exp(x[1] - top))
        if not _is_number(x) or not math.isfinite(x):
            raise ScoreError("a score is not a finite number")
        out.append(float(x))
    return out


def _is_number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def yes_no_from_logprobs(tokens: Sequence[dict]) -> float | None:
    """Softmax of the first yes and the first no among token log probabilities; a missing one counts as -10."""
    found: dict[str, float] = {}
    for t in tokens:
        word = str(t.get("token") or t.get("text") or "").strip().lower()
        name = "yes" if word.startswith("yes") else "no" if word.startswith("no") else None
        lp = t.get("logprob")
        if lp is None and _is_number(t.get("prob")) and t["prob"] > 0:
            lp = math.log(t["prob"])
        if name and _is_number(lp):
            found.setdefault(name, float(lp))
    if not found:
        return None
    return 1 / (1 + math.exp(found.get("no", -10.0) - found.get("yes", -10.0)))
