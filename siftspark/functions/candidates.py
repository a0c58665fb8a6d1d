"""Which messages to embed: hash shards, length bands, and what an existing row's hashes say."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# What marks sign-in mail.
AUTH_LANE = r"(?i)^(auth|2fa|otp|verification)$"
AUTH_SUBJECT = (
    r"(?i)\b(verification code|one[- ]time (code|password)|your code is|2fa|two[- ]factor|sign[- ]in code|security code)\b"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_shard(row_id: Column | str, shards: int, shard: int) -> Column:
    """The first 8 bytes of SHA-1 of the id, unsigned, modulo ``shards``."""
    if shards < 2 or not 0 <= shard < shards:
        raise ValueError("a shard is 0 <= shard < shards with at least 2 shards")
    head = F.conv(F.substring(F.sha1(_col(row_id).cast("string")), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(shards).cast("decimal(20,0)")) == F.lit(shard)


def register_sql(spark: SparkSession) -> None:
    """``in_shard`` as the SQL function ``in_id_shard(id, shards, shard)`` of the session."""
    head = "CAST(conv(substring(sha1(CAST(id AS STRING)), 1, 16), 16, 10) AS DECIMAL(20, 0))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION in_id_shard(id STRING, shards INT, shard INT) RETURNS BOOLEAN RETURN {head} % shards = shard")


def length_skip(n: Column | str, max_chars: int | None = None, min_chars: int | None = None) -> Column:
    """``too_long`` or ``too_short`` or null. A minimum alone is exclusive, with a maximum the band is closed."""
    if any(x is not None and x < 0 for x in (max_chars, min_chars)) or None not in (max_chars, min_chars) and max_chars < min_chars:
        raise ValueError("bounds must be at least 0, and the maximum at least the minimum")
    c = _col(n)
    long = F.lit(False) if max_chars is None else c > max_chars
    short = F.lit(False) if min_chars is None else c <= min_chars if max_chars is None else c < min_chars
    return F.when(long, "too_long").when(short, "too_short")


def incremental_action(meta_present: Column | str, quote_stripped: Column | str, stored_hash: Column | str, new_hash: Column | str) -> Column:
    """``missing``, ``stale`` or ``skip``. A row without a stored hash is from before hashes and is left alone."""
    stored = F.trim(F.coalesce(_col(stored_hash), F.lit("")))
    stripped = F.coalesce(_col(quote_stripped).cast("int"), F.lit(0)) == 1
    same = stored == _col(new_hash)
    return F.when(~_col(meta_present), "missing").when(stored == "", "skip").when(same & stripped, "skip").otherwise("stale")


def auth_shaped(lane: Column | str, subject: Column | str) -> Column:
    text = lambda c: F.coalesce(_col(c), F.lit(""))
    return F.trim(text(lane)).rlike(AUTH_LANE) | text(subject).rlike(AUTH_SUBJECT)


def has_body(body: Column | str) -> Column:
    return F.trim(F.coalesce(_col(body), F.lit(""))) != ""


def lane_is(lane: Column | str, wanted: str | None) -> Column:
    return F.lit(True) if wanted is None else F.lower(F.coalesce(_col(lane), F.lit(""))) == wanted.lower()


def in_dates(date: Column | str, lo: str | None, hi: str | None) -> Column:
    """Dates compared as text: a null date fails a lower bound and passes an upper one."""
    text = F.coalesce(_col(date), F.lit(""))
    return (F.lit(True) if lo is None else text >= lo) & (F.lit(True) if hi is None else text <= hi)
