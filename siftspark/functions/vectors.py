"""Vectors as Column expressions, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(c: Column | str) -> Column:
    return F.sqrt(F.aggregate(_double(c), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def l2_normalize(c: Column | str) -> Column:
    """Unit length; a zero vector is an error."""
    n = norm(c)
    return F.when(n == 0, F.raise_error(F.lit("a zero vector cannot be normalised")).cast("array<double>")).otherwise(F.transform(_double(c), lambda x: x / n))


def adapt_dims(c: Column | str, dims: int) -> Column:
    """As it is at ``dims``; longer ones are cut and normalised again; shorter ones are an error."""
    if dims <= 0:
        raise ValueError("dims must be positive")
    v = _double(c)
    short = F.raise_error(F.lit(f"a vector has fewer than {dims} dimensions")).cast("array<double>")
    return F.when(F.size(v) == dims, v).when(F.size(v) > dims, l2_normalize(F.slice(v, 1, dims))).otherwise(short)
