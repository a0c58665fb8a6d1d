"""Connected components of an edge table by alternating large-star and small-star steps.

Minima are aggregated (map-side combined) and joined back, so a hub's neighbours never meet in one
task as a list; the joins are plain equi-joins that adaptive execution may split. Every round is a
table in the shared folder. The number of rounds grows with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], int(row["s"] or 0)


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Of edges (src long, dst long): a row (node, component) for every node that is not the smallest of its
    component; ``component`` is that smallest node. Self-loops, repeated and reversed edges and nulls are
    harmless; an empty table gives an empty table."""
    now = scratch.table(
        edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(),
        f"{name}-0",
    )
    before, turn = _state(now), 0
    while before[0]:
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        large = both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(low, "src")
        small = small.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(low.select("src", F.col("m").alias("dst")))
        turn += 1
        now = scratch.table(small.distinct(), f"{name}-{turn}")
        after = _state(now)
        scratch.drop(f"{name}-{turn - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
