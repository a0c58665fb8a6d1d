"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies. The documents stand in order of size, the largest first,
the expected copies are summed along that order, one random offset (seeded by the source's name) is added, and a
document is emitted once for each integer boundary that its part of the sum crosses.

As the offset grows, each emitted copy moves to the next larger document, and new ones come in at the smallest: the words taken
grow in steps of the gaps between neighbours in size, by the size of the largest document in all, and average to the target. So
they are never off by more than the source's largest document; and as of ``OFFSETS`` evenly spaced offsets from the seeded one on that
which brings the words nearest to the target is taken, they are as a rule off by a small part of that.

Positions come from a range partitioning that is written once, so that reruns of lost tasks see the same
order; no source is gathered in one task, and rows that are alike in every respect are dealt out too.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; texts of size 0
are sampled like others; texts of any length are only counted; repeated rows are separate documents; a source without
words gets target 0 and no copies; an empty table gives an empty result; other columns are kept by ``mix``, whatever their
names and types, and ignored by ``mix_report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, whole


def _in_order(rows: DataFrame, scratch: Scratch, name: str, *order: Column | str) -> DataFrame:
    """``rows``, written in the given order with the number of their part (``part``) and their place in it (``nth``)."""
    spread = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return scratch.table(spread.withColumns({"part": F.spark_partition_id(), "nth": nth}), name)


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size): ``share`` of all words by weight, at most ``most`` times the
    source's size, the excess reshared by weight among the rest until none is above; to a millionth of a word, whatever
    the order of sums. Weights go by code-point order, null last. Sources may be many: only sums come to the driver,
    and one count for each part of the table of sources."""
    ordered = _in_order(sizes, scratch, "sources", F.col("source").asc_nulls_last())
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in ordered.groupBy("part").count().collect()):
        starts.append((part, before))
        before += n
    ordered = ordered.join(sizes.sparkSession.createDataFrame(starts, "part int, before long"), "part")
    weight = F.array(*(F.lit(float(w)) for w in weights))[((F.col("before") + F.col("nth")) % len(weights)).cast("int")]
    shares = ordered.select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("most"))
    shares = scratch.table(shares, "shares")
    level = 0.0
    while True:  # the level only rises, and with it the sources that are full
        full = F.col("most") < F.lit(level) * F.col("w")
        row = shares.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(full, F.col("most"))).alias("full"), F.sum(F.when(~full, F.col("w"))).alias("free")
        ).first()
        if not row["free"]:
            break
        risen = (share * row["all"] - (row["full"] or 0.0)) / row["free"]
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return shares.select("source", "source_size", F.round(F.least(F.lit(level) * F.col("w"), F.col("most")), 6).alias("target"))


#: Offsets of a source that are tried.
OFFSETS = 32


def offset(seed: str, source: str = "source") -> Column:
    """A number in [0, 1) for each source: 52 bits of a hash."""
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null"))
    return F.conv(F.left(F.sha2(F.concat(F.lit(f"{seed}|"), name), 256), F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def _copies(docs: DataFrame, scratch: Scratch, weights, share, most, seed, id_col, text_col, source_col, with_doc: bool) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), and the whole row as ``doc`` if wanted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = {
        "doc_id": F.col(id_col).cast("long"),
        "source": F.col(source_col).cast("string"),
        "size": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        "alike": F.xxhash64(text),
        # deals rows that are alike in all else
        "tie": F.monotonically_increasing_id(),
    }
    rows = whole(docs, **own) if with_doc else docs.select(*(c.alias(name) for name, c in own.items()))
    rows = _in_order(rows, scratch, "ordered", F.col("source").asc_nulls_last(), F.col("size").desc(), "doc_id", "alike", "tie")
    # a row for each source of each part; as parts are ranges, not more than sources and parts together
    parts = rows.groupBy("source", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("nth").alias("first"))
    parts = scratch.table(parts, "parts")
    goal = scratch.table(targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), scratch, weights, share, most), "targets")
    scratch.drop("sources", "shares")
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = parts.select("source", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift")).alias("p")
    places = places.join(goal.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    places = places.select(F.col("p.source").alias("of"), F.col("part").alias("in"), "shift", "source_size", "target", rate.alias("rate"))
    places = scratch.table(places, "places")
    here = (F.col("part") == F.col("in")) & F.col("source").eqNullSafe(F.col("of"))
    at = F.col("shift") + F.col("nth")
    copies = lambda u: (F.floor((at + 1) * F.col("rate") + u) - F.floor(at * F.col("rate") + u)).cast("long")

    # the words that each offset would take: one row for each source
    tried = [F.pmod(F.col("u") + k / OFFSETS, F.lit(1.0)) for k in range(OFFSETS)]
    asked = rows.select("source", "part", "nth", "size").join(places.withColumn("u", offset(seed, "of")), here)
    words = asked.groupBy("of").agg(F.first("u").alias("u"), F.first("target").alias("target"), *(F.sum(F.col("size") * copies(u)).alias(f"w{k}") for k, u in enumerate(tried)))
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("off"), F.lit(k).alias("k"), u.alias("u")) for k, u in enumerate(tried))))
    chosen = scratch.table(words.select(F.col("of").alias("named"), best["u"].alias("u")), "offsets")
    places = places.join(chosen, F.col("of").eqNullSafe(F.col("named")))
    found = rows.join(places, here).withColumn("copies", copies(F.col("u")))
    return found.select(*(["doc"] if with_doc else []), "doc_id", "source", "size", "source_size", "target", "copies")


def mix_report(docs: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies."""
    got = _copies(docs, Scratch(docs.sparkSession, "mix"), weights, share, most, seed, id_col, text_col, source_col, False)
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, each as often as it is taken."""
    got = _copies(docs, Scratch(docs.sparkSession, "mix"), weights, share, most, seed, id_col, text_col, source_col, True).where("copies > 0")
    return got.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("doc.*")
