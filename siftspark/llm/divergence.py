"""How far the sources of a language differ in the terms they use: plain relational operations.

Terms are exploded and counted by language and source. A language keeps the terms that occur in ``least_docs`` of its documents.
Every group of a language and source is crossed with the kept terms of its language, so that terms it lacks count zero, and every
count becomes a smoothed share in billionths, ``p = 1 + floor(10**9 * (count + smoothing) / (total + smoothing * kept))``, the total being over
kept terms. The shares are joined with themselves on language and term: the divergence of two sources is the sum of
``floor((p - q)**2 / q)`` over all kept terms. The terms that set a group apart from its whole language are ranked likewise.

All arithmetic is on integers: products with counts are decimals of 38 digits, and sums of the squares fit a long as the shares
of a group add up to about 10**9. A term stands for its language in all joins after the first (``tid``), a group for its language and
source (``gid``). Joins on the language alone are salted by term, as one language may have most rows. The first ``top`` terms of a group are
found in each task before any are shuffled.

Defined cases: null text, lang and source are read as ''; repeated rows are documents of their own; a group without terms has count zero
for every kept term; in a language that keeps no term all pairs have the value 0 and there are no term rows; a source
alone in its language has no pairs; equal values follow by item; texts of any length are split whole; bytes that are
not UTF-8 become U+FFFD, which is a letter; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lower_az, shuffle_partitions, split_words

#: What stands between terms: all of ASCII but its letters. Cutting here gives the matches of its complement.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]"
BILLION = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, by group. ``docs``: lang, source, text."""
    words = F.sort_array(split_words(F.col("text"), BETWEEN))
    rows = docs.select("lang", "source", words.alias("w"))
    # in order, a term's first occurrence is the one that follows another term
    pairs = F.arrays_zip("w", F.concat(F.array(F.lit("")), "w").alias("before"))
    flat = rows.select("lang", "source", F.explode(pairs).alias("z")).select("lang", "source", F.col("z.w").alias("term"), (F.col("z.w") != F.col("z.before")).cast("long").alias("first"))
    return flat.where("term is not null").groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.sum("first").alias("docs"))


def share(count: Column, total: Column, kept: Column, smoothing: int) -> Column:
    """``1 + floor(10**9 * (count + smoothing) / (total + smoothing * kept))`` exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    above = F.lit(BILLION).cast("decimal(10,0)") * wide(count + smoothing)
    return F.call_function("div", above, wide(total + kept * smoothing)) + 1


def _apart(p: str, q: str) -> Column:
    """``floor((p - q)**2 / q)``"""
    gap = F.col(p) - F.col(q)
    return F.call_function("div", gap * gap, F.col(q))


def source_divergence(
    docs: DataFrame, *, least_docs: int = 3, smoothing: int = 1, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank). Part ``pair``: all other sources of the language by their divergence; part ``term``: of
    the group's terms with a share above their language's the ``top`` that stand out most."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(some(lang_col).alias("lang"), some(source_col).alias("source"), lower_az(some(text_col)).alias("text"))

    counts = scratch.table(term_counts(rows), "counts")
    scratch.free()
    vocabulary = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    vocabulary = scratch.table(vocabulary.select("lang", "term", "lang_n").withColumn("tid", F.monotonically_increasing_id()), "vocabulary")
    groups = scratch.table(rows.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    found = counts.join(vocabulary, ["lang", "term"]).join(groups, ["lang", "source"])
    found = scratch.table(found.select("gid", "tid", "n", "lang_n", "term"), "found")
    scratch.drop("counts")
    scratch.free()

    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = found.groupBy("gid").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = groups.join(langs, "lang", "left").join(totals, "gid", "left")
    groups = scratch.table(groups.withColumns({c: F.coalesce(c, zero) for c in ("kept", "lang_total", "total")}), "totals")

    # every group with every kept term of its language; what it has not is zero
    salts = shuffle_partitions(spark)
    salted = vocabulary.select("tid", "lang", F.pmod(F.xxhash64("tid"), F.lit(salts)).alias("salt"))
    each = groups.select("gid", "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    dense = salted.join(each, ["lang", "salt"]).select("tid", "gid").join(found.select("tid", "gid", "n"), ["tid", "gid"], "left")
    dense = dense.join(groups.select("gid", "total", "kept"), "gid")
    shares = dense.select("tid", "gid", share(F.coalesce("n", zero), F.col("total"), F.col("kept"), smoothing).alias("p"))
    shares = scratch.table(shares, "shares")
    scratch.free()
    other = shares.select("tid", F.col("gid").alias("other"), F.col("p").alias("q"))
    sums = shares.join(other, "tid").where("gid <> other").groupBy("gid", "other").agg(F.sum(_apart("p", "q")).alias("value"))

    # all pairs of a language's sources, those of languages that keep no term too
    mine = groups.select("gid", "lang", "source", F.pmod(F.xxhash64("source"), F.lit(16)).alias("salt"))
    theirs = groups.select(F.col("gid").alias("other"), "lang", F.col("source").alias("item"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("salt"))
    pairs = mine.join(theirs, ["lang", "salt"]).where("gid <> other").join(sums, ["gid", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", zero).alias("value"))

    told = found.join(groups, "gid")
    told = told.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept"), smoothing), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), smoothing)})
    terms = told.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    first = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first).select("lang", "source", "part", "item", "value", "rank")
