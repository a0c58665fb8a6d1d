"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts are sequences of words. Of every sliding window of ``span - gram + 1`` consecutive grams of ``gram`` words the one with the
smallest hash is a fingerprint (all positions of it, where several are equal), in benchmark and documents alike. So a run of ``span``
words that both have holds a fingerprint at the same place in both. Fingerprints are joined by hash, and each meeting is extended
word by word, at most ``span - gram`` to either side; where at least ``span`` words agree, the document's words of that stretch are hit. Every
window of ``span`` words is found by the fingerprint inside it, and nothing else is. An item of fewer words is one gram of its own
length, which is looked for at every position.

Grams of documents meet a bitmap of the benchmark's fingerprints first, of ``most_sketch`` longs at most, the only thing that is
broadcast; what it lets through by chance costs time and changes no result. Items of equal words are joined once. What is
written and shuffled grows with the contaminated stretches, not with the texts.

Defined cases: null and empty texts have no words, and no item without words is ever found; repeated rows, and rows of equal ids and other
texts, are judged each; null document ids are kept; items of a null id count for ``n_hit``, but have no name to be listed or counted; of repeated item ids each
text counts, the id once; texts of any length are taken whole; bytes that are not UTF-8 become U+FFFD, which is a letter; an empty
benchmark finds nothing, no documents give no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lower_az, split_words

#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _words(text: Column) -> Column:
    return split_words(lower_az(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN)


def _range(first: Column, last: Column) -> Column:
    """first..last, empty where last is smaller."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _hashed(hashes: Column, at: Column, size: int) -> Column:
    """The hash of ``size`` words from ``at`` on; of grams of different sizes they differ."""
    return F.xxhash64(*(F.get(hashes, at + j) for j in range(size)), F.lit(size))


def _grams(hashes: Column, n: Column, size: int) -> Column:
    return F.transform(_range(F.lit(0), n - size), lambda i: _hashed(hashes, i, size))


def _smallest_nearby(grams: Column, n_grams: Column, at: Column, width: int) -> Column:
    """Whether the gram at ``at`` is the smallest of any window of ``width`` grams that holds it."""
    starts = _range(F.greatest(at - (width - 1), F.lit(0)), F.least(at, n_grams - width))
    return F.exists(starts, lambda j: F.get(grams, at) == F.array_min(F.array(*(F.get(grams, j + i) for i in range(width)))))


def _fingerprint(words: Column, at: Column, value: Column, size: int, around: int) -> Column:
    """A fingerprint with its words and those around it, the nearest first; null beyond the ends."""
    to = lambda *js: F.array(*(F.get(words, at + j) for j in js))
    return F.struct(
        at.alias("at"), value.alias("h"), to(*range(size)).alias("gram"),
        to(*range(-1, -around - 1, -1)).alias("before"), to(*range(size, size + around)).alias("after"),
    )


def _agreeing(a: Column, b: Column) -> Column:
    """How many words agree from the first on."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def benchmark_fingerprints(benchmark: DataFrame, scratch: Scratch, gram: int, span: int, text_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(h, gram, before, after, short, same) and (same, item_id): fingerprints of each distinct sequence of words, and its items."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), _words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    rows = scratch.table(rows.withColumn("same", F.sha2(F.array_join("w", " "), 256)), "items")
    once = rows.groupBy("same").agg(F.first("w").alias("w")).withColumn("n", F.size("w"))
    width, around = span - gram + 1, span - gram
    long = once.where(F.col("n") >= span).withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
    long = long.withColumn("grams", _grams(F.col("hashes"), F.col("n"), gram))
    at = F.filter(_range(F.lit(0), F.col("n") - gram), lambda p: _smallest_nearby(F.col("grams"), F.size("grams"), p, width))
    prints = F.transform(at, lambda p: _fingerprint(F.col("w"), p, F.get("grams", p), gram, around))
    found = long.select("same", F.explode(prints).alias("f"), F.lit(False).alias("short"))
    for size in range(1, span):
        own = once.where(F.col("n") == size).withColumn("hashes", F.transform("w", lambda x: F.xxhash64(x)))
        value = _hashed(F.col("hashes"), F.lit(0), size)
        found = found.unionByName(own.select("same", _fingerprint(F.col("w"), F.lit(0), value, size, around).alias("f"), F.lit(True).alias("short")))
    found = found.select("f.h", "f.gram", "f.before", "f.after", "short", "same").distinct()
    return scratch.table(found, "fingerprints"), rows.where("item_id is not null").select("same", "item_id").distinct()


def _sketch(hashes: DataFrame, words: int) -> DataFrame:
    """One row with ``words`` longs, a power of two, of which each hash sets a bit."""
    bits = hashes.select(F.col("h").bitwiseAND(words - 1).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("h"))).alias("bits"))
    none = hashes.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    by_word = bits.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return by_word.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("sketch"))


def _bit(h: Column) -> Column:
    return F.shiftright(h, 40).bitwiseAND(63).cast("int")


def _may_hold(sketch: Column, h: Column, words: int) -> Column:
    held = F.get(sketch, h.bitwiseAND(words - 1).cast("int"))
    return F.call_function("shiftright", held, _bit(h)).bitwiseAND(F.lit(1).cast("long")) == 1


def decontamination(
    docs: DataFrame, benchmark: DataFrame, *, gram: int = 5, span: int = 10, most_sketch: int = 1 << 14,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids (sorted, comma-joined), spans (start and end in words,
    of the stretches that are hit, overlapping ones joined), contaminated."""
    if not 1 <= gram <= span:
        raise ValueError("a gram is not longer than a span")
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    prints, owners = benchmark_fingerprints(benchmark, scratch, gram, span, item_text_col, item_col)
    # few numbers come to the driver: a count, and which lengths below the span there are
    seen = {r["size"]: r["n"] for r in prints.groupBy(F.when(F.col("short"), F.size("gram")).otherwise(0).alias("size")).agg(F.count("*").alias("n")).collect()}
    width, around = span - gram + 1, span - gram
    words = min(most_sketch, 1 << max(6, (sum(seen.values()) // 4).bit_length()))
    sketch = F.broadcast(_sketch(prints.select("h"), words))

    # rows of one document are told apart by their id and text; rows that agree in both have equal results
    key = {"id0": F.coalesce(F.col(id_col).cast("long"), F.lit(0)), "key": F.xxhash64(F.col(id_col).cast("long"), text_col)}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(k) for k, c in key.items()), _words(F.col(text_col)).alias("w"))
    rows = rows.withColumns({"n": F.size("w"), "hashes": F.transform("w", lambda x: F.xxhash64(x))})
    rows = rows.withColumn("grams", _grams(F.col("hashes"), F.col("n"), gram) if 0 in seen else F.array().cast("array<long>"))
    rows = rows.crossJoin(sketch)

    def held(p: Column) -> Column:
        return _may_hold(F.col("sketch"), F.get("grams", p), words) & _smallest_nearby(F.col("grams"), F.size("grams"), p, width)

    at = F.filter(_range(F.lit(0), F.size("grams") - 1), held)
    parts = [F.transform(at, lambda p: _fingerprint(F.col("w"), p, F.get("grams", p), gram, around))]

    def of_short_items(size: int) -> Column:
        value = lambda p: _hashed(F.col("hashes"), p, size)
        starts = F.filter(_range(F.lit(0), F.col("n") - size), lambda p: _may_hold(F.col("sketch"), value(p), words))
        return F.transform(starts, lambda p: _fingerprint(F.col("w"), p, value(p), size, around))

    parts += [of_short_items(size) for size in sorted(seen.keys() - {0})]
    rows = rows.select("doc_id", "id0", "key", F.col("n").cast("long").alias("n_words"), F.concat(*parts).alias("found"))
    rows = scratch.table(rows, "documents")

    # equal rows of a document stand for one
    some = rows.where(F.size("found") > 0)
    asked = some.dropDuplicates(["id0", "key"]).select("id0", "key", F.explode("found").alias("f")).select("id0", "key", "f.*")
    theirs = prints.select("h", *(F.col(c).alias(f"_{c}") for c in ("gram", "before", "after")), "short", "same")
    met = asked.join(theirs, "h").where(F.col("gram") == F.col("_gram"))
    met = met.withColumns({"left": _agreeing(F.col("before"), F.col("_before")), "right": _agreeing(F.col("after"), F.col("_after"))})
    met = met.where(F.col("short") | (F.col("left") + F.col("right") >= span - gram))
    reach = lambda c: F.when(F.col("short"), 0).otherwise(F.col(c))
    met = met.select("id0", "key", "same", "at", (F.col("at") - reach("left")).alias("start"), (F.col("at") + F.size("gram") + reach("right")).alias("end"))
    met = scratch.table(met, "met")

    # meetings at one place hold it all, so their union is one stretch; a document has no more of them than words
    places = met.groupBy("id0", "key", "at").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = _joined(places)
    names = met.select("id0", "key", "same").distinct().join(owners, "same").select("id0", "key", "item_id").distinct()
    names = names.groupBy("id0", "key").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item_id")), ",").alias("item_ids"))
    got = some.select("doc_id", "id0", "key", "n_words").join(spans, ["id0", "key"], "left").join(names, ["id0", "key"], "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    empty = rows.where(F.size("found") == 0).select("doc_id", "n_words", none.alias("spans"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("item_ids"))
    got = got.select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return got.unionByName(empty).select("doc_id", "n_words", hit.alias("n_hit"), "n_items", "item_ids", "spans", (hit > 0).alias("contaminated"))


def _joined(places: DataFrame) -> DataFrame:
    """(id0, key, spans): stretches (start, end), those that touch or overlap joined, in order."""
    before = Window.partitionBy("id0", "key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    numbered = places.withColumn("opens", opens).withColumn("nth", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    one = numbered.groupBy("id0", "key", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy("id0", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
