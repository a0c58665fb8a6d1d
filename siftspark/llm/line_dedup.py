"""Line dedup by sharded cuckoo filters over exact reference counts.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased, as a 128-bit hash. A ``LineIndex`` has
two tables: exact counts of the documents of every key, and for each shard of the keys a cuckoo filter of those in at least
``least`` documents. ``insert`` and ``delete`` add documents to the counts and take them away again; keys that cross
``least`` are added to the filter of their shard or deleted from it, and a filter that overflows is built anew from the
counts. Deleting what was inserted gives the former index.

Lines are looked up at their shard, whatever the size of the tables: each shard's filter and its exact keys go ahead of
the lines dealt to it, a line that the filter lets pass is confirmed in the exact keys, and its place goes back
to its text. A shard that many lines ask for is copied, and its lines are dealt to the copies. Nothing is broadcast.

Defined cases: a null or empty text is one empty line; keys shorter than ``least_chars`` code points are
never dropped; a key counts once per row however often it recurs there; rows are documents, repeated rows too;
texts are read whole, a line of any length being one value; null ids are kept as they are; bytes that are not UTF-8 count
as they are, and become U+FFFD in a text that loses lines; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from .common import Scratch, lean, shuffle_partitions

_STRIP = "\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Least number of shards, and most frequent keys in one on average when an index is built.
SHARDS, SHARD_KEYS = 64, 500_000
#: Least lines of a copy of a shard.
ASKS = 10_000
SLOTS, KICKS = 4, 500
_KEY = "k1 long, k2 long"


def line_key(line: str) -> str:
    return line.strip(_STRIP).translate(_LOWER)


def key_hash(key: str) -> tuple[int, int]:
    d = hashlib.blake2b(key.encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class CuckooFilter:
    """A set of 64-bit hashes with 16-bit fingerprints: add, delete, look up; no false negatives."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, (int(capacity / SLOTS / 0.8) | 1).bit_length())
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)
        self.rng = np.random.default_rng(1)

    @classmethod
    def of(cls, marks: bytes) -> CuckooFilter:
        """The filter that ``marks``, its table's bytes, was made of."""
        out = cls(1)
        out.table = np.frombuffer(marks, np.uint16).reshape(-1, SLOTS).copy()
        out.buckets = len(out.table)
        return out

    def _places(self, k: int) -> tuple[int, int, int]:
        k &= (1 << 64) - 1
        mark = (k >> 48) % 65535 + 1
        one = k % self.buckets
        return mark, one, self._other(one, mark)

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def add(self, k: int) -> None:
        mark, one, two = self._places(k)
        for place in (one, two):
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        place, path = one, []
        for _ in range(KICKS):
            slot = int(self.rng.integers(SLOTS))
            path.append((place, slot, int(self.table[place, slot])))
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = self._other(place, mark)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = mark
                return
        for place, slot, was in reversed(path):
            self.table[place, slot] = was
        raise OverflowError("the filter is full; build it anew with a larger capacity")

    def delete(self, k: int) -> None:
        mark, one, two = self._places(k)
        for place in (one, two):
            hit = np.flatnonzero(self.table[place] == mark)
            if len(hit):
                self.table[place, hit[0]] = 0
                return
        raise KeyError("not in the filter")

    def __contains__(self, k: int) -> bool:
        return bool(self.has(np.array([k & (1 << 64) - 1], np.uint64))[0])

    def has(self, k: np.ndarray) -> np.ndarray:
        """Which of the 64-bit words are in."""
        mark = (k >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        one = k & np.uint64(self.buckets - 1)
        two = (one ^ (mark * np.uint64(0x5BD1E995))) & np.uint64(self.buckets - 1)
        mark = mark.astype(np.uint16)[:, None]
        return (self.table[one] == mark).any(1) | (self.table[two] == mark).any(1)


def build_filter(keys) -> CuckooFilter:
    """A filter of distinct keys, as large as they need."""
    keys = list(keys)
    capacity = max(16, len(keys))
    while True:
        try:
            out = CuckooFilter(capacity)
            for k in keys:
                out.add(k)
            return out
        except OverflowError:
            capacity *= 2


# --- lines and counts -----------------------------------------------------------------------------


def _listed(least_chars: int):
    """Of (r1, r2, text as bytes): (r1, r2, at, k1, k2, first) of every line whose key is long enough; ``first``: not in
    an earlier line of the text."""
    strip = _STRIP.encode()

    def short(key: bytes) -> bool:
        return len(key) < least_chars or len(key) < 4 * least_chars and sum(b & 0xC0 != 0x80 for b in key) < least_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, bytes] = {}
        names = ["r1", "r2", "at", "k1", "k2", "first"]

        def out() -> pa.RecordBatch:
            rows, keys = np.array(texts, np.int64), np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            cols = [rows[:, 0], rows[:, 1], np.array(places, np.int32), keys[:, 0], keys[:, 1], np.array(firsts, bool)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)

        for batch in batches:
            texts, places, digests, firsts = [], [], [], []
            for r1, r2, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen = set()
                for at, line in enumerate(text.split(b"\n")):
                    key = line.strip(strip).lower()
                    if short(key):
                        continue
                    digest = memo.get(key)
                    if digest is None:
                        digest = hashlib.blake2b(key, digest_size=16).digest()
                        if len(key) < 1000:
                            if len(memo) > 50_000:
                                memo.clear()
                            memo[key] = digest
                    texts.append((r1, r2))
                    places.append(at)
                    digests.append(digest)
                    firsts.append(digest not in seen)
                    seen.add(digest)
                    if len(places) > 50_000:
                        yield out()
                        texts, places, digests, firsts = [], [], [], []
            if places:
                yield out()

    return run


def _named(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    """The columns ``more``, two hashes that name the text (rows of equal text lose equal lines), and the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*more, F.xxhash64(text).alias("r1"), F.xxhash64(F.lit(1), text).alias("r2"), text.alias("text"))


def _lines(docs: DataFrame, text_col: str, least_chars: int) -> DataFrame:
    rows = _named(docs, text_col).withColumn("text", F.col("text").cast("binary"))
    return rows.mapInArrow(lean(_listed(least_chars)), f"r1 long, r2 long, at int, {_KEY}, first boolean")


def _counts(lines: DataFrame) -> DataFrame:
    return lines.where("first").groupBy("k1", "k2").agg(F.count("*").alias("n"))


def reference_counts(docs: DataFrame, *, text_col: str = "text", least_chars: int = 1) -> DataFrame:
    """(k1, k2, n): in how many rows each key is."""
    return _counts(_lines(docs, text_col, least_chars))


# --- the index ------------------------------------------------------------------------------------


@dataclass
class LineIndex:
    """``counts`` (k1, k2, n) of all keys, and ``filters`` (shard, marks) of those in at least ``least`` documents."""

    counts: DataFrame
    filters: DataFrame
    least: int
    least_chars: int
    shards: int

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n") >= self.least).select(_shard(self.shards).alias("shard"), "k1", "k2")

    def save(self, path: str) -> None:
        """Writes the index under a folder that all machines see; ``load`` reads it."""
        self.counts.write.parquet(f"{path}/counts")
        self.filters.write.parquet(f"{path}/filters")
        options = [(self.least, self.least_chars, self.shards)]
        self.counts.sparkSession.createDataFrame(options, "least int, least_chars int, shards int").write.parquet(f"{path}/options")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineIndex:
        return cls(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/filters"), *spark.read.parquet(f"{path}/options").first())


def _shard(shards: int) -> Column:
    return F.pmod("k2", F.lit(shards)).cast("int")


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (shard, k1, k2) sorted by shard: a filter per shard."""
    now, keys = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([build_filter(keys).table.tobytes()], pa.binary())], names=["shard", "marks"])

    for batch in batches:
        for shard, k1 in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != now and keys:
                yield out()
                keys = []
            now = shard
            keys.append(k1)
    if keys:
        yield out()


def _filters(frequent: DataFrame, shards: int) -> DataFrame:
    return frequent.repartition(shards, "shard").sortWithinPartitions("shard", "k1", "k2").mapInArrow(lean(_built), "shard int, marks binary")


def _index_of(counts: DataFrame, scratch: Scratch, least: int, least_chars: int) -> LineIndex:
    counts = scratch.table(counts, "counts")
    shards = max(SHARDS, -(-counts.where(F.col("n") >= least).count() // SHARD_KEYS))
    index = LineIndex(counts, counts, least, least_chars, shards)
    index.filters = scratch.table(_filters(index.frequent(), shards), "filters")
    return index


def build(docs: DataFrame, *, least: int = 10, least_chars: int = 1, text_col: str = "text") -> LineIndex:
    """The index of ``docs``; its tables are in the shared folder until the session ends (``save`` keeps them)."""
    scratch = Scratch(docs.sparkSession, "line-index")
    return _index_of(reference_counts(docs, text_col=text_col, least_chars=least_chars), scratch, least, least_chars)


def _updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (shard, kind, k1, marks) sorted by the first two, with a shard's filter as kind 0, keys to delete as 1, keys to
    add as 2: the filters, null where one overflowed."""
    now, held = None, None

    def out() -> pa.RecordBatch:
        marks = [held.table.tobytes() if isinstance(held, CuckooFilter) else None]
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array(marks, pa.binary())], names=["shard", "marks"])

    for batch in batches:
        for shard, kind, k1, marks in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != now:
                if now is not None:
                    yield out()
                now, held = shard, CuckooFilter(16)
            if kind == 0:
                held = CuckooFilter.of(marks)
            elif isinstance(held, CuckooFilter):
                try:
                    held.delete(k1) if kind == 1 else held.add(k1)
                except OverflowError:
                    held = "full"
    if now is not None:
        yield out()


def _changed(index: LineIndex, docs: DataFrame, sign: int, text_col: str) -> LineIndex:
    scratch = Scratch(docs.sparkSession, "line-index")
    delta = reference_counts(docs, text_col=text_col, least_chars=index.least_chars)
    both = index.counts.select("k1", "k2", F.col("n").alias("before"), F.col("n").alias("after"))
    both = both.union(delta.select("k1", "k2", F.lit(0).cast("long"), F.col("n") * sign))
    both = scratch.table(both.groupBy("k1", "k2").agg(F.sum("before").alias("before"), F.sum("after").alias("after")), "changes")
    counts = both.where("after > 0").select("k1", "k2", F.col("after").alias("n"))
    was, is_ = F.col("before") >= index.least, F.col("after") >= index.least
    crossed = both.where(was != is_).select(_shard(index.shards).alias("shard"), F.when(is_, 2).otherwise(1).alias("kind"), "k1", F.lit(None).cast("binary").alias("marks"))
    held = index.filters.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("k1"), "marks")
    todo = held.union(crossed).repartition(index.shards, "shard").sortWithinPartitions("shard", "kind", "k1")
    filters = scratch.table(todo.mapInArrow(lean(_updated), "shard int, marks binary"), "updated")
    out = LineIndex(scratch.table(counts, "counts"), filters, index.least, index.least_chars, index.shards)
    full = filters.where("marks is null").select("shard")
    if not full.isEmpty():
        anew = _filters(out.frequent().join(full, "shard", "left_semi"), index.shards)
        out.filters = scratch.table(filters.where("marks is not null").unionByName(anew), "filters")
    scratch.drop("changes")
    return out


def insert(index: LineIndex, docs: DataFrame, *, text_col: str = "text") -> LineIndex:
    """The index with the rows of ``docs`` added."""
    return _changed(index, docs, 1, text_col)


def delete(index: LineIndex, docs: DataFrame, *, text_col: str = "text") -> LineIndex:
    """The index without the rows of ``docs``, which must be among those added before."""
    return _changed(index, docs, -1, text_col)


# --- looking up -----------------------------------------------------------------------------------


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (shard, k1, k2) sorted: the keys of each shard as one value."""
    now, parts = None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([b"".join(parts)], pa.binary())], names=["shard", "exact"])

    for batch in batches:
        shard = batch.column(0).to_numpy()
        keys = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], 1)
        starts = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1)) if len(shard) else []
        for a, b in zip(starts, [*starts[1:], len(shard)]):
            if shard[a] != now and parts:
                yield out()
                parts = []
            now = int(shard[a])
            parts.append(keys[a:b].tobytes())
    if parts:
        yield out()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shard, copy, marks, exact, r1, r2, at, k1, k2), sorted so that a shard's filter and keys come before its
    lines: (r1, r2, at) of the lines whose key is frequent."""
    kind = np.dtype([("a", "<i8"), ("b", "<i8")])
    now, marks, exact = None, None, np.zeros(0, kind)
    for batch in batches:
        place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
        heads = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero((np.diff(place, axis=0) != 0).any(1)) + 1
        edges = np.unique(np.concatenate(([0], heads, heads + 1, cuts, [len(place)])))
        k1, k2 = (pc.fill_null(batch.column(i), 0).to_numpy() for i in (7, 8))
        for a, b in zip(edges, edges[1:]):
            if now != tuple(place[a]):
                now, marks = tuple(place[a]), None
            if batch.column(2)[a].is_valid:
                marks = CuckooFilter.of(batch.column(2)[a].as_py())
                exact = np.frombuffer(batch.column(3)[a].as_py(), kind)
            elif marks is not None:
                found = np.flatnonzero(marks.has(k1[a:b].view(np.uint64)))
                keys = np.empty(len(found), kind)
                keys["a"], keys["b"] = k1[a:b][found], k2[a:b][found]
                at = np.minimum(np.searchsorted(exact, keys), len(exact) - 1)
                found = pa.array(found[exact[at] == keys] + a)
                if len(found):
                    yield pa.RecordBatch.from_arrays([batch.column(i).take(found) for i in (4, 5, 6)], names=["r1", "r2", "at"])


def _hits(index: LineIndex, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(r1, r2, gone): the places of the frequent lines of each text that has any."""
    parts = shuffle_partitions(lines.sparkSession)
    frequent = index.frequent().repartition(index.shards, "shard").sortWithinPartitions("shard", "k1", "k2")
    exact = frequent.mapInArrow(lean(_gathered), "shard int, exact binary")
    lines = lines.withColumn("shard", _shard(index.shards))
    load = scratch.table(lines.groupBy("shard").agg(F.count("*").alias("n")), "load")  # a row for each shard
    each = max(ASKS, (load.agg(F.sum("n")).first()[0] or 0) // (4 * parts))
    copies = load.select("shard", F.ceil(F.col("n") / each).cast("int").alias("copies"))
    blank = [F.lit(None).cast("binary").alias(c) for c in ("marks", "exact")]
    asked = lines.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("r1", "r2", "at"), "copies").cast("int"))
    asked = asked.select("shard", "copy", *blank, "r1", "r2", "at", "k1", "k2")
    heads = index.filters.join(exact, "shard").join(copies, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    heads = heads.select("shard", "copy", "marks", "exact", *(F.lit(None).cast(t).alias(c) for c, t in (("r1", "long"), ("r2", "long"), ("at", "int"), ("k1", "long"), ("k2", "long"))))
    both = heads.union(asked).repartition(parts, "shard", "copy").sortWithinPartitions("shard", "copy", F.col("marks").isNull())
    found = both.mapInArrow(lean(_confirmed), "r1 long, r2 long, at int")
    return found.groupBy("r1", "r2").agg(F.collect_set("at").alias("gone"))  # not more than a text has lines


def line_dedup(docs: DataFrame, *, least: int = 10, least_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", index: LineIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept (the text that stays).

    ``index``: what the lines are looked up in, with limits of its own; by default that of ``docs`` itself.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.table(_lines(docs, text_col, index.least_chars if index else least_chars), "lines")
    index = index or _index_of(_counts(lines), scratch, least, least_chars)
    hits = scratch.table(_hits(index, lines, scratch), "hits")
    scratch.drop("lines", "load", "counts", "filters")  # those of a given index are elsewhere
    rows = _named(docs, text_col, F.col(id_col).cast("long").alias("doc_id"))
    text, gone = F.col("text"), F.col("gone")

    def left(parts: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
        return F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")

    return rows.join(hits, ["r1", "r2"], "left").select(
        "doc_id",
        (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(gone.isNull(), text).otherwise(let(F.split(text, "\n", -1), left)).alias("kept"),
    )
