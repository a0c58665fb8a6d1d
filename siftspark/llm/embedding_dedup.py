"""Embedding near-dedup: a navigable small-world graph per shard, every shard queried, cosines verified.

Vectors with equal components are one class, so copies are neither indexed nor compared again. Classes are dealt
by hash into shards of bounded size; a task builds the graph of one shard and audits it against brute force: on a sample of
its vectors, each without its match with itself, and, as true links may be rare, on as many vectors made from the sample
whose cosine with their origin lies between the threshold and 1. The beam widens until both audits reach ``RECALL``.
Blocks of vectors are then sent to the shards, each pair of shards meeting once; a sample of every foreign block is audited
too, and a block that fails is asked with a wider beam. A full beam widens further, and one as wide as the
shard is brute force. What a beam finds is checked in double precision. Links inside a shard are reduced to labels, so a
query names each of a shard's components once; counts of links are added up instead of listing pairs. What the audits
wanted and found with the beam that was used in the end is logged.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components link with nothing; only vectors of
equal length are compared; a null id is kept, links with nothing and has a null component; rows of the same
id and equal vectors count as separate vectors; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lean
from .components import connected_components
from .hnsw import Graph

_log = logging.getLogger(__name__)

#: Least number of shards, and most classes in one on average.
SHARDS, SHARD_SIZE = 12, 65_536
BLOCK = 512
#: Share of links that audits must find; vectors of a shard, and of a foreign block, that are audited; beam to begin with.
RECALL, AUDIT, SPOT, BEAM = 0.995, 256, 32, 16
#: Single precision of the beam against double precision of the check.
SLACK = 1e-4


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (vec_id, embedding as doubles): validity, a hash of the vector and its bytes."""
    for batch in batches:
        column = batch.column(1)
        flat = pc.fill_null(column.flatten(), math.nan).to_numpy()
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
        good, k1, k2, raw = [], [], [], []
        for a, b in zip(np.concatenate(([0], ends)), ends):
            x = flat[a:b]
            ok = b > a and bool(np.isfinite(x).all()) and bool(x.any())
            x = (x / np.abs(x).max() if ok else x[:0]) + 0.0
            d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            good.append(ok)
            k1.append(int.from_bytes(d[:8], "little", signed=True))
            k2.append(int.from_bytes(d[8:], "little", signed=True))
            raw.append(x.tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good, pa.bool_()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "good", "k1", "k2", "raw"])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (dim, shard, rep, k1, n, raw) sorted by the first two: blocks of one shard."""
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("ns", pa.binary()), ("x", pa.binary())])
    now, rows = None, []

    def out() -> pa.RecordBatch:
        ids = np.array([r[:2] for r in rows], np.int64).tobytes()
        ns = np.array([r[2] for r in rows], np.int64).tobytes()
        cols = [[now[0]], [now[1]], [ids], [ns], [b"".join(r[3] for r in rows)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for batch in batches:
        for dim, shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and (now != (dim, shard) or len(rows) == BLOCK):
                yield out()
                rows = []
            now = (dim, shard)
            rows.append(row)
    if rows:
        yield out()


class _Shard:
    def __init__(self, parts: list[tuple[bytes, bytes, bytes]], dim: int, least: float):
        self.least = least
        self.ids = np.concatenate([np.frombuffer(p[0], np.int64).reshape(-1, 2) for p in parts])
        self.ns = np.concatenate([np.frombuffer(p[1], np.int64) for p in parts])
        x = np.concatenate([np.frombuffer(p[2], np.float64).reshape(-1, dim) for p in parts])
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.graph = Graph(self.unit)
        self.linked = np.zeros(len(self.ids), np.int64)
        self.label = np.arange(len(self.ids))
        self.beam = BEAM
        self.wanted = self.found = 0
        self._audit()

    def _links(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of rows with the shard by brute force."""
        q, m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, (8 << 20) // (8 * max(1, len(self.unit))))
        for a in range(0, len(unit), step):
            i, j = np.nonzero(unit[a : a + step] @ self.unit.T >= self.least - SLACK)
            # as ``pairs`` checks them, to the last bit
            good = np.einsum("ij,ij->i", unit[i + a], self.unit[j]) >= self.least
            q.append(i[good] + a)
            m.append(j[good])
        return np.concatenate(q), np.concatenate(m)

    def _widen(self, unit: np.ndarray, itself: np.ndarray | None = None) -> None:
        """Widens the beam until it finds the links of rows, as brute force does; ``itself``: the rows' own nodes."""
        n = len(self.unit)

        def codes(q: np.ndarray, m: np.ndarray) -> np.ndarray:
            if itself is not None:
                q, m = q[m != itself[q]], m[m != itself[q]]
            return q * n + m

        want = codes(*self._links(unit))
        rows = np.unique(want // n)  # only rows with links can fail
        if not len(rows):
            return
        unit, itself = unit[rows], None if itself is None else itself[rows]
        want = np.searchsorted(rows, want // n) * n + want % n
        while True:
            found = int(np.isin(want, codes(*self.pairs(unit, self.beam))).sum())
            if found >= RECALL * len(want) or self.beam >= n:
                break
            self.beam *= 2
        self.wanted += len(want)
        self.found += found

    def _audit(self) -> None:
        """Of a sample of the shard: the vectors themselves, and others made from them that link with them."""
        rng = np.random.default_rng(5)
        some = rng.permutation(len(self.unit))[:AUDIT]
        self._widen(self.unit[some], some)
        x = self.unit[some]
        side = rng.normal(size=x.shape)
        side -= np.einsum("ij,ij->i", side, x)[:, None] * x
        width = np.linalg.norm(side, axis=1, keepdims=True)
        cosine = self.least + (1 - self.least) * rng.uniform(0.01, 0.9, (len(x), 1))
        made = cosine * x + np.sqrt(1 - cosine**2) * side / np.maximum(width, 1e-300)
        self._widen(made[width[:, 0] > 1e-9])  # one dimension has no other side

    def pairs(self, unit: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        if beam >= len(self.unit):
            return self._links(unit)
        q, m = self.graph.within(unit, self.least - SLACK, beam)
        good = np.zeros(len(q), bool)
        for a in range(0, len(q), 1 << 16):
            s = slice(a, a + (1 << 16))
            good[s] = np.einsum("ij,ij->i", unit[q[s]], self.unit[m[s]]) >= self.least
        return q[good], m[good]

    def own(self) -> None:
        """Links inside the shard, each pair once whoever found it, and their labels."""
        n = len(self.ids)
        codes = []
        for a in range(0, n, BLOCK):
            q, m = self.pairs(self.unit[a : a + BLOCK], self.beam)
            q = q + a
            codes.append(np.unique(np.minimum(q, m) * n + np.maximum(q, m)))
        code = np.unique(np.concatenate(codes))
        a, b = code // n, code % n
        a, b = a[a != b], b[a != b]
        self.linked += np.bincount(a, self.ns[b], n).astype(np.int64) + np.bincount(b, self.ns[a], n).astype(np.int64)
        while True:
            low = np.minimum(self.label[a], self.label[b])
            before = self.label.copy()
            np.minimum.at(self.label, a, low)
            np.minimum.at(self.label, b, low)
            self.label = self.label[self.label]
            if (before == self.label).all():
                break

    def query(self, ids: np.ndarray, ns: np.ndarray, x: np.ndarray):
        """Of a block of another shard: links of each row, and the edges (row, component of the shard)."""
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self._widen(unit[np.random.default_rng(len(unit)).permutation(len(unit))[:SPOT]])
        q, m = self.pairs(unit, self.beam)
        self.linked += np.bincount(m, ns[q], len(self.ids)).astype(np.int64)
        links = np.bincount(q, self.ns[m], len(ids)).astype(np.int64)
        code = np.unique(q * len(self.ids) + self.label[m])
        return links, ids[code // len(self.ids), 0], self.ids[code % len(self.ids), 0]


_FOUND = pa.schema([("rep", pa.int64()), ("k1", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _searched(least: float):
    """Of rows (dim, target, shard, is_query, ids, ns, x), sorted by target and role: counts and edges."""

    def counts(ids: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        on = links > 0
        cols = [ids[on, 0], ids[on, 1], links[on]]
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in cols), pa.nulls(int(on.sum()), pa.int64())], schema=_FOUND)

    def edges(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
        blank = pa.nulls(len(src), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(src)), blank, blank, pa.array(np.ascontiguousarray(dst))], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, shard = None, [], None

        def begin() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if shard is None and parts:
                shard = _Shard(parts, now[0], least)
                shard.own()
                roots = shard.label != np.arange(len(shard.label))
                yield edges(shard.ids[roots, 0], shard.ids[shard.label[roots], 0])

        def end() -> Iterator[pa.RecordBatch]:
            yield from begin()
            if shard is not None:
                yield counts(shard.ids, shard.linked)
                # the audits' figures are a row without a vector
                audited = [None], [shard.wanted], [shard.found], [None]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in audited], schema=_FOUND)

        for batch in batches:
            for dim, target, source, is_query, ids, ns, x in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (dim, target):
                    yield from end()
                    now, parts, shard = (dim, target), [], None
                if not is_query:
                    parts.append((ids, ns, x))
                    continue
                yield from begin()
                if shard is not None:
                    block = np.frombuffer(ids, np.int64).reshape(-1, 2)
                    links, src, dst = shard.query(block, np.frombuffer(ns, np.int64), np.frombuffer(x, np.float64).reshape(-1, dim))
                    yield counts(block, links)
                    yield edges(src, dst)
        yield from end()

    return run


def _places(spark: SparkSession, parts: int) -> DataFrame:
    """(target, place): numbers of which Spark's hash deals one to each of ``parts`` partitions, so that no two shards share
    a task."""
    numbers = spark.range(64 * parts).select(F.col("id").alias("place"), F.pmod(F.hash("id"), F.lit(parts)).alias("target"))
    return numbers.groupBy("target").agg(F.min("place").alias("place"))


def embedding_dedup(vectors: DataFrame, *, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", shard_size: int = SHARD_SIZE, shards: int = SHARDS) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    keyed = scratch.table(rows.mapInArrow(lean(_keyed), "vec_id long, good boolean, k1 long, k2 long, raw binary"), "keyed")
    good = F.col("good") & F.col("vec_id").isNotNull()
    classes = keyed.where(good).groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    classes = scratch.table(classes.withColumn("dim", (F.octet_length("raw") / 8).cast("int")), "classes")
    parts = max(shards, math.ceil(classes.count() / shard_size))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("k1", "k2"), F.lit(parts)).cast("int"))
    blocks = dealt.select("dim", "shard", "rep", "k1", "n", "raw").repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "rep", "k1")
    blocks = scratch.table(blocks.mapInArrow(lean(_blocked), "dim int, shard int, ids binary, ns binary, x binary"), "blocks")
    # every pair of shards once: a shard's blocks go to the next half of the ring
    half = parts // 2
    step = F.explode(F.sequence(F.lit(1), F.lit(half))) if half else F.explode(F.array().cast("array<int>"))
    asked = blocks.withColumn("step", step).withColumn("target", F.pmod(F.col("shard") + F.col("step"), F.lit(parts)))
    if parts % 2 == 0:
        asked = asked.where((F.col("step") < half) | (F.col("shard") < half))
    order = ["dim", "target", "shard", "is_query", "ids", "ns", "x"]
    both = blocks.withColumn("target", F.col("shard")).withColumn("is_query", F.lit(False)).select(*order)
    both = both.union(asked.withColumn("is_query", F.lit(True)).select(*order))
    both = both.join(_places(spark, parts), "target", "left").withColumn("place", F.coalesce("place", "target"))
    both = both.repartition(parts, "place").sortWithinPartitions("dim", "target", "is_query", "shard", "ids")
    found = scratch.table(both.select(*order).mapInArrow(lean(_searched(least)), "rep long, k1 long, links long, other long"), "found")
    joined = connected_components(found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst")), scratch)
    seen = found.where("rep is null").agg(F.sum("k1"), F.sum("links")).first()
    _log.info("audits wanted %s links and found %s", *(x or 0 for x in seen))
    links = found.where("rep is not null and other is null").groupBy("rep", "k1").agg(F.sum("links").alias("links"))
    facts = classes.select("k1", "k2", "rep", "n").join(links, ["rep", "k1"], "left").join(joined, F.col("rep") == F.col("node"), "left")
    facts = facts.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", good.alias("good"), "k1", "k2").join(facts, ["k1", "k2"], "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("good"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
