"""Toxicity by a factorization machine over hashed terms.

Terms are words (letter runs in UTF-8, A-Z lower-cased) and, as inflected insults share their stem, the proper
beginnings of words of 3 to 9 bytes, hashed into 2**22 buckets; a document has each bucket once. A stem that is
harmless alone is another term than the same stem with an ending. The model is

    logit(x) = b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so that pairs, such as an insult with the mention of a group, weigh more or less than their words alone.
It is fitted on at most ``per_class`` labelled rows of each class (a documented bound; the rows whose seeded
hash of the id is smallest) over the buckets that tell the classes apart in them, alone or with another one. Every
row is scored on its whole text. Labels and ids are never inputs of a score.

Defined cases: null and empty texts get the score of no terms at all; labels that are null or of unknown
documents are ignored; without rows of both classes every score is the share of the class there is (0 without
any); repeated rows are scored each; texts of any length are scored whole, by their bytes whether UTF-8 or not; an empty
table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import _LETTER, Scratch, blocks, held_out, lean, mix, prefix_hash, runs, signed, small_batches, span_hash, whole
from .features import sample_ids, sample_texts

BUCKETS = 1 << 22
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
#: Factors of the machine.
FACTORS = 4
#: Terms whose pairs one step counts at once.
TILE = 1024
LEAST_BIAS = -2.5
#: Score from which a document counts as toxic.
CUT = 0.7


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every term, repeats included."""
    starts, ends, row = runs(_LETTER[data], offsets)
    sums = prefix_hash(data)
    hashed, rows = [span_hash(sums, starts, ends)], [row]
    for n in PREFIXES:
        keep = ends - starts > n
        hashed.append(span_hash(sums, starts[keep], starts[keep] + n) ^ np.uint64(0xA5A5A5A5 + n))
        rows.append(row[keep])
    return (np.concatenate(hashed) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(rows)


@dataclass
class Machine:
    bias: float
    bucket: np.ndarray  # sorted
    weight: np.ndarray
    factor: np.ndarray  # term x FACTORS

    def logits(self, term: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` rows with the given (distinct) terms, as indices of ``bucket``."""
        out = np.full(n, self.bias) + np.bincount(row, self.weight[term], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out


def _distinct(term: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row * width + term)
    return key % width, key // width


def _signature(buckets: np.ndarray) -> tuple[int, int]:
    """Two smallest hashes, which copies and near copies share."""
    if not len(buckets):
        return 0, 0
    x = buckets.astype(np.uint64)
    return tuple(int(signed(mix(x + np.uint64(seed)).min(keepdims=True))[0]) for seed in (1 << 40, 1 << 41))


def unlike(rows: list[tuple]) -> list[int]:
    """Of (signature, label): all clean rows, and the first toxic one of each signature. A toxic text that was
    copied often must not count as much evidence against each of its terms."""
    seen: dict = {}
    for i, (signature, label) in enumerate(rows):
        seen.setdefault(signature if label else i, i)
    return sorted(seen.values())


def _ratio(pos, neg, rate) -> np.ndarray:
    """The likelihood ratio of counts of toxic and clean rows against a share ``rate`` of toxic ones."""
    pos, neg, rate = np.broadcast_arrays(np.asarray(pos, float), np.asarray(neg, float), np.asarray(rate, float))
    seen = pos + neg
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(pos > 0, pos * np.log(pos / (seen * rate)), 0) + np.where(neg > 0, neg * np.log(neg / (seen * (1 - rate))), 0))


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _odds(pos: np.ndarray, neg: np.ndarray, n: int, good: int) -> np.ndarray:
    return ((pos + 0.1) / good) / ((neg + 0.1) / (n - good))


def choose(bucket: np.ndarray, pos: np.ndarray, neg: np.ndarray, n: int, good: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets, and their likelihood ratios against independence, that tell ``good`` toxic rows from the others of
    ``n`` alone: in at least 3 rows, and rare in clean rows, as in long texts every common word occurs."""
    pos, neg = pos.astype(float), neg.astype(float)
    g = _ratio(pos, neg, good / n)
    chosen = (pos + neg >= 3) & (g > 12) & (_odds(pos, neg, n, good) > 8)
    return bucket[chosen], g[chosen]


def pair_level(pos: np.ndarray, rate: float) -> tuple[int, float] | None:
    """The fewest toxic rows that a pair of terms needs, and the least ratio: as many pairs are tried, the ratio for one
    term is raised by twice the logarithm of their number, so that chance gives no more pairs than one test would.
    A term in fewer toxic rows can be in no such pair."""
    pos = np.sort(pos)
    for p in range(3, int(pos[-1]) + 1 if len(pos) else 0):
        m = len(pos) - int(np.searchsorted(pos, p))
        least = 12 + 2 * np.log(max(1.0, m * (m - 1) / 2))
        if -2 * p * np.log(rate) > least:
            return p, float(least)
    return None


def pair_ratios(a: np.ndarray, b: np.ndarray, good: int, level: tuple[int, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of 0/1 matrices (term x row, the ``good`` toxic rows first): indices of the pairs that tell the classes apart, and
    how well. Each term must tell them apart among the rows of the other, so that a common word beside an insult is no pair."""
    n = a.shape[1]
    pos, neg = a[:, :good] @ b[:, :good].T, a[:, good:] @ b[:, good:].T
    i, j = np.nonzero((pos >= level[0]) & (_odds(pos, neg, n, good) > 8))
    p, q = pos[i, j].astype(float), neg[i, j].astype(float)
    worth = _ratio(p, q, good / n)
    for x, k in ((a, i), (b, j)):
        own, other = x[:, :good].sum(1)[k].astype(float), x[:, good:].sum(1)[k].astype(float)
        share = own / (own + other)
        within = np.where(p > (p + q) * share, _ratio(p, q, share) + _ratio(own - p, other - q, share), 0)
        worth = np.minimum(worth, within)
    keep = worth > level[1]
    return i[keep], j[keep], worth[keep]


def constant(label: np.ndarray) -> Machine:
    """The machine for rows of one class, or none: their share of toxic ones."""
    p = min(max(float(np.mean(label)) if len(label) else 0.0, 1e-9), 1 - 1e-9)
    return Machine(float(np.log(p / (1 - p))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))


def fit(rows: list[np.ndarray], label: np.ndarray, bucket: np.ndarray, *, start: np.ndarray | float = 0.3, steps: int = 800, seed: int = 7) -> Machine:
    """``rows``: the distinct terms of each document, as indices of ``bucket``; ``start``: weights to begin with."""
    label, n, width = np.asarray(label, float), len(label), len(bucket)
    if not n or label.min() == label.max():
        return constant(label)
    term, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(n), [len(r) for r in rows])
    rng = np.random.default_rng(seed)
    m = Machine(LEAST_BIAS, np.asarray(bucket, np.int64), np.zeros(width) + start, rng.normal(0, 0.01, (width, FACTORS)))
    # full-batch Adam: the sample is small and its chosen terms are few
    state = [np.array([m.bias]), m.weight, m.factor]
    first, second = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    for step in range(1, steps + 1):
        m.bias = float(state[0][0])
        error = (1 / (1 + np.exp(-np.clip(m.logits(term, row, n), -30, 30))) - label) / n
        sums = np.stack([np.bincount(row, m.factor[term, f], n) for f in range(FACTORS)], 1)
        e = error[row]
        grads = [
            np.array([error.sum()]),
            np.bincount(term, e, width) + 1e-5 * m.weight,
            np.stack([np.bincount(term, e * (sums[row, f] - m.factor[term, f]), width) for f in range(FACTORS)], 1) + 1e-3 * m.factor,
        ]
        for x, g, a, b in zip(state, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        # without this the many clean rows push the bias so low that one term alone cannot make up for it
        state[0][0] = max(state[0][0], LEAST_BIAS)
    m.bias = float(state[0][0])
    return m


def buckets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct buckets of each text, sorted."""
    for _, data, offsets in blocks(texts):
        bucket, row = _distinct(*_terms(data, offsets), BUCKETS)
        cuts = np.searchsorted(row, np.arange(len(offsets)))
        yield from (bucket[a:b] for a, b in zip(cuts, cuts[1:]))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(buckets_of(batch.column(2)))
        marks = list(zip(*map(_signature, rows))) or [(), ()]
        cols = [*(pa.array(x, pa.int64()) for x in marks), pa.array([x.astype(np.int32).tobytes() for x in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "label", "s1", "s2", "buckets"])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (label, buckets): the task's counts of rows of each class for every bucket."""
    count = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        for label, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            count[int(label > 0), np.frombuffer(raw, np.int32)] += 1
    hit = np.flatnonzero(count.any(0))
    if len(hit):
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(count[1, hit].astype(np.int64)), pa.array(count[0, hit].astype(np.int64))], names=["bucket", "pos", "neg"])


def _narrowed(shared):
    """Of (label, buckets): the label and the terms that were chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for batch in batches:
            terms = [np.flatnonzero(np.isin(names, np.frombuffer(raw, np.int32))).astype(np.int32).tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary())], names=["label", "terms"])

    return run


def _marked(shared):
    """Of (label, buckets): the label and a bit for each of the given buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        for batch in batches:
            bits = [np.packbits(np.isin(names, np.frombuffer(raw, np.int32))).tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["label", "bits"])

    return run


def _tiled(shared, n: int, good: int, level: tuple[int, float]):
    """Of pairs of tiles of terms: each term's best pair in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for s, t in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = (np.unpackbits(bits[x * TILE : (x + 1) * TILE], axis=1, count=n).astype(np.float32) for x in (s, t))
                i, j, worth = pair_ratios(a, b, good, level)
                term = np.concatenate((i + s * TILE, j + t * TILE))
                hit, at = np.unique(term, return_inverse=True)
                best = np.zeros(len(hit))
                np.maximum.at(best, at, np.concatenate((worth, worth)))
                yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int64)), pa.array(best)], names=["term", "worth"])

    return run


def _unsettled(shared):
    """The rows (label, buckets) that single terms do not settle: clean ones, toxic ones that the machine over single
    terms misses, and those with a term that brings a clean row over the cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, doubtful = shared.value
        for batch in batches:
            terms = [np.flatnonzero(np.isin(m.bucket, np.frombuffer(raw, np.int32))) for raw in batch.column(1).to_pylist()]
            keep = [not y or bool(doubtful[t].any()) or m.logits(t, np.zeros(len(t), np.int64), 1)[0] < _logit(CUT) for y, t in zip(batch.column(0).to_pylist(), terms)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def best_pairs(used: DataFrame, single: Machine, doubtful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that tell the classes apart with another one in the rows that single terms do not settle, and the
    ratio of each one's best pair. All pairs of the terms that ``pair_level`` leaves are counted; a bit for each of
    these and each row of the sample goes through the driver."""
    spark = used.sparkSession
    rest = used.mapInArrow(lean(_unsettled(spark.sparkContext.broadcast((single, doubtful)))), "label int, buckets binary")
    count = {r["good"]: r["count"] for r in rest.groupBy((F.col("label") > 0).alias("good")).count().collect()}
    good, n = count.get(True, 0), sum(count.values())
    tally = _tally(rest).where("pos >= 3").toPandas() if 0 < good < n else None  # pairs of rarer terms reach no level
    level = pair_level(tally["pos"].to_numpy(), good / n) if tally is not None else None
    if level is None:
        return np.zeros(0, np.int64), np.zeros(0)
    bucket = np.sort(tally["bucket"].to_numpy()[tally["pos"].to_numpy() >= level[0]])
    got = rest.mapInArrow(lean(_marked(spark.sparkContext.broadcast(bucket))), "label int, bits binary").collect()
    rows = np.stack([np.frombuffer(r["bits"], np.uint8) for r in sorted(got, key=lambda r: -r["label"])])
    turned = [np.packbits(np.unpackbits(rows[:, c : c + TILE // 8], axis=1).T, axis=1) for c in range(0, rows.shape[1], TILE // 8)]
    # words and beginnings that are in the same rows are one term here
    same, of = np.unique(np.concatenate(turned)[: len(bucket)], axis=0, return_inverse=True)
    tiles = range(-(-len(same) // TILE))
    tasks = [(s, t) for s in tiles for t in tiles if s <= t]
    todo = spark.createDataFrame(tasks, "s int, t int").repartition(min(len(tasks), 64))
    found = todo.mapInArrow(lean(_tiled(spark.sparkContext.broadcast(same), n, good, level)), "term long, worth double")
    worth = np.zeros(len(same))
    for r in found.groupBy("term").agg(F.max("worth").alias("worth")).collect():
        worth[r["term"]] = r["worth"]
    worth = worth[of.ravel()]
    return bucket[worth > 0], worth[worth > 0]


def _tally(used: DataFrame) -> DataFrame:
    """(bucket, pos, neg) of (label, buckets)."""
    rows = used.mapInArrow(lean(_tallied), "bucket long, pos long, neg long")
    return rows.groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _rows_of(used: DataFrame, bucket: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """What each row of (label, buckets) has of the sorted ``bucket``, and the labels."""
    got = used.mapInArrow(lean(_narrowed(used.sparkSession.sparkContext.broadcast(bucket))), "label int, terms binary").collect()
    got.sort(key=lambda r: (r["label"], r["terms"]))
    return [np.frombuffer(r["terms"], np.int32) for r in got], np.array([r["label"] for r in got])


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """A machine from the rows of ``labels`` that are not held out.

    ``per_class`` bounds the sample, and with it the machine, which is broadcast: it has every term of the sample that tells the classes
    apart, at most one for each of ``BUCKETS``. The terms of the sample stay on the executors; to the driver come its ids and labels, the buckets that may be chosen, and what each row has of those that are.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxic-sample")
    known = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    sample = sample_ids(known, per_class)
    if not sample:
        return constant(np.zeros(0))
    fields = "doc_id long, label int, s1 long, s2 long, buckets binary"
    held = scratch.table(sample_texts(docs, sample, "int", id_col, text_col).mapInArrow(lean(_sampled), fields), "terms")
    rows = sorted(tuple(r) for r in held.select("doc_id", "label", "s1", "s2").distinct().collect())
    rows = [rows[i] for i in unlike([((s1, s2), label) for _, label, s1, s2 in rows])]
    label = np.array([r[1] for r in rows])
    if not len(label) or label.min() == label.max():
        return constant(label)
    own = spark.createDataFrame(rows, "doc_id long, label int, s1 long, s2 long")
    used = held.dropDuplicates(["doc_id", "label", "s1", "s2"]).join(F.broadcast(own), ["doc_id", "label", "s1", "s2"]).select("label", "buckets")
    # a bucket with fewer toxic rows can never be chosen
    tally = _tally(used).where("pos >= 3").toPandas()
    bucket, _ = choose(*(tally[c].to_numpy() for c in ("bucket", "pos", "neg")), len(label), int(label.sum()))
    names = np.unique(bucket)
    rows, label = _rows_of(used, names)
    machine = fit(rows, label, names)
    doubtful = np.zeros(len(names), bool)
    for own, y in zip(rows, label):
        if not y and machine.logits(own, np.zeros(len(own), np.int64), 1)[0] >= _logit(CUT):
            doubtful[own] = True
    more, _ = best_pairs(used, machine, doubtful)
    if len(more):
        names = np.unique(np.concatenate((bucket, more)))
        # common terms begin without a weight: in long texts they would add up
        machine = fit(*_rows_of(used, names), names, start=np.where(np.isin(names, bucket), 0.3, 0.0))
    scratch.close()
    return machine


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = shared.value
        at = np.full(BUCKETS, -1, np.int32)
        at[m.bucket] = np.arange(len(m.bucket))
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, data, offsets in blocks(batch.column(0)):
                bucket, row = _terms(data, offsets)
                term = at[bucket]
                hit = term >= 0
                n = len(offsets) - 1
                term, row = _distinct(term[hit].astype(np.int64), row[hit], max(1, len(m.bucket)))
                out[first : first + n] = 1 / (1 + np.exp(-np.clip(m.logits(term, row, n), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out)], names=[*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # bounded by the sample it was fitted on
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"))
    scored = rows.mapInArrow(lean(_scored(shared)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def reject_toxic(docs: DataFrame, machine: Machine, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = whole(docs, text=F.col(text_col)).select("text", "doc")
    fields = StructType([rows.schema["doc"], StructField("score", DoubleType())])
    return rows.mapInArrow(lean(_scored(shared)), fields).where(F.col("score") < CUT).select("doc.*")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``score`` with a machine of ``train``."""
    small_batches(docs.sparkSession)
    return score(docs, train(docs, labels, **options))
