"""Importance resampling towards a target: documents are drawn by how much likelier their hashed n-grams are in the target.

Features of a text are its runs of one to three words, hashed to ``BUCKETS`` buckets by crc32. Each batch of a partition's texts
becomes one array of word ids. Its suffix array, in order to the depth of the longest feature, brings equal n-grams together: the
runs of suffixes whose longest common prefix has at least n words are the occurrences of one n-gram. It is hashed once for a run, from the
hashes of its words, and the bucket goes back to the places of all its occurrences. The first pass counts buckets, and each task gives at most
one row for each; the second sums the gains of every document's features. Batches are bounded by bytes, and suffix arrays by
``BLOCK_WORDS``, so memory is bounded whatever the texts; counts cover all texts. Only the gains (one number a bucket) are sent to tasks.

Ranks are places in a range partitioning of all scores that is written once: no task sees them all, and one number
of each part comes to the driver.

Defined cases: null and empty texts have no features, weight 0 and no rank; a null document id is hashed as '' and is the last of
its ties; repeated rows are documents of their own and may both be drawn; texts of any length are taken whole; bytes that are not UTF-8 are letters
as they are; an empty target gives gains of an empty target; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, numbered, runs, text_buffer

BUCKETS = 10_000
#: Words of which one suffix array is made at most.
BLOCK_WORDS = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BITS = 21  # of a word id in a sort key; three make one


class Words:
    """The words of a batch as ids of its distinct words, with what the hashes of their sequences need."""

    def __init__(self, texts: pa.Array):
        data, offsets = text_buffer(texts)
        inside = _LETTER[data]
        starts, ends, self.row = runs(inside, offsets)
        self.rows = len(offsets) - 1
        ends_in_packed = np.concatenate(([0], np.cumsum(ends - starts, dtype=np.int64)))
        packed = np.ascontiguousarray(_LOWER[data[inside]])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_in_packed), pa.py_buffer(packed)])
        coded = words.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = coded.dictionary.to_pylist()
        self.crc = np.array([zlib.crc32(w) for w in known], np.uint32)
        self.crc_after_space = np.array([zlib.crc32(w, zlib.crc32(b" ")) for w in known], np.uint32)
        sizes, self.size = np.unique([len(w) + 1 for w in known], return_inverse=True)
        self.shifts = np.stack([shift_table(int(n)) for n in sizes]) if known else np.zeros((0, 4, 256), np.uint32)

    def longer(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """crc32 of sequences with the crc32 ``crc``, once a space and ``word`` follow."""
        table, out = self.size[word], self.crc_after_space[word].copy()
        for k in range(4):
            out ^= self.shifts[table, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
        return out


def shift_table(n: int) -> np.ndarray:
    """What n bytes more make of a crc32, for each value of each of its four bytes: crc32(a + b) is that of a, shifted by the
    length of b, xor that of b."""
    zeros = bytes(n)
    base = zlib.crc32(zeros)
    bits = np.array([zlib.crc32(zeros, 1 << i) ^ base for i in range(32)], np.uint32)
    out = np.zeros((4, 256), np.uint32)
    for i in range(32):
        out[i // 8, (np.arange(256) >> (i % 8)) & 1 == 1] ^= bits[i]
    return out


def blocks_of_runs(words: Words, most: int = BLOCK_WORDS) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each block of at most ``most`` words its first and last place, and for n-grams of 1, 2 and 3 words (bucket, first, order): the
    bucket of each run, where it begins in the suffix array, and that array. Runs of ends of texts that are shorter have
    bucket -1."""
    n = len(words.ids)
    for first in range(0, n, most):
        last = min(n, first + most)
        # ids from 1 within the block; two words more, so that n-grams may reach beyond it; 0 is the end of a text
        _, near = np.unique(words.ids[first : last + 2], return_inverse=True)
        near = np.concatenate((near + 1, [0, 0])).astype(np.int64)
        row = np.concatenate((words.row[first : last + 2], [-1, -1]))
        size = last - first
        second = np.where(row[1 : size + 1] == row[:size], near[1 : size + 1], 0)
        third = np.where(row[2 : size + 2] == row[:size], near[2 : size + 2], 0)
        key = (near[:size] << (2 * _BITS)) | (second << _BITS) | third
        order = np.argsort(key)
        key = key[order]
        # words that a suffix has in common with the one before it
        lcp = np.zeros(size, np.int8)
        for depth, down in ((1, 2 * _BITS), (2, _BITS), (3, 0)):
            lcp[1:][(key[1:] >> down) == (key[:-1] >> down)] = depth
        ids = words.ids[first : last + 2]
        found, crc = [], np.zeros(0, np.uint32)
        for depth in (1, 2, 3):
            begin = np.flatnonzero(lcp < depth)
            at = order[begin]
            if depth == 1:
                crc = words.crc[ids[at]]
                there = np.ones(len(begin), dtype=bool)
            else:
                there = (key[begin] >> ((3 - depth) * _BITS)) & ((1 << _BITS) - 1) > 0
                # each run lies in one of the n-gram that is a word shorter
                shorter = np.cumsum(lcp < depth - 1)[begin] - 1
                before, crc = crc, np.zeros(len(begin), np.uint32)
                crc[there] = words.longer(before[shorter[there]], ids[at[there] + depth - 1])
            bucket = np.where(there, (crc % np.uint32(BUCKETS)).astype(np.int32), -1)
            found.append((bucket, begin, order))
        yield first, last, found


def count_buckets(texts: pa.Array) -> np.ndarray:
    out = np.zeros(BUCKETS + 1, np.int64)  # the last is for -1
    for first, last, found in blocks_of_runs(Words(texts)):
        for bucket, begin, _ in found:
            times = np.diff(np.append(begin, last - first))
            out += np.bincount(bucket % (BUCKETS + 1), weights=times, minlength=BUCKETS + 1).astype(np.int64)
    return out[:BUCKETS]


def weigh(texts: pa.Array, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of words, and sum of the gains of all features, of each text."""
    words = Words(texts)
    gains = np.append(gains, 0)  # of bucket -1
    each = np.zeros(len(words.ids), np.int64)
    for first, last, found in blocks_of_runs(words):
        for bucket, begin, order in found:
            place = np.empty(last - first, np.int32)
            place[order] = np.repeat(bucket, np.diff(np.append(begin, last - first)))
            each[first:last] += gains[place]
    n = np.bincount(words.row, minlength=words.rows)
    ends = np.cumsum(n)
    sums = np.concatenate(([0], np.cumsum(each)))
    return n, sums[ends] - sums[ends - n]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n) of the features of all texts; ``texts``: one column ``text``."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += count_buckets(batch.column(0))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return texts.mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t+1)*(S+B) / ((s+1)*(T+B)))) in doubles for each of B buckets."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def importance_resampling(
    docs: DataFrame, target: DataFrame, *, percent: int = 5, least_words: int = 20, seed: str = "42", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, and its rank if it is one of the ``percent`` of
    a hundred documents of at least ``least_words`` words that are drawn: those of the greatest weight and Gumbel noise."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")

    def counted(texts) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int64)
        for r in bucket_counts(texts).collect():  # a row a bucket
            out[r["bucket"]] = r["n"]
        return out

    text = lambda df, c: df.select(F.col(c).cast("string").cast("binary").alias("text"))
    gains = gains_of(counted(text(docs, text_col)), counted(text(target, target_text_col)))

    def run(batches):
        for batch in batches:
            n, weight = weigh(batch.column(1), gains)
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(name, 256), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = scratch.table(rows.withColumns({"score": F.col("weight") + noise, "tie": F.monotonically_increasing_id()}), "scored")

    able = F.col("n_words") >= least_words
    placed, n = numbered(rows.where(able), scratch, "ordered", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "tie")
    drawn = percent * n // 100
    place = F.col("place") + 1
    ranked = placed.withColumn("rank", F.when(place <= drawn, place))
    rest = rows.where(~able).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
