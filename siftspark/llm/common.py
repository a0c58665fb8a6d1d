"""What the operators share: scratch tables in the cluster's shared folder, and text as numpy arrays.

Executors may be lost at any time, so every cut of the lineage is a Parquet table in the folder that
the cluster names in ``spark.checkpoint.dir``; nothing is kept in a machine-local folder.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder

#: The class ``[\x20\x09-\x0D]`` that separates words in every operator here.
SPACES = r"[\x20\x09-\x0D]"


#: Bytes of rows that go to a Python worker at once; one longer row goes alone.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's ``arrow.maxBytesPerBatch`` to ``BATCH_BYTES``, unless the session has a value of its own.

    Operators call this as they begin: what they return is lazy, so the setting must outlast the call. It bounds
    what whole texts of any length take beside the heap, and changes no result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":  # Spark's default
        spark.conf.set(key, f"{BATCH_BYTES}b")


class Scratch:
    """Tables of one call of an operator, under a folder of their own.

    ``table`` writes a DataFrame and reads it back; ``drop`` removes one that no later step reads.
    What is left goes when the session's process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        small_batches(spark)
        atexit.register(self.close)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def free(self) -> None:
        """Lets go of the shuffle files of steps that are over: Spark removes them when the driver's JVM finds that nothing
        refers to them, which on a large heap may be long after."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        try:
            self._remove(self.root)
        except Exception:  # the session is gone, and its folder is the cluster's to clean
            return


def whole(docs: DataFrame, **own: Column) -> DataFrame:
    """The rows of ``docs`` as one value ``doc`` each, beside columns of an operator's own: their names clash with none."""
    names = ("`" + c.replace("`", "``") + "`" for c in docs.columns)
    return docs.select(F.struct(*names).alias("doc"), *(c.alias(name) for name, c in own.items()))


def lower_az(c: Column) -> Column:
    """A-Z lower-cased, all else as it is; texts without other letters take the faster way."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, low))


def split_words(c: Column, between: str) -> Column:
    """The longest runs without a character of the class ``between``, which match its complement, in order."""
    return F.array_remove(F.split(c, f"{between}+"), "")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(rows: DataFrame, scratch: Scratch, name: str, *order: Column | str) -> tuple[DataFrame, int]:
    """``rows`` with their place in the given order, from 0 (``place``), and how many they are. They are dealt by ranges and written
    once, so that no task sees them all and a task that is run again finds the same order; one number of each part
    comes to the driver. The order should tell all rows apart, as equal ones are not dealt."""
    spread = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = scratch.table(spread.withColumns({"part": F.spark_partition_id(), "nth": nth}), name)
    before, starts = 0, []
    for part, n in sorted(tuple(r) for r in written.groupBy("part").count().collect()):
        starts.append((part, before))
        before += n
    starts = rows.sparkSession.createDataFrame(starts, "part int, before long")
    placed = written.join(F.broadcast(starts), "part").withColumn("place", F.col("before") + F.col("nth"))
    return placed.drop("part", "nth", "before"), before


def lean(run):
    """A function for ``mapInArrow`` that gives its memory back when its task ends: Spark keeps Python workers for later
    tasks, and what each of them holds on to counts against the executor."""

    def each(batches):
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return each


# --- text as arrays -------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

BLOCK_BYTES = 1 << 19


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the offsets of each row; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = arr.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(arr: pa.Array, most: int = BLOCK_BYTES, rows: int = 1 << 30):
    """Runs of at most ``rows`` whole rows of about ``most`` bytes: (first row, bytes, offsets)."""
    data, offsets = text_buffer(arr)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(n, max(end, row + 1), row + rows)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each longest run of True within a row."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` gives the hash of any span; A-Z hash as a-z."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inv = _power(_UNBASE, len(sums))
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word (longest run without SPACES)."""
    starts, ends, row = runs(~_SPACE[data], offsets)
    return span_hash(prefix_hash(data), starts, ends), row


def shingle_rows(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its distinct k-word shingles as sorted 64-bit hashes.

    With fewer than k words the whole sequence is the one shingle; without words there is none.
    """
    word, row = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    step = np.uint64(0xD6E8FEB86659FD93)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
    if len(word) >= k:
        acc = word[: len(word) - k + 1].copy()
        for j in range(1, k):
            acc = mix(acc * step + word[j : len(word) - k + 1 + j])
    for i in np.flatnonzero(count):
        a, c = first[i], int(count[i])
        if c >= k:
            out[i] = np.unique(acc[a : a + c - k + 1])
        else:
            x = word[a : a + 1].copy()
            for j in range(1, c):
                x = mix(x * step + word[a + j : a + j + 1])
            out[i] = mix(x + np.uint64(c))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit words as Spark's long."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
