"""Best-fit packing of tokenised documents into sequences of fixed capacity, by large-item matching.

Pieces above a third of the capacity fit at most twice into a sequence, so they are matched greedily: the
largest with the largest that fits beside it. Smaller pieces then go, largest first, where they leave the
smallest gap. The plan is made on the histogram of lengths, whose size is bounded by the capacity and not by
the corpus; sequences with equal contents are planned together. Pieces find their place by rank within
their length. No row is cut, dropped or moved except that documents above the capacity are cut into pieces.

Defined cases: null and empty texts have the end token alone; repeated rows and rows with null ids are packed
like any other; a very long text is tokenised whole and cut into pieces; bytes that are not UTF-8 become U+FFFD; an
empty table gives an empty result; columns other than id and text do not matter.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, shuffle_partitions

CAPACITY = 4096
#: Least pieces of one length that one task numbers before others help.
LEAST = 1000
#: Words whose ids a tokenising task remembers.
CACHE = 200_000


#: Letters that Unicode composition leaves alone and that lower-case one by one, then plain punctuation.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


def word_tokenizer(path: str) -> Callable[[str], bytes]:
    """The ids of a text, as little-endian unsigned 32-bit, under a lower-casing byte-level tokenizer file whose
    tokens never reach over white space: those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    As white space only separates, each word is tokenised once and remembered. Plain words go straight to the
    tokenizer's model; any other goes through the whole tokenizer.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, special = tokenizer.model.tokenize, {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    odd = any(_PLAIN.fullmatch(t) for t in special)
    letters_of = _byte_letters()
    def ids_of(word: str) -> bytes:
        plain = None if odd else _PLAIN.fullmatch(word)
        if plain is None or "<|" in word:
            return array("I", tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        letters, marks = plain.groups()
        ids = array("I")
        if letters:
            letters = letters.lower()
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(letters_of)
            ids.extend([t.id for t in model(letters)])
        if marks:
            ids.extend([t.id for t in model(marks)])
        return ids.tobytes()

    class Known(dict):
        def __missing__(self, word: str) -> bytes:
            if len(self) >= CACHE:
                self.clear()
            self[word] = ids = ids_of(word)
            return ids

    look_up = Known().__getitem__
    return lambda text: b"".join(map(look_up, text.replace("\n", " ").split(" ")))


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_tokenizer(tokenizer), array("I", [end_id]).tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode((text.as_py() or b"").decode(errors="replace")) + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)

    return run


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for ``histogram[length]`` pieces of every length.

    Rows (length, first rank, first sequence, pieces per sequence, offset): ranks from ``first rank`` to the
    next row's of that length go to consecutive sequences, so many to each, from ``offset`` on.
    """
    left = {s: n for s, n in histogram.items() if n}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("lengths must be from 1 to the capacity")
    taken = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> [(first sequence, number of sequences)]
    sequences = 0

    def put(size: int, gap: int, base: int, n: int, each: int) -> None:
        """``each`` pieces to each of ``n`` sequences that have ``gap`` left."""
        out.append((size, taken[size], base, each, capacity - gap))
        taken[size] += n * each
        left[size] -= n * each

    # large pieces: the largest beside the largest that fits, two to a sequence at most
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    for i, size in enumerate(large):
        partners = iter([t for t in large[i:] if size + t <= capacity])
        other = next(partners, None)
        while left[size]:
            while other is not None and (not left[other] or other == size and left[size] == 1):
                other = next(partners, None)
            if other is None:
                n = left[size]
                put(size, capacity, sequences, n, 1)
            elif other == size:
                n = left[size] // 2
                put(size, capacity, sequences, n, 2)
            else:
                n = min(left[size], left[other])
                put(size, capacity, sequences, n, 1)
                put(other, capacity - size, sequences, n, 1)
            gaps.setdefault(capacity - size - (other or 0), []).append((sequences, n))
            sequences += n
    # small pieces, largest first, into the smallest gap that holds them
    gaps.pop(0, None)
    order = sorted(gaps)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                gaps[capacity] = [(sequences, -(-left[size] // (capacity // size)))]
                sequences += gaps[capacity][0][1]
                order.append(capacity)
            gap = order[at]
            base, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            fit = gap // size
            full = min(n, left[size] // fit)
            new = []
            if full:
                put(size, gap, base, full, fit)
                new.append((gap - fit * size, base, full))
            used = full
            if full < n and left[size]:  # the last sequence takes what is left
                rest = left[size]
                put(size, gap, base + full, 1, rest)
                new.append((gap - rest * size, base + full, 1))
                used += 1
            if used < n:
                new.append((gap, base + used, n - used))
            for rest, first, count in new:
                if rest:
                    if rest not in gaps:
                        gaps[rest] = []
                        bisect.insort(order, rest)
                    gaps[rest].append((first, count))
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            found = {"sequence_id": row[:, 2] + nth // row[:, 3], "offset": row[:, 4] + nth % row[:, 3] * length}
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *(pa.array(x) for x in found.values())], names=[*names, *found])

    return run


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        lean(_pieces(tokenizer, capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )
    pieces = scratch.table(pieces.withColumn("nth", F.monotonically_increasing_id()), "pieces")
    # at most capacity rows, whatever the corpus
    lengths = [tuple(r) for r in pieces.groupBy("length").count().collect()]
    # the pieces of a length that very many have are numbered in several parts
    each = max(LEAST, sum(n for _, n in lengths) // (4 * shuffle_partitions(spark)))
    salts = spark.createDataFrame([(length, -(-n // each)) for length, n in lengths], "length long, salts long")
    pieces = pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("nth"), "salts"))
    # at most a row for each length and part
    counts = sorted(tuple(r) for r in pieces.groupBy("length", "salt").count().collect())
    histogram: dict[int, int] = {}
    first: list[tuple[int, int, int]] = []
    for length, salt, n in counts:
        first.append((length, salt, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    if not counts:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    base = np.array(first, dtype=np.int64)
    bases = spark.sparkContext.broadcast((base[:, 0] << 32 | base[:, 1], base[:, 2]))
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts = bases.value
        now, n = -1, 0
        for batch in batches:  # sorted: the rows of one length and salt follow each other
            key = batch.column("length").to_numpy() << 32 | batch.column("salt").to_numpy()
            change = np.flatnonzero(np.diff(key, prepend=now)) if len(key) else np.zeros(0, int)
            began = np.zeros(len(key), np.int64)
            began[change] = change
            began = np.maximum.accumulate(began)
            nth = np.arange(len(key)) - began
            head = change[0] if len(change) else len(key)
            nth[:head] += n
            if len(key):
                n = int(nth[-1]) + 1
                now = int(key[-1])
            rank = starts[np.searchsorted(keys, key)] + nth
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rank)], names=["doc_id", "piece", "start", "length", "ids_crc32", "rank"])

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long"
    ranked = (
        pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "salt")
        .repartition("length", "salt")
        .sortWithinPartitions("length", "salt", "doc_id", "piece", "ids_crc32")
        .mapInArrow(lean(numbered), f"{fields}, rank long")
    )
    return ranked.mapInArrow(lean(_place(shared)), f"{fields}, sequence_id long, offset long")
