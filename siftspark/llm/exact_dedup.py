"""Exact dedup by owners that keep compressed radix (Patricia) tries of whole texts.

Two texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` is replaced by one
space. Every task first inserts its texts into a trie of its own, so a text with very many copies leaves
each task once; the distinct texts of the tasks are then dealt to owners by length and content hash, and
the owners insert the full byte strings. A terminal node holds the smallest id and the number of rows.
Beyond its memory budget a trie spills by subtree: a large subtree that leaves others behind goes out as rows that wait,
later texts under it follow them, and Spark deals what waits to the owners of another round, by length and hash with
another salt. Nothing is kept on a machine, so a lost task is run again like any other.

Defined cases: null text counts as empty; rows with a null id are counted in their group but are never
the row that stays (unless the group has no other id: then ``keep_id`` is null and all of its rows stay);
a row that appears twice with the same id is one document listed twice and both rows stay if it is the
smallest; a text longer than the budget is held whole, alone if it must be; bytes that are not UTF-8 are compared
as they are, except that Spark's replacement of white space turns them into U+FFFD where it changes a text; an
empty table gives an empty result; other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Scratch, lean, shuffle_partitions, whole

_ABSENT = (1 << 63) - 1
#: Bytes that a node takes beside its label.
_NODE = 300


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes at their beginning two strings share."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class PatriciaTrie:
    """Byte strings with a smallest id and a count each; puts subtrees out beyond ``budget`` bytes (0: never).

    A node is [label, children by first byte, [id, count] at a terminal]. A subtree that was put out leaves a node
    without children or terminal, whose label is its first byte."""

    def __init__(self, budget: int = 0):
        self.budget, self.size, self.terminals = budget, 0, 0
        self.root: list = [b"", {}, None]

    def add(self, text: bytes, owner: int, count: int = 1) -> Iterator[tuple[bytes, int, int]]:
        """Inserts; gives (text, id, count) of what goes out for it."""
        node, at = self.root, 0
        while True:
            if at == len(text):
                if node[2] is None:
                    node[2] = [owner, count]
                    self.terminals += 1
                    self.size += 100
                else:
                    node[2][0] = min(node[2][0], owner)
                    node[2][1] += count
                break
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, [owner, count]]
                self.terminals += 1
                self.size += len(text) - at + _NODE
                break
            label = child[0]
            if not child[1] and child[2] is None:
                yield text, owner, count
                return
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _shared(label, text[at : at + len(label)])
            fork = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            node[1][text[at]] = fork
            self.size += _NODE
            node, at = fork, at + same
        while self.budget and self.size > self.budget and self.terminals > 1:
            yield from self._put_out()

    @staticmethod
    def _walk(node: list, head: bytes) -> Iterator[tuple[bytes, int, int]]:
        todo = [(node, head)]
        while todo:
            node, head = todo.pop()
            if node[2] is not None:
                yield head, *node[2]
            todo.extend((c, head + c[0]) for c in node[1].values())

    def _weights(self) -> dict[int, tuple[int, int]]:
        """Bytes and terminals of every subtree, by the identity of its node."""
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(node[1].values())
        out: dict[int, tuple[int, int]] = {}
        for node in reversed(order):
            below = [out[id(c)] for c in node[1].values()]
            out[id(node)] = len(node[0]) + _NODE + sum(w for w, _ in below), (node[2] is not None) + sum(n for _, n in below)
        return out

    def _put_out(self) -> Iterator[tuple[bytes, int, int]]:
        """Below the first fork, the smallest subtree on the heaviest path of at least half the budget, or the heaviest."""
        held = self._weights()

        def real(node: list) -> list[list]:
            return [c for c in node[1].values() if held[id(c)][1]]

        node, head, forked = self.root, b"", False
        while True:
            forked = forked or len(real(node)) + (node[2] is not None) > 1
            child = max(real(node), key=lambda c: (held[id(c)][0], c[0]))
            if forked and all(2 * held[id(c)][0] < self.budget for c in real(child)):
                break
            node, head = child, head + child[0]
        first = child[0][:1]
        for entry in self._walk(child, head + child[0]):
            self.terminals -= 1
            yield entry
        node[1][first[0]] = [first, {}, None]
        self.size -= held[id(child)][0] - _NODE

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        """Every string that is still in, once: (text, smallest id, count)."""
        yield from self._walk(self.root, b"")


_ENTRY = "text binary, owner long, n long, waits boolean"
_SCHEMA = pa.schema([("text", pa.binary()), ("owner", pa.int64()), ("n", pa.int64()), ("waits", pa.bool_())])


def _merged(budget: int, flush: int):
    """Rows of (text, owner, n) to a row for each distinct text of the task.

    ``flush``: bytes after which a first-stage trie is emptied (it need not be complete); 0 for owners, which see
    everything, and let wait what they put out beyond ``budget``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rows, held = PatriciaTrie(0 if flush else budget), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

        def all_of(t: PatriciaTrie) -> Iterator[tuple]:
            return ((*x, False) for x in t.items())

        def entries() -> Iterator[tuple]:
            nonlocal trie
            for batch in batches:
                for text, owner, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    yield from ((*x, True) for x in trie.add(text, owner, n))
                    if flush and trie.size > flush:
                        full, trie = trie, PatriciaTrie()
                        yield from all_of(full)
            yield from all_of(trie)

        for row in entries():
            rows.append(row)
            held += len(row[0]) + 100
            if held > 4 << 20:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    return run


def _normal(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"{SPACES}+", " ")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", content_hash: str = "xxhash64({0})", budget: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``content_hash`` is the SQL expression that deals texts to owners; results do not depend on it, as
    owners compare whole texts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("content", F.expr(content_hash.format("text")).cast("long"))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _normal(text_col).cast("binary").alias("text"))
    entry = rows.select("text", F.coalesce("doc_id", F.lit(_ABSENT)).alias("owner"), F.lit(1).cast("long").alias("n"))
    dealt = placed(entry.mapInArrow(lean(_merged(budget, budget // 2)), _ENTRY)).repartition(shuffle_partitions(spark), "n_bytes", "content")
    turn, done = 0, []
    while True:
        got = dealt.select("text", "owner", "n").mapInArrow(lean(_merged(budget, 0)), _ENTRY)
        # whole texts only of what waits for the next round
        facts = placed(got).select(
            "n_bytes",
            "content",
            F.sha2("text", 256).alias("text_sha256"),
            F.when(F.col("owner") != _ABSENT, F.col("owner")).alias("keep_id"),
            "owner",
            "n",
            "waits",
            F.when(F.col("waits"), F.col("text")).alias("text"),
        )
        facts = scratch.table(facts, f"owners-{turn}")
        done.append(facts.where("not waits").select("n_bytes", "content", "text_sha256", "keep_id", F.col("n").alias("group_size")))
        waiting = facts.where("waits")
        if waiting.isEmpty():
            break
        turn += 1
        dealt = waiting.withColumn("salt", F.lit(turn)).repartition(shuffle_partitions(spark), "n_bytes", "content", "salt")
    owned = done[0]
    for more in done[1:]:
        owned = owned.union(more)
    keyed = placed(rows)
    key = ["n_bytes", "content"]
    if owned.groupBy(*key).count().where("count > 1").isEmpty():
        joined = keyed.drop("text").join(owned, key)
    else:  # different texts under one length and hash: the rows say which is theirs
        joined = keyed.withColumn("text_sha256", F.sha2("text", 256)).drop("text").join(owned, [*key, "text_sha256"])
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts the one of the smallest id, once."""
    scratch = Scratch(docs.sparkSession, "copies")
    found = scratch.table(exact_dedup(docs, id_col=id_col, text_col=text_col), "found")
    if found.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        lost = found.where("not kept").select(F.col("doc_id").alias("id"))
        left = whole(docs, id=F.col(id_col).cast("long")).join(lost, "id", "left_anti")
        return left.select("doc.*")
    # an id that recurs, or none, does not name a row
    rows = whole(docs, id=F.col(id_col).cast("long"), sha=F.sha2(_normal(text_col), 256))
    lost = found.where("not kept").select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_sha")).distinct()
    left = rows.join(lost, (F.col("sha") == F.col("lost_sha")) & F.col("id").eqNullSafe(F.col("lost_id")), "left_anti")
    if not found.where("kept").groupBy("text_sha256").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["sha"])
    return left.select("doc.*")
