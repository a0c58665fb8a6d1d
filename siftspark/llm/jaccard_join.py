"""N-gram Jaccard self-join by a token-group matrix.

Texts are sets of word shingles. Equal sets are one class. Classes with the same smallest (re-mixed) shingle
form a group, as similar sets mostly do; a group of more than ``MEMBERS`` classes is dealt into chunks. For every
group the matrix holds the union of its members' tokens. A class can only link with a member of a group if
it shares enough tokens with the group's union; groups that fall short are never opened. Which
(query, group) cells can qualify at all is read from the part of the matrix that prefixes span: in one order
of all tokens, two sets that link share ``m`` tokens among the first ``n - need + m`` of each, for any m up to what they
must share. With m growing with the set (``common_needed``), texts that share a few tokens by chance make no
cell. The order puts frequent tokens last, by a sketch of fixed width that counts the tokens of all documents; it
decides speed, never results.

Most texts share some tokens with others, each with another one. So only classes that share ``m`` tokens with one other
class take part: where a token has few classes, the pairs among them that may link are counted, else the token counts for all.

The result needs components, not all pairs. So the first round opens each chunk for its own members, and for
one anchor of every group at the largest group of each of its tokens. The second round opens chunks for the classes of another
component that share ``m`` tokens with some of its members. Near copies are joined by the first round, and no list of all
their pairs, or of the pairs of their groups, is made. A chunk that many classes ask is copied. No token, group or candidate is capped.

Defined cases: null and empty texts, and texts without words, have no shingles and link with nothing (each is
its own component); rows with a null id keep a null component; rows of the same id count as one document, with
their links pooled; texts of any length are read whole, by their bytes whether UTF-8 or not; an empty table gives an empty
result; other columns do not matter, whatever their names. Shingles are compared as 64-bit hashes and classes as pairs of such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, lean, mix, shingle_rows, shuffle_partitions, signed, whole
from .components import connected_components

#: Counters of the sketch, and the parts in which tasks hand them over.
WIDTH, PARTS = 1 << 21, 32
#: Classes of a group's chunk, on average at most, and queries of a copy of one.
MEMBERS, ASKS = 256, 256


def _class(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    a = mix(np.add.reduce(mix(tokens ^ np.uint64(0x51ED270B27B4A3C9)), keepdims=True) + np.uint64(len(tokens)))
    b = mix(np.add.reduce(mix(tokens + np.uint64(0x2545F4914F6CDD1D)), keepdims=True) ^ np.uint64(len(tokens)))
    return int(signed(a)[0]), int(signed(b)[0])


def _group(tokens: np.ndarray) -> int:
    return int(signed(mix(tokens * np.uint64(0x9FB21C651E98DF25)).min(keepdims=True))[0])


def _classes(k: int):
    """Of (doc_id, text): a row per document, and what the task adds to the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("h", pa.int64()), ("g", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())]
        schema = pa.schema(fields)
        sketch = np.zeros(WIDTH, np.int32)
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in blocks(batch.column(1)):
                rows = shingle_rows(data, offsets, k)
                made = [(len(t), *_class(t), _group(t)) if len(t) else (0, 0, 0, 0) for t in rows]
                np.add.at(sketch, (np.concatenate(rows) & np.uint64(WIDTH - 1)).astype(np.int64), 1)
                n = len(rows)
                cols = [pa.array(x, pa.int64()) for x in zip(*made)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, n), *cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        step = WIDTH // PARTS
        if sketch.any():
            # a byte for each: fifteenths of powers of two
            scaled = np.minimum(np.round(15 * np.log2(1.0 + sketch)), 255).astype(np.uint8)
            parts = [scaled[i * step : (i + 1) * step].tobytes() for i in range(PARTS)]
            blank = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([blank, blank, blank, blank, blank, pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            add = 2 ** (np.frombuffer(counts, np.uint8) / 15) - 1
            sums[part] = sums[part] + add if part in sums else add
    if sums:
        # only the order of magnitude matters for the order of tokens: eighths of powers of two
        level = [np.round(8 * np.log2(1 + x)).astype(np.uint16).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], names=["part", "counts"])


#: Columns of the rows of prefixes, ``place`` being n and at; least rows of a token that are dealt to several parts, and classes that
#: a task remembers.
_TOKENS = ["salt", "token", "place", "c"]
HOT, KNOWN = 4096, 100_000
#: Classes of a token up to which its pairs are looked at, and pairs of a class there up to which they are listed.
RUN, MET = 128, 8


def common_needed(n: int) -> int:
    """Tokens that the prefixes of two linked sets must share, of which the smaller has ``n`` tokens (or fewer, if
    they need not share as many in all)."""
    return 3 + n // 100


def _prefixes(k: int, num: int, den: int, shared):
    """Of (text): (salt, token, place, c) of the first tokens of each class, once for most classes of a task; ``salt`` deals
    the rows of a token that very many texts have, and is 0 for all others. Rows are narrow, as this is the largest shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, hot = shared.value
        done: set[tuple[int, int]] = set()
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                salts, tokens, places, names = [], [], [], []
                for t in shingle_rows(data, offsets, k):
                    if not len(t) or (key := _class(t)) in done:
                        continue
                    if len(done) >= KNOWN:
                        done.clear()
                    done.add(key)
                    n = len(t)
                    take = min(n, n - -(-num * n // den) + common_needed(n))
                    seen = level[(t & np.uint64(WIDTH - 1)).astype(np.int64)]
                    order = np.argsort(seen, kind="stable")[:take]
                    tokens.append(t[order])
                    places.append((n << 31) + np.arange(take))
                    deal = (2 ** (seen[order] / 8) / hot).astype(np.int64)
                    salts.append(np.where(deal > 0, 1 + key[0] % np.maximum(deal, 1), 0))
                    names.append(np.full(take, key[0]))
                if tokens:
                    cols = [np.concatenate(salts), signed(np.concatenate(tokens)), np.concatenate(places), np.concatenate(names)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=_TOKENS)

    return run


def early_needed(a, b, num: int, den: int):
    """What linked sets of ``a`` and ``b`` tokens share in all, and how many of these, in the order of all tokens the first,
    are within both prefixes."""
    needed = -(-(a + b) * num // (num + den))
    return needed, np.minimum(common_needed(np.minimum(a, b)), needed)


#: Columns of a token that a class may share with one it links with, and of two classes that meet at a token.
_SHARED = "token long, c long, n long, at long, wide boolean, other long, early long"


def _met(rows: np.ndarray, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of whole tokens' rows (salt, token, place, c) in order: the rows whose class may link with another one of the token, and
    the pairs of such classes with what they need. Where a class has more than ``MET`` of them, its pairs are not listed, and
    its row and those of its partners are ``wide``; so are those of tokens of more than ``RUN`` classes, and of dealt ones."""
    if not len(rows):
        return
    rows = rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(1)))]  # tasks may repeat a class
    salt, token, c = rows[:, 0], rows[:, 1], rows[:, 3]
    n, at = rows[:, 2] >> 31, rows[:, 2] & ((1 << 31) - 1)
    starts = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1))))
    size = np.diff(np.concatenate((starts, [len(rows)])))
    left = np.repeat(starts + size, size) - np.arange(len(rows))  # rows of the token from here on
    size = np.repeat(size, size)
    wide = salt > 0
    i = np.flatnonzero((size > RUN) & ~wide & (left > 1))
    i = i[n[i] * den >= n[i + 1] * num]  # sizes are in order, so one next to it is the nearest
    wide[i] = wide[i + 1] = True
    short, found = np.flatnonzero((size <= RUN) & (salt == 0) & (left > 1)), []
    for far in range(1, RUN):
        short = short[left[short] > far]
        if not len(short):
            break
        short = short[n[short] * den >= n[short + far] * num]
        a, b = short, short + far
        needed, early = early_needed(n[a], n[b], num, den)
        fits = np.minimum(n[a] - at[a], n[b] - at[b]) + early - 1 >= needed
        found.append((a[fits], b[fits], early[fits]))
    a, b, early = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    crowded = np.bincount(np.concatenate((a, b)), minlength=len(rows)) > MET
    unlisted = crowded[a] | crowded[b]
    keep = wide.copy()
    keep[a] = keep[b] = True
    wide[a[unlisted]] = wide[b[unlisted]] = True
    a, b, early = a[~unlisted], b[~unlisted], early[~unlisted]
    schema = pa.schema([(x, pa.bool_() if x == "wide" else pa.int64()) for x in _SHARED.replace(",", "").split()[::2]])
    no = lambda m, kind=pa.int64(): pa.nulls(m, kind)
    if m := int(keep.sum()):
        cols = [pa.array(np.ascontiguousarray(x[keep])) for x in (token, c, n, at, wide)]
        yield pa.RecordBatch.from_arrays([*cols, no(m), no(m)], schema=schema)
    if m := len(a):  # of one size, the class that comes first differs from token to token
        low, high = np.minimum(c[a], c[b]), np.maximum(c[a], c[b])
        yield pa.RecordBatch.from_arrays([no(m), pa.array(low), no(m), no(m), no(m, pa.bool_()), pa.array(high), pa.array(early)], schema=schema)


def _shared_tokens(num: int, den: int):
    """``_met`` of rows (salt, token, place, c) in order; a token's rows, which are bounded as those of frequent tokens are dealt,
    wait for its last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.zeros((0, 4), np.int64)
        for batch in batches:
            rows = np.concatenate((rows, np.stack([c.to_numpy() for c in batch.columns], 1)))
            ended = np.flatnonzero((rows[:, :2] != rows[-1:, :2]).any(1))
            if len(ended):
                yield from _met(rows[: ended[-1] + 1], num, den)
                rows = rows[ended[-1] + 1 :]
        yield from _met(rows, num, den)

    return run


def _sets(k: int):
    """Of (doc_id, text, c, h, ...): the set of each row whose text is of that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, h = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for first, data, offsets in blocks(batch.column(1)):
                rows = shingle_rows(data, offsets, k)
                good = [i for i, t in enumerate(rows) if len(t) and _class(t) == (c[first + i], h[first + i])]
                if good:
                    at = pa.array([first + i for i in good])
                    cols = [batch.column(j).take(at) for j in range(batch.num_columns) if j != 1]
                    names = ["rep", *batch.schema.names[2:], "tokens"]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([rows[i].tobytes() for i in good], pa.binary())], names=names)

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class Opened:
    """One chunk of a group: its row of the matrix, its members, and who is linked with whom so far.

    Classes go by the component that they are known to belong to, so those of one component are never compared."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.seen: set = set()
        self.root: dict[int, int] = {}
        self.union: np.ndarray | None = None

    def find(self, x: int) -> int:
        self.root.setdefault(x, x)
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def member(self, component: int, key: tuple, tokens: np.ndarray) -> None:
        if key not in self.seen:
            self.seen.add(key)
            self.ids.append(component)
            self.sets.append(tokens)

    def complete(self, own: bool) -> list[tuple[int, int]]:
        """Called once all members are in: the row of the matrix, and the links among the members if wanted."""
        if self.union is not None:
            return []
        self.union = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.size = np.array([len(s) for s in self.sets])
        return [x for component, tokens in zip(self.ids, self.sets) for x in self.query(component, tokens)] if own and len(self.sets) > 1 else []

    def query(self, component: int, tokens: np.ndarray) -> list[tuple[int, int]]:
        """New links of a query with members that it is not yet connected with."""
        n = len(tokens)
        if self.den * _common(tokens, self.union) < self.num * n:  # not even all of the group together
            return []
        out = []
        for i in np.flatnonzero((self.den * self.size >= self.num * n) & (self.den * n >= self.num * self.size)):
            other = self.ids[i]
            if self.find(component) == self.find(other):
                continue
            both = _common(tokens, self.sets[i])
            if self.den * both >= self.num * (n + self.size[i] - both):
                self.root[self.find(component)] = self.find(other)
                out.append((component, other))
        return out


def _open(num: int, den: int, own: bool):
    """Of rows (g, chunk, copy, kind, component, rep, c, h, tokens) sorted by the first four: links (src, dst). A chunk's rows
    are the components of members that are in another's than their own (kind 0), its members (1), and its queries (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk = None, Opened(num, den)
        known: dict[tuple, int] = {}
        links: list[tuple[int, int]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["src", "dst"])
                links.clear()

        for batch in batches:
            for g, part, copy, kind, component, rep, c, h, tokens in zip(*(x.to_pylist() for x in batch.columns)):
                if now != (g, part, copy):
                    links += chunk.complete(own)
                    now, chunk, known = (g, part, copy), Opened(num, den), {}
                if kind == 0:
                    known[rep, c, h] = component
                elif kind == 1:
                    chunk.member(known.get((rep, c, h), rep), (rep, c, h), np.frombuffer(tokens, np.uint64))
                else:
                    links += chunk.complete(own)
                    links += chunk.query(component, np.frombuffer(tokens, np.uint64))
            yield from out()
        links += chunk.complete(own)
        yield from out()

    return run


#: Bits of the filter that keeps rows without a partner out of a shuffle; it only saves work.
SLOTS = 1 << 20


def _likely(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Rows of which ``keys`` may be in ``wanted``: those whose hash falls on a slot that is taken there. What is broadcast
    is the numbers of the slots, ``SLOTS`` at most."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int").alias("slot")
    return rows.select("*", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi").drop("slot")


def jaccard_components(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", members: int = MEMBERS, asks_each: int = ASKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents link when ``den * |intersection| >= num * |union|`` of their ``k``-word shingles.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    parts = shuffle_partitions(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    first = scratch.table(texts.mapInArrow(lean(_classes(k)), "doc_id long, n long, c long, h long, g long, part int, counts binary"), "first")
    rows = first.where("part is null").select("doc_id", "n", "c", "h", "g")
    sums = first.where("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(lean(_add_up), "part int, counts binary").collect()
    step = WIDTH // PARTS  # WIDTH counters of two bytes, whatever the corpus
    level = np.zeros(WIDTH, np.uint16)
    for r in sums:
        level[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["counts"], np.uint16)
    # where many tokens share each counter, only one far above the others tells a frequent token
    shared = spark.sparkContext.broadcast((level, max(HOT, 8 * float((2 ** (level / 8)).mean()))))

    classes = rows.where("n > 0 and doc_id is not null").groupBy("c", "h", "n", "g").agg(F.min("doc_id").alias("rep"))
    classes = scratch.table(classes, "classes")
    fields = ", ".join(f"{name} long" for name in _TOKENS)
    tokens = texts.where("doc_id is not null").select("text").mapInArrow(lean(_prefixes(k, num, den, shared)), fields)
    tokens = tokens.repartition(parts, "token", "salt").sortWithinPartitions(*_TOKENS).mapInArrow(lean(_shared_tokens(num, den)), _SHARED)
    tokens = scratch.table(tokens, "tokens")
    scratch.free()

    # Which classes can link at all: one that shares enough with some other class, of the tokens whose pairs are listed
    # and of its wide ones; what a class of size n shares in the prefixes with any that it links with is ``fewest``, at least.
    # Others take no further part. So texts that share a few tokens by chance, each with another text, are not opened.
    fewest = F.least(F.floor(F.col("n") * num / den / 100) + common_needed(0), F.ceil(F.col("n") * num / den))
    lack = tokens.where("other is not null").groupBy("c", "other").agg((F.min("early") - F.count("*")).alias("lack"))
    lack = lack.select("c", "lack").union(lack.select("other", "lack")).groupBy("c").agg(F.min("lack").alias("lack"))
    tokens = tokens.where("other is null").select("token", "c", "n", "at", "wide")
    most = tokens.where("wide").groupBy("c", "n").agg(F.count("*").alias("wide"))
    able = most.join(lack, "c", "full").where(F.coalesce("wide", F.lit(0)) >= F.least("lack", fewest)).select("c")
    some = scratch.table(classes.join(able, "c", "left_semi"), "some")
    scratch.free()
    tokens = scratch.table(_likely(tokens, some, "c").join(some.select("c", "n", "g"), ["c", "n"]).select("token", "g", "n", "at", "c"), "kept")
    scratch.drop("tokens")
    groups = some.groupBy("g").agg(F.count("*").alias("classes"), F.min(F.struct("rep", "c", "h")).alias("anchor"))
    groups = scratch.table(groups.withColumn("chunks", F.ceil(F.col("classes") / members).cast("int")), "groups")

    # the first cells: each group with the largest one of every token, so that near copies meet in few places
    of = scratch.table(tokens.groupBy("token", "g").agg(F.min("n").alias("n")).join(groups.select("g", "classes"), "g"), "of-groups")
    hubs = of.groupBy("token").agg(F.max(F.struct("classes", "g")).alias("hub")).select("token", F.col("hub.g").alias("hub"))
    cells = of.join(hubs, "token").where("g <> hub").groupBy("g", "hub").agg(F.count("*").alias("common"), F.min("n").alias("n")).where(F.col("common") >= fewest)
    cells = scratch.table(cells.select(F.col("g").alias("qg"), F.col("hub").alias("g")), "cells")

    # in the first round the hubs and the groups of several classes are opened, and the anchors of some ask
    hosts = cells.select("g", F.lit(True).alias("hosts")).distinct()
    guests = cells.select(F.col("qg").alias("g"), F.lit(True).alias("guests")).distinct()
    facts = groups.join(hosts, "g", "left").join(guests, "g", "left").select(
        "g", "chunks", "anchor", ((F.col("classes") > 1) | F.coalesce("hosts", F.lit(False))).alias("opens"), ((F.col("chunks") > 1) | F.coalesce("guests", F.lit(False))).alias("asks")
    )
    # written, so that the join with the classes of a very large group is one that can be split
    placed = some.join(scratch.table(facts, "facts"), "g").withColumn("chunk", F.pmod("h", "chunks").cast("int"))
    is_anchor = (F.col("rep") == F.col("anchor.rep")) & (F.col("c") == F.col("anchor.c")) & (F.col("h") == F.col("anchor.h"))
    wanted = scratch.table(placed.select("rep", "c", "h", "n", "g", "chunk", "opens", (is_anchor & F.col("asks")).alias("asks")), "wanted")
    named = wanted.withColumnRenamed("rep", "doc_id")
    sets = _likely(texts, named, "doc_id").join(named.hint("merge"), "doc_id").select("doc_id", "text", "c", "h", "g", "chunk", "opens", "asks")
    sets = sets.mapInArrow(lean(_sets(k)), "rep long, c long, h long, g long, chunk int, opens boolean, asks boolean, tokens binary")
    sets = scratch.table(sets, "sets")
    scratch.free()
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    columns = ["g", "chunk", "copy", "kind", "component", "rep", "c", "h", "tokens"]

    def opened(asks: DataFrame, askers: DataFrame, targets: DataFrame, own: bool, name: str, names: DataFrame | None = None) -> DataFrame:
        """Links of ``asks`` (g, chunk, rep, c, h, component), whose tokens are among ``askers``, with the members of
        their chunk among ``targets``, and of these with each other if ``own``. A chunk that many ask is copied, and its
        queries are dealt to the copies. ``names`` (g, chunk, rep, c, h, component): members in another's component."""
        copies = F.ceil(F.col("n") / asks_each).cast("int")
        load = scratch.table(asks.groupBy("g", "chunk").agg(F.count("*").alias("n")).select("g", "chunk", copies.alias("copies")), f"{name}-load")
        busy = load.where("copies > 1")
        many = F.coalesce("copies", F.lit(1))
        of = F.pmod(F.xxhash64("rep", "c", "h"), many).cast("int")
        dealt = asks.join(busy, ["g", "chunk"], "left").select("g", "chunk", of.alias("copy"), F.lit(2).alias("kind"), "rep", "c", "h", "component")

        def copied(rows: DataFrame, kind: int) -> DataFrame:
            each_copy = F.explode(F.sequence(F.lit(0), many - 1))
            return rows.join(busy, ["g", "chunk"], "left").withColumn("copy", each_copy).withColumn("kind", F.lit(kind)).select(*columns)

        both = dealt.join(askers.select("rep", "c", "h", "tokens"), ["rep", "c", "h"]).select(*columns)
        both = both.union(copied(targets.withColumn("component", F.lit(None).cast("long")), 1))
        if names is not None:
            both = both.union(copied(names.withColumn("tokens", F.lit(None).cast("binary")), 0))
        both = both.repartition(parts, "g", "chunk", "copy").sortWithinPartitions("g", "chunk", "copy", "kind", "component", "rep", "c", "h")
        return scratch.table(both.mapInArrow(lean(_open(num, den, own)), "src long, dst long"), name)

    anchor = ["anchor.rep", "anchor.c", "anchor.h", F.col("anchor.rep").alias("component")]
    across = groups.where("chunks > 1").select("g", each.alias("chunk"), *anchor)
    # one chunk of the hub, as this round need not find all
    reach = cells.join(groups.select("g", "chunks"), "g").select("qg", "g", F.pmod(F.xxhash64("qg"), "chunks").cast("int").alias("chunk"))
    far = reach.join(groups.select(F.col("g").alias("qg"), "anchor"), "qg").select("g", "chunk", *anchor)
    links = opened(across.union(far), sets.where("asks"), sets.where("opens"), True, "links-1")
    # one document with several texts pools their links
    same = rows.where("n > 0 and doc_id is not null").join(classes, ["c", "h", "n", "g"]).select("doc_id", "rep")
    links = links.union(same.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").join(same, "doc_id").select("doc_id", "rep"))
    found = connected_components(links, scratch, "cc-1")
    scratch.free()

    # What that has not settled: classes of different components that share enough in the prefixes. The classes of one group,
    # size and component are a unit; units that share enough are a cell. A token's largest component is never paired with
    # itself, so near copies make no pairs here.
    known = scratch.table(wanted.join(found, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")), "known")
    unit = F.struct("g", "n", "component").alias("unit")
    of = tokens.join(known.select("c", "n", "component").distinct(), ["c", "n"]).groupBy("token", unit).agg(F.min("at").alias("at"))
    of = scratch.table(of, "of")
    scratch.free()
    major = of.groupBy("token", F.col("unit.component").alias("of")).count().groupBy("token").agg(F.max(F.struct("count", "of")).alias("m"), F.count("*").alias("several"))
    major = major.where("several > 1").select("token", F.col("m.of").alias("major"))
    of = of.join(major, "token").withColumn("is_major", F.col("unit.component") == F.col("major"))
    of = scratch.table(of.select("token", "unit", "at", "is_major"), "apart")
    a, b = of.where("not is_major").alias("a"), of.alias("b")
    apart = (F.col("a.unit.component") != F.col("b.unit.component")) & (F.col("b.is_major") | (F.col("a.unit") < F.col("b.unit")))
    # by size, and by how many tokens come after the common one: what two sets of these sizes share if they link, and how
    # much of it within the prefixes
    n, m = F.col("a.unit.n"), F.col("b.unit.n")
    fits = (n * den >= m * num) & (m * den >= n * num)
    needed = F.ceil((n + m) * num / (num + den))
    early = F.least(F.floor(F.least(n, m) / 100) + common_needed(0), needed)
    fits &= F.least(n - F.col("a.at"), m - F.col("b.at")) + early - 1 >= needed
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & apart & fits)
    pairs = pairs.select(F.least("a.unit", "b.unit").alias("low"), F.greatest("a.unit", "b.unit").alias("high"), early.alias("early"))
    pairs = pairs.groupBy("low", "high").agg(F.count("*").alias("common"), F.min("early").alias("early")).where("common >= early")
    pairs = scratch.table(pairs.select("low", "high"), "pairs")
    if not pairs.isEmpty():
        # of a cell's two units the smaller one's classes ask the other's chunks, but their own, which is settled
        units = scratch.table(known.groupBy(unit).agg(F.count("*").alias("classes")), "units")
        sides = pairs.join(units.select(F.col("unit").alias("low"), F.col("classes").alias("few")), "low").join(units.select(F.col("unit").alias("high"), F.col("classes").alias("many")), "high")
        swap = F.col("few") > F.col("many")
        sides = scratch.table(sides.select(F.when(swap, F.col("high")).otherwise(F.col("low")).alias("guest"), F.when(swap, F.col("low")).otherwise(F.col("high")).alias("host")), "sides")
        class_ = known.select(unit, "g", "chunk", "rep", "c", "h", "component")
        guests = class_.select(F.col("unit").alias("guest"), F.col("chunk").alias("from"), "rep", "c", "h", "component")
        hosts = class_.select(F.col("unit").alias("host"), "g", "chunk").distinct()
        cells = sides.join(hosts, "host").join(guests, "guest").where("guest.g <> g or `from` <> chunk")
        cells = scratch.table(cells.select("host", "g", "chunk", "rep", "c", "h", "component"), "cells-2")
        asks = scratch.table(cells.drop("host").distinct(), "asks")
        if not asks.isEmpty():
            asked = cells.select(F.col("host").alias("unit"), "chunk").distinct()
            held = scratch.table(class_.join(asked, ["unit", "chunk"], "left_semi").select("g", "chunk", "rep", "c", "h", "component"), "held")
            targets = _likely(sets, held, "rep", "c", "h").join(held, ["rep", "c", "h"], "left_semi")
            names = held.where("component <> rep")
            more = opened(asks, _likely(sets, asks, "rep", "c", "h"), targets, False, "links-2", names)
            links = more.union(found.select(F.col("node").alias("src"), F.col("component").alias("dst")))
            found = connected_components(links, scratch, "cc-2")
    # the result reads the documents' classes and the components alone
    loads = [f"links-{i}{x}" for i in (1, 2) for x in ("", "-load")]
    scratch.drop("some", "groups", "kept", "of-groups", "cells", "facts", "wanted", "sets", "known", "of", "apart", "pairs", "units", "sides", "cells-2", "asks", "held", *loads)

    whole = classes.join(found, F.col("rep") == F.col("node"), "left").select("c", "h", F.col("n"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(whole, ["c", "h", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, *, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: those of its smallest id."""
    found = jaccard_components(docs, k=k, num=num, den=den, id_col=id_col, text_col=text_col)
    others = found.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    return whole(docs, id=F.col(id_col).cast("long")).join(others, "id", "left_anti").select("doc.*")
