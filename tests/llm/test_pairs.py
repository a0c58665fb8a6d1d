"""Operators that compare documents or vectors, against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftspark.llm import embedding_dedup, exact_dedup, jaccard_join
from siftspark.llm.common import Scratch
from siftspark.llm.components import connected_components
from siftspark.llm.hnsw import Graph

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def table(spark, rows):
    """Documents with clashing extra columns."""
    full = [(i, t, "x", 1, "g", 0) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, token string, n int, g string, part int").repartition(3)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 8, 60, 300]))) for _ in range(n // 3)]
    passage = " ".join(rng.choices(words, k=60))
    rows = list(base)
    for _ in range(n):
        parts = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append(rng.choice(["", "", passage + " "]) + " ".join(parts).upper().lower())
    return list(enumerate(rows)) + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One Two"), (1004, "one  two"), (1005, "one two three")]


def shingles(text, k):
    w = [x for x in SPACE.split((text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "num", "members"), [(3, 90, 256), (5, 80, 2), (2, 50, 3)])
def test_jaccard(spark, k, num, members):
    rows = texts(k)
    sets = {i: shingles(t, k) for i, t in rows}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = roots(sets, edges)
    got = jaccard_join.jaccard_components(table(spark, rows), k=k, num=num, members=members).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_hot(spark, monkeypatch):
    """Every token dealt to several parts, chunks of two classes, copies of one query each, and classes forgotten at once."""
    monkeypatch.setattr(jaccard_join, "HOT", 1)
    monkeypatch.setattr(jaccard_join, "KNOWN", 1)
    rows = texts(11, 40)
    sets = {i: shingles(t, 3) for i, t in rows}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])])
    got = jaccard_join.jaccard_components(table(spark, rows), k=3, num=70, members=2, asks_each=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_jaccard_large_group(spark):
    """Near copies in more chunks than one, chained so that no document is near all others."""
    words = [f"v{i}" for i in range(300)]
    rows = [(i, " ".join([*words[3 * i :], *(f"x{j}" for j in range(3 * i))])) for i in range(30)]
    got = jaccard_join.jaccard_components(table(spark, rows), k=1, num=90, members=4).collect()
    sets = {i: shingles(t, 1) for i, t in rows}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])])
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def counted(monkeypatch):
    """Rows of each table that the join writes."""
    rows = {}

    class Counting(Scratch):
        def table(self, df, name):
            out = super().table(df, name)
            rows[name] = out.count()
            return out

    monkeypatch.setattr(jaccard_join, "Scratch", Counting)
    return rows


def test_jaccard_chance_opens_nothing(spark, monkeypatch):
    """Each word of a text is in one other text, and any two texts share one: only the two near copies' sets are made."""
    words = {i: [f"p{min(i, j)}q{max(i, j)}" for j in range(61) if j != i] for i in range(61)}
    rows = [(i, " ".join(w)) for i, w in words.items()] + [(99, " ".join([*words[7][:-1], "other"]))]
    written = counted(monkeypatch)
    got = jaccard_join.jaccard_components(table(spark, rows), k=1, num=90).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 7 if i == 99 else i for i, _ in rows}
    assert written["sets"] == 2


def test_jaccard_chunks_are_asked_by_what_they_share(spark, monkeypatch):
    """Pairs of texts that share a half and do not link, all in one group of many chunks: a text asks its partner's chunk only."""
    monkeypatch.setattr(jaccard_join, "_group", lambda tokens: 7)
    rows = [(2 * i + j, " ".join([*(f"s{i}x{w}" for w in range(30)), *(f"o{j}x{w}" for w in range(30 + 2 * i + j))])) for i in range(20) for j in (0, 1)]
    rows.append((99, rows[5][1] + " more"))
    written = counted(monkeypatch)
    got = jaccard_join.jaccard_components(table(spark, rows), k=1, num=90, members=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 5 if i == 99 else i for i, _ in rows}
    assert written["asks"] <= 22 and written["held"] <= 22


@pytest.mark.parametrize(("run", "met"), [(128, 8), (3, 8), (128, 1)])
def test_jaccard_listed_pairs(monkeypatch, run, met):
    """No two rows of a token that may link are lost, whether their pair is listed or both are wide, in batches of any size."""
    monkeypatch.setattr(jaccard_join, "RUN", run)
    monkeypatch.setattr(jaccard_join, "MET", met)
    rng = random.Random(3)
    rows = []
    for token in range(40):
        for c in rng.sample(range(50), rng.choice([1, 2, 3, 9])):
            n = 20 + c // 3
            rows += [(0, token, (n << 31) + rng.randrange(5), c)] * rng.choice([1, 1, 2])
    rows.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 7])], names=jaccard_join._TOKENS) for i in range(0, len(rows), 7)]
    got = [r for b in jaccard_join._shared_tokens(90, 100)(iter(batches)) for r in b.to_pylist()]
    wide = {(r["token"], r["c"]) for r in got if r["wide"]}
    kept = {(r["token"], r["c"]) for r in got if r["other"] is None}
    listed, want = [(r["c"], r["other"]) for r in got if r["other"] is not None], []
    for _, ta, pa_, a in sorted(set(rows)):
        for _, tb, pb, b in sorted(set(rows)):
            (na, at_a), (nb, at_b) = divmod(pa_, 1 << 31), divmod(pb, 1 << 31)
            needed, early = jaccard_join.early_needed(na, nb, 90, 100)
            if ta == tb and a < b and 100 * na >= 90 * nb and min(na - at_a, nb - at_b) + early - 1 >= needed:
                assert {(ta, a), (ta, b)} <= kept
                if not {(ta, a), (ta, b)} <= wide:
                    want.append((a, b))
    assert want and all(a < b for a, b in listed) and not set(want) - set(listed)
    assert all(listed.count(x) >= want.count(x) for x in set(want)) and bool(wide) == ((run, met) != (128, 8))


def test_jaccard_odd_tables(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (3, "a b c d"), (5, "e f g h"), (9, "e f g h"), (5, "a b c d")]
    got = jaccard_join.jaccard_components(table(spark, rows), k=3, num=90)
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got.collect()) == [("3", 3), ("5", 3), ("5", 3), ("5", 3), ("9", 3), ("None", None)]
    assert jaccard_join.jaccard_components(table(spark, rows).where("false"), k=3).count() == 0
    kept = jaccard_join.drop_near_copies(table(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (3, None)]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.columns == table(spark, rows).columns


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = roots({x for e in edges if None not in e for x in e}, [e for e in edges if None not in e])
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    assert {n: got.get(n, n) for n in want} == want
    assert connected_components(df.where("false"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("content", ["xxhash64({0})", "cast(0 as bigint)"])
def test_exact(spark, content):
    rows = [(5, "a b"), (2, "a\t \nb"), (9, "a b "), (3, None), (4, ""), (1, " a b"), (7, "é" * 50), (8, "é" * 50), (6, "ab"), (2, "a b"), (None, "a b"), (None, "zz"), (11, "x" * 300_000)]
    norm = {i: SPACE.sub(" ", t or "") for i, (_, t) in enumerate(rows)}
    got = exact_dedup.exact_dedup(table(spark, rows), content_hash=content, budget=2000).collect()
    want = []
    for i, (doc_id, _) in enumerate(rows):
        group = [rows[j][0] for j in norm if norm[j] == norm[i]]
        keep = min((x for x in group if x is not None), default=None)
        want.append((doc_id, keep, len(group), doc_id == keep, hashlib.sha256(norm[i].encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert exact_dedup.exact_dedup(table(spark, rows).where("false")).count() == 0


def test_drop_copies(spark):
    rows = [(5, "a b"), (2, "a  b"), (2, "a b"), (3, None), (4, ""), (9, "c")]
    kept = exact_dedup.drop_copies(table(spark, rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 9] and kept.columns == table(spark, rows).columns


@pytest.mark.parametrize("budget", [1 << 30, 1500, 1])
def test_trie(budget):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(400):
        text = bytes(rng.choices(b"ab", k=rng.randrange(0, 12))) * rng.randrange(1, 3)
        rows.append((text, i * 7 % 400, 1))
        low, n = want.get(text, (1 << 60, 0))
        want[text] = (min(low, i * 7 % 400), n + 1)
    got, turns = [], 0
    while rows:  # as the rounds of owners: what a trie puts out meets in the next one
        trie, turns = exact_dedup.PatriciaTrie(budget), turns + 1
        rows = [out for row in rows for out in trie.add(*row)]
        held = list(trie.items())
        assert held and not {t for t, *_ in held} & {t for t, *_ in rows}
        assert len(held) == 1 or trie.size <= max(budget, 400)
        got += held
    assert len(got) == len(want) and {t: (o, n) for t, o, n in got} == want
    assert (turns > 3) == (budget < 1 << 30)


def test_trie_shares_edges():
    """Texts of one beginning hold it once, and the budget counts it once."""
    head = b"the same beginning " * 200
    trie = exact_dedup.PatriciaTrie()
    for i in range(50):
        assert not list(trie.add(head + b"%d" % i, i))
    assert list(trie.root[1]) == [head[0]] and trie.root[1][head[0]][0] == head
    assert len(head) < trie.size < 2 * len(head) + 50 * 400 and len(list(trie.items())) == 50


def vectors(seed=0, n=120, d=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n // 2, 3):
        x[i + 1] = x[i] + rng.normal(size=d) * 0.1
    x[50:70] = x[50] + rng.normal(size=(20, d)) * 0.02
    x[71] = x[70]
    x[72] = 2 * x[70]
    return x


def test_graph_recall():
    x = vectors(4, 900)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, m = Graph(x).within(x, 0.9, 16)
    want = set(zip(*(a.tolist() for a in np.nonzero(x @ x.T >= 0.9))))
    assert len(want & set(zip(q.tolist(), m.tolist()))) >= 0.99 * len(want)


def test_audits_see_every_lost_link(monkeypatch):
    """A graph that loses links between different vectors below a wide beam: of its own, and of foreign vectors only."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(700, 16))
    for i in range(4):
        x[2 * i + 1] = x[2 * i] + rng.normal(size=16) * 0.02
    far = rng.normal(size=(520, 16))
    far[:5] = x[100:105] + rng.normal(size=(5, 16)) * 0.02
    blank = [(np.arange(2 * len(v)).reshape(-1, 2).tobytes(), np.ones(len(v), np.int64).tobytes(), v.tobytes()) for v in (x, far)]
    own = x / np.linalg.norm(x, axis=1, keepdims=True)

    def losing(least_beam, foreign_only):
        def within(self, q, least, beam):
            sims = q @ own.T
            i, j = np.nonzero(sims >= least)
            itself, known = sims[i, j] > 1 - 1e-9, (np.abs(sims).max(1) > 1 - 1e-9)[i]
            keep = itself | (beam >= least_beam) | (known & foreign_only)
            return i[keep], j[keep]

        return within

    monkeypatch.setattr(Graph, "within", losing(128, False))
    shard = embedding_dedup._Shard(blank[:1], 16, 0.9)
    shard.own()
    assert shard.beam == 128 and shard.linked.sum() == 8
    monkeypatch.setattr(Graph, "within", losing(128, True))
    shard = embedding_dedup._Shard(blank[:1], 16, 0.9)
    shard.own()
    ids = np.arange(1040).reshape(-1, 2)
    links = shard.query(ids, np.ones(520, np.int64), far)[0]
    assert links.sum() == 5 and shard.beam == 128
    monkeypatch.setattr(Graph, "within", losing(1 << 20, False))
    shard = embedding_dedup._Shard(blank[:1], 16, 0.9)
    assert shard.beam >= 700 and shard.query(ids, np.ones(520, np.int64), far)[0].sum() == 5


@pytest.mark.parametrize("shards", [1, 4, 5])
def test_embeddings(spark, shards):
    x = vectors()
    rows = [(int(i), v.tolist(), 0, "c") for i, v in enumerate(x)]
    odd = [(500, None, 0, "c"), (501, [0.0] * 8, 0, "c"), (502, [1.0, None] + [0.0] * 6, 0, "c"), (503, [float("nan")] * 8, 0, "c"), (504, [], 0, "c"), (505, [1.0, 2.0], 0, "c"), (506, [2.0, 4.0], 0, "c"), (None, x[0].tolist(), 0, "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, dim int, rep string").repartition(3)
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.embedding_dedup(df, shards=shards).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    want = roots(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(link)) if a < b])
    for i in range(len(x)):
        assert got[i] == (int(link[i].sum()), want[i], want[i] == i)
    assert all(got[i] == (0, i, True) for i in range(500, 505)) and got[505] == (1, 505, True) and got[506] == (1, 505, False)
    assert got[None][0] == 0 and got[None][1] is None
    assert embedding_dedup.embedding_dedup(df.where("false")).count() == 0
    assert df.select(F.count("*")).first()[0] == len(got)
