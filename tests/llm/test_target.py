"""Importance resampling, source divergence and decontamination against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftspark.llm import decontamination, divergence, importance

AZ = str.maketrans({c: c + 32 for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def some_docs(seed=0, n=60):
    """Few words, so that much repeats; odd texts, repeated rows and ids, nulls."""
    rng = random.Random(seed)
    pick = ["the", "sea", "Déjà", "vu", "x1", "Ünder", "a", "is"]
    rows = [(i, " ".join(rng.choices(pick, k=rng.choice([0, 1, 2, 3, 9, 25, 60]))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for i in range(n)]
    rows += [(100, None, "en", "a"), (101, "", "xx", "a"), (102, " \n 1 ", "xx", "b"), (None, "the sea " * 15, "en", "b"), (7, *rows[7][1:]), (7, "the the sea", "en", "a")]
    return [*rows, (103, "W" * 3000 + " sea " * 4000, "en", "d")]


def table(spark, rows):
    df = spark.createDataFrame([(*r, 9, "own") for r in rows], "doc_id long, text string, lang string, source string, h int, w string").repartition(3)
    return df.withColumns({c: F.lit("own") for c in ("key", "id0", "n", "sketch", "grams", "found", "gid", "tid", "term", "weight", "score", "tie", "a b.c`d")})


# --- importance -----------------------------------------------------------------------------------


def features(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(x):
    return zlib.crc32(x.encode()) % 10_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\nA1-", max_size=30)), max_size=8), st.integers(1, 9))
def test_buckets_of_runs(texts, most):
    arr, want = pa.array(texts, pa.string()), Counter()
    gains = np.arange(importance.BUCKETS, dtype=np.int64) * 7 - 1000
    found = importance.Words(arr)
    got = Counter()
    for first, last, runs in importance.blocks_of_runs(found, most):
        for b, begin, order in runs:
            assert sorted(order) == list(range(last - first))
            for x, k in zip(b.tolist(), np.diff(np.append(begin, last - first)).tolist()):
                if x >= 0:
                    got[x] += k
    for t in texts:
        want.update(map(bucket, features(t)))
    assert got == want
    n, weight = importance.weigh(arr, gains)
    assert n.tolist() == [len(words(t)) for t in texts]
    assert weight.tolist() == [sum(int(gains[bucket(x)]) for x in features(t)) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 9, 300])
def test_shift_table(n):
    a, b = b"some", b"x" * n
    table = importance.shift_table(n)
    crc = zlib.crc32(a)
    shifted = table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]
    assert int(shifted) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_importance(spark):
    rows, target = some_docs(), [(0, "the sea is a sea", "", ""), (1, None, "", ""), (2, "Déjà vu", "", "")]
    got = importance.importance_resampling(table(spark, rows), table(spark, target), percent=20, least_words=3)
    s, t = Counter(), Counter()
    for r in rows:
        s.update(map(bucket, features(r[1])))
    for r in target:
        t.update(map(bucket, features(r[1])))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    want = []
    for i, text, *_ in rows:
        f = features(text)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in want if r[1] >= 3), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = 20 * len(able) // 100
    ranks = Counter((*map(str, r), str(k + 1) if k < drawn else "None") for k, r in enumerate(able))
    ranks += Counter((*map(str, r), "None") for r in want if r[1] < 3)
    assert Counter(tuple(map(str, r)) for r in got.collect()) == ranks
    assert drawn > 5


def test_importance_of_nothing(spark):
    rows = table(spark, some_docs(n=8))
    none = rows.where("false")
    assert importance.importance_resampling(none, rows).count() == 0
    got = importance.importance_resampling(rows, none, percent=100, least_words=1).collect()
    assert sorted(r["rank"] for r in got if r["n_words"]) == list(range(1, 1 + sum(r["n_words"] > 0 for r in got)))


# --- divergence -----------------------------------------------------------------------------------


def plain_divergence(rows, least, smoothing, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(AZ))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df, all_n, by = Counter(), Counter(), defaultdict(Counter)
        for _, source, w in own:
            df.update(set(w))
            all_n.update(w)
            by[source].update(w)
        kept = [t for t in df if df[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + smoothing) // (sum(c[t] for t in kept) + smoothing * len(kept)) for t in kept}
        q, p = share(all_n), {s: share(c) for s, c in by.items()}
        apart = lambda a, b: (a - b) ** 2 // b
        for s in by:
            pairs = [(o, sum(apart(p[s][t], p[o][t]) for t in kept)) for o in by if o != s]
            terms = [(t, apart(p[s][t], q[t])) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, 10**9), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ordered)]
    return out


@pytest.mark.parametrize("least,smoothing,top", [(3, 1, 200), (1, 2, 2), (1000, 1, 5)])
def test_divergence(spark, least, smoothing, top):
    rows = some_docs(1)
    got = divergence.source_divergence(table(spark, rows), least_docs=least, smoothing=smoothing, top=top)
    assert Counter(map(tuple, got.collect())) == Counter(plain_divergence(rows, least, smoothing, top))


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(table(spark, some_docs(n=8)).where("false")).count() == 0
    alone = divergence.source_divergence(table(spark, [(1, "one one", "en", "a")]), least_docs=1).collect()
    assert alone == []  # no other source, and no term above its own language


# --- decontamination ------------------------------------------------------------------------------


def plain_decontamination(rows, items, span):
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, tuple(w[i : i + span])) for i in range(max(1, len(w) - span + 1))] if w else []
    out = []
    for i, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for item, x in set(windows):
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit |= {*range(a, a + len(x))}
                    found |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return out


@pytest.mark.parametrize("gram,span", [(5, 10), (2, 4), (3, 3), (1, 1)])
def test_decontamination(spark, gram, span):
    rng = random.Random(span)
    vocabulary = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(rng.choice([3, 9, 10, 11, 25]))) for i in range(12)]
    items += [(12, items[3][1]), (3, say(14)), (13, None), (14, "..."), (15, "w1 W2"), (None, "w5 w6 w7"), (16, "é " * 12), (17, " ".join(items[4][1].split()[2:]) + " end")]
    rows = [(i, say(10) + " " + rng.choice(items[:12])[1].upper() + "! " + say(4) + "\n" + items[i % 12][1]) for i in range(20)]
    rows += [(30, None), (31, ""), (32, items[4][1]), (None, items[4][1]), (33, "é " * 40), (34, say(300)), (32, items[4][1]), (32, "w5"), (35, items[0][1] + " " + say(30_000))]
    benchmark = spark.createDataFrame([(*x, "own") for x in items], "item_id long, text string, w string")
    docs = table(spark, [(*r, "en", "a") for r in rows])
    got = decontamination.decontamination(docs, benchmark, gram=gram, span=span)
    found = got.collect()
    keys = ("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated")
    assert Counter(tuple(r[k] for k in keys) for r in found) == Counter(plain_decontamination(rows, items, span))
    for r in found:
        ends = [0, *(x for s in r["spans"] for x in (s["start"], s["end"]))]
        assert ends == sorted(ends) and sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
    assert any(r["n_hit"] for r in found) and any(not r["n_hit"] for r in found)


def test_decontamination_of_nothing(spark):
    docs, benchmark = table(spark, some_docs(n=8)), spark.createDataFrame([(1, "the sea")], "item_id long, text string")
    assert decontamination.decontamination(docs.where("false"), benchmark).count() == 0
    got = decontamination.decontamination(docs, benchmark.where("false")).collect()
    assert len(got) == docs.count() and not any(r["contaminated"] or r["n_hit"] or r["n_items"] or r["spans"] for r in got)
    with pytest.raises(ValueError):
        decontamination.decontamination(docs, benchmark, gram=6, span=5)


def test_a_small_sketch_changes_nothing(spark):
    docs = table(spark, some_docs(3))
    benchmark = spark.createDataFrame([(i, r[1]) for i, r in enumerate(some_docs(3)) if i % 9 == 0], "item_id long, text string")
    one = sorted(map(str, decontamination.decontamination(docs, benchmark, most_sketch=1).collect()))
    assert one == sorted(map(str, decontamination.decontamination(docs, benchmark).collect()))


def test_bytes_that_are_no_text(spark):
    """Each is a letter, and nothing fails."""
    rows = [(1, "C3"), (2, "6120C3280A6220FF"), (3, "61"), (4, "C3"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, hex string").select("doc_id", F.unhex("hex").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    benchmark = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert {r["doc_id"]: r["n_words"] for r in importance.importance_resampling(docs, benchmark).collect()} == {1: 1, 2: 4, 3: 1, 4: 1, 5: 0}
    assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.decontamination(docs, benchmark).collect()} == {1: (1, 0), 2: (4, 1), 3: (1, 1), 4: (1, 0), 5: (0, 0)}
    assert divergence.source_divergence(docs, least_docs=1).count() == 0
