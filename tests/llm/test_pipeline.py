"""The pipeline: every stage against a plain version of it over what the stage before kept."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from siftspark.llm import packing, toxicity
from siftspark.llm.queries import tokenizer_file

from .test_pairs import SPACE, roots, shingles
from .test_texts import plain_targets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(240):
        kind = i % 8
        if kind == 1 and i > 8:
            text = rows[rng.randrange(len(rows))][1].replace(" ", "  ", 1)
        elif kind == 2 and i > 8:
            parts = rows[rng.randrange(len(rows))][1].split(" ")
            parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        else:
            text = " ".join(rng.choices(words, k=rng.choice([4, 30, 120])))
        if kind == 5:
            text += " " + rng.choice(["grobbler", "grobblish", "splunkest"])
        rows.append((i, text, "en", rng.choice(["a", "a", "b", None]), len(text)))
        labels.append((i, 1, int("grobbl" in text or "splunk" in text)))
    rows += [(500, None, None, "b", 0), (501, "", "en", "a", 0)]
    root = f"file://{tmp_path_factory.mktemp('corpus')}"
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root, {i: t for i, t, *_ in rows}, {i for i, _, y in labels if y}


def test_stages(spark, corpus, tmp_path):
    root, texts, toxic = corpus
    docs, kept = spark.read.parquet(f"{root}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, root)
        out.write.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        kept.append([r.asDict() for r in docs.collect()])
    ids = [[r["doc_id"] for r in rows] for rows in kept]

    machine = toxicity.train(spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.read.parquet(f"{root}/documents.parquet"), machine).collect()}
    assert Counter(ids[0]) == Counter(i for i in texts if scores[i] < toxicity.CUT)
    assert not set(ids[0]) & toxic and set(texts) - toxic == set(ids[0])

    groups: dict[str, int] = {}
    for i in sorted(ids[0]):
        groups.setdefault(SPACE.sub(" ", texts[i] or ""), i)
    assert Counter(ids[1]) == Counter(groups.values())

    sets = {i: shingles(texts[i], 5) for i in ids[1]}
    near = roots(sets, [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert Counter(ids[2]) == Counter(set(near.values())) and len(ids[2]) < len(ids[1]) < len(ids[0]) < len(texts)

    size = lambda i: len([w for w in SPACE.split(texts[i] or "") if w])
    source = {r["doc_id"]: r["source"] for r in kept[2]}
    have, took = Counter(), Counter()
    for i in ids[2]:
        have[source[i]] += size(i)
    for i in ids[3]:
        took[source[i]] += size(i)
    target = plain_targets(list(have.items()))
    assert set(ids[3]) <= set(ids[2]) and max(Counter(ids[3]).values()) <= 2
    assert all(abs(took[s] - target[s]) <= 130 for s in have)

    encode = packing.word_tokenizer(tokenizer_file())
    want, bins = Counter(), defaultdict(list)
    for i in ids[3]:
        want[i] += len(encode(texts[i] or "")) // 4 + 1
    got = Counter()
    for r in kept[4]:
        got[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(bins) <= -(-sum(want.values()) // packing.CAPACITY) + 1

    whole = corpus_pipeline.run(spark, root)
    fields = ["doc_id", "piece", "length", "ids_crc32"]
    assert Counter(tuple(r) for r in whole.select(*fields).collect()) == Counter(tuple(r[f] for f in fields) for r in kept[4])


def test_empty_corpus(spark, corpus, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([], COLUMNS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    assert corpus_pipeline.run(spark, root).count() == 0
