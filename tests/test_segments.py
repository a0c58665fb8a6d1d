"""The index that is kept up to date against one that is built anew."""

from __future__ import annotations

import random
import threading

import pytest

from siftspark.operators.lexical import build_index, match, phrase_table, stemmed
from siftspark.operators.segments import SegmentedIndex
from siftspark.sources.commits import CommitConflict

FIELDS = ["subject", "body"]
ASKED = {1: [["run"]], 2: [["boat"], ["sea"]], 3: [["the", "sea"]], 4: [["none"]]}


def rows(spark, docs):
    return spark.createDataFrame([(i, *t) for i, t in docs.items()], "id string, subject string, body string")


def found(spark, index):
    got = match(index, phrase_table(spark, ASKED), {"subject": 5, "body": 1}).collect()
    return {(r["query_id"], r["id"]): round(r["score"], 9) for r in got}


def text(rng):
    words = "run runs running boat boats sea the of".split()
    return rng.choice(words) if rng.random() < 0.5 else None, " ".join(rng.choices(words, k=rng.randrange(0, 8)))


@pytest.mark.parametrize("porter", [False, True])
def test_upkeep_equals_a_new_index(spark, tmp_path, porter):
    rng = random.Random(porter)
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", FIELDS, porter)
    assert found(spark, index.read()) == {}
    docs, written = {}, 0
    for step in range(7):
        if step in (2, 5):
            gone = rng.sample(sorted(docs), 4)
            index.delete(spark.createDataFrame([(i,) for i in [*gone, "unknown"]], "id string"))
            docs = {i: t for i, t in docs.items() if i not in gone}
        else:
            # new rows, changed ones, and ones that had been deleted
            new = {f"m{rng.randrange(40)}": text(rng) for _ in range(20 if step == 0 else 6)}
            index.upsert(rows(spark, new))
            docs |= new
        written = max(written, len(index.segments()))
        if step in (1, 2, 4, 6):
            fresh = build_index(rows(spark, docs), FIELDS)
            assert found(spark, index.read()) == pytest.approx(found(spark, stemmed(fresh) if porter else fresh))
    assert 1 < written <= 4
    stats = index.read().stats
    held = index.read().lengths.collect()
    assert stats == (len(docs), sum(r["dl"] for r in held)) and {r["id"] for r in held} == set(docs)
    index.vacuum(1, grace=0)
    assert len(list((tmp_path / "i").glob("s-*"))) == len(index.segments()) and found(spark, index.read())


def test_refresh_writes_changes_only(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", FIELDS)
    docs = {f"m{i}": (f"boat {i}", "the sea") for i in range(9)}
    assert index.refresh(rows(spark, docs)) == {"indexed": 9, "deleted": 0}
    assert index.refresh(rows(spark, docs)) == {"indexed": 0, "deleted": 0} and len(index.segments()) == 1
    docs["m3"] = ("boat 3", None)
    del docs["m4"]
    assert index.refresh(rows(spark, docs)) == {"indexed": 1, "deleted": 1}
    assert [s["held"] for s in index.segments()] == [9, 1, 0]
    assert found(spark, index.read()) == pytest.approx(found(spark, build_index(rows(spark, docs), FIELDS)))


def test_writers_of_an_index_that_meet(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/i", FIELDS)
    index.upsert(rows(spark, {"m0": ("boat", "sea")}))
    failed = []

    def write(i):
        try:
            index.upsert(rows(spark, {"m0": ("boat", f"sea {i}"), f"n{i}": ("boat", "the sea")}))
        except CommitConflict as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and index.read().stats[0] == 4 and {r["id"] for r in index.read().lengths.collect()} == {"m0", "n0", "n1", "n2"}
