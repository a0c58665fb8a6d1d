"""Leases and the run log in shared storage, for two sessions of the same folder."""

from __future__ import annotations

import pytest

from siftspark.sources import schemas, tables
from siftspark.streaming.increment import LockHeld, run_phases
from siftspark.streaming.lease import SharedRunLog, clear, lease


def test_one_holder_at_a_time(spark, tmp_path):
    root, other = f"file://{tmp_path}/l", spark.newSession()
    with lease(spark, root, "backfill", now=1000.0) as held:
        held.check()
        with pytest.raises(LockHeld, match="backfill, token 1"):
            with lease(other, root, "merge", now=1001.0):
                pass
        with pytest.raises(LockHeld, match="more than 4 h"):
            with lease(other, root, "merge", now=1000.0 + 4 * 3600 + 1):
                pass
    with lease(other, root, "merge") as held:
        assert held.token == 3
    with pytest.raises(ValueError):
        with lease(spark, root, " "):
            pass
    with pytest.raises(ZeroDivisionError):
        with lease(spark, root, "fails"):
            raise ZeroDivisionError
    with lease(spark, root, "after a failure"):
        pass


def test_a_stopped_archive_gives_no_lease(spark, tmp_path):
    root = f"file://{tmp_path}/l"
    with lease(spark, root, "daily") as held:
        tables.write_text(spark, f"{root}/ACTION_REQUIRED", "the disk is full")
        with pytest.raises(LockHeld, match="ACTION_REQUIRED"):
            held.check()
    with pytest.raises(LockHeld, match="ACTION_REQUIRED"):
        with lease(spark, root, "daily"):
            pass
    (tmp_path / "l" / "ACTION_REQUIRED").unlink()
    with lease(spark, root, "daily"):
        pass


def test_a_holder_taken_for_dead_writes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/l"
    rows = lambda x: spark.createDataFrame([("m", [x])], schemas.VECTORS)
    with lease(spark, root, "slow") as held:
        slow = tables.VersionedTable(spark, f"file://{tmp_path}/t", schemas.VECTORS, guard=held.check)
        slow.upsert(rows(1.0), ["message_id"])
        assert clear(spark, root) and not clear(spark, root)
        with lease(spark, root, "next") as new:
            tables.VersionedTable(spark, f"file://{tmp_path}/t", schemas.VECTORS, guard=new.check).upsert(rows(2.0), ["message_id"])
            with pytest.raises(LockHeld):
                slow.upsert(rows(3.0), ["message_id"])
            with pytest.raises(LockHeld):
                slow.overwrite(rows(3.0))
        assert [r["embedding"] for r in slow.read().collect()] == [[2.0]]


def test_shared_run_log(spark, tmp_path):
    root, ran = f"file://{tmp_path}/log", []
    phases = [("a", lambda: ran.append("a"), True), ("b", lambda: ran.append("b") if len(ran) > 1 else 1 / 0, True)]
    assert run_phases(SharedRunLog(spark, root), phases, now=1000.0)["b"].startswith("failed")
    ran.append("mended")
    # another session goes on where that one stopped
    assert run_phases(SharedRunLog(spark.newSession(), root), phases, now=1100.0) == {"a": "skipped", "b": "done"}
    assert ran == ["a", "mended", "b"] and not SharedRunLog(spark, root).due(now=1101.0)


def _scanned(df) -> int:
    """Rows that the scans of a plan gave after what they skipped."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        name = plan.nodeName()
        if name.startswith("Scan parquet"):
            total += plan.metrics().apply("numOutputRows").value()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(plan.executedPlan())
        elif "QueryStage" in name:
            todo.append(plan.plan())
        else:
            children = plan.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_lookup_reads_as_much_of_a_large_table_as_of_a_small_one(spark, tmp_path):
    read = []
    for n in (20_000, 80_000):
        t = tables.VersionedTable(spark, f"file://{tmp_path}/t{n}", schemas.VECTORS)
        spark.conf.set("parquet.block.size", "65536")
        rows = spark.range(n).selectExpr("concat('m', lpad(id, 7, '0')) AS message_id", "array(cast(rand(1) AS float), cast(rand(2) AS float), cast(rand(3) AS float)) AS embedding")
        try:
            t.overwrite(rows, ["message_id"])
            t.upsert(spark.createDataFrame([("m0000005", [9.0, 9.0, 9.0]), ("m9", [8.0, 8.0, 8.0])], schemas.VECTORS), ["message_id"])
        finally:
            spark.conf.unset("parquet.block.size")
        found = t.lookup("message_id", ["m0000005", "m9", "none"])
        assert {r["message_id"]: r["embedding"][0] for r in found.collect()} == {"m0000005": 9.0, "m9": 8.0}
        read.append(_scanned(t.lookup("message_id", ["m0000005"])))
        assert read[-1] < n / 3
    assert read[1] <= 1.5 * read[0]


def test_a_read_only_session_writes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("m", [1.0])], schemas.VECTORS)
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t", schemas.VECTORS)
    t.upsert(rows, ["message_id"])
    before = sorted(p.name for p in (tmp_path / "t").rglob("*"))
    spark.conf.set("siftspark.readOnly", "true")
    try:
        assert t.read().count() == 1 and tables.read(spark, f"file://{tmp_path}/t", schemas.VECTORS).count() == 1
        for write in (lambda: t.upsert(rows, ["message_id"]), lambda: t.overwrite(rows), lambda: tables.writable(spark, f"file://{tmp_path}/t", schemas.VECTORS), lambda: tables.write_text(spark, f"file://{tmp_path}/x", "x")):
            with pytest.raises(PermissionError):
                write()
        with pytest.raises(PermissionError):
            with lease(spark, f"file://{tmp_path}/l", "x"):
                pass
    finally:
        spark.conf.unset("siftspark.readOnly")
    assert sorted(p.name for p in (tmp_path / "t").rglob("*")) == before


def test_chunks_by_the_row_of_a_vector(spark):
    from siftspark.plans.retrieve import first_chunks

    chunks = spark.createDataFrame([("c2", None, "m1"), ("c1", None, "m1"), ("c5", 7, None), ("c4", 7, None), ("", 8, None), ("c9", 1, "m1")], "chunk_id string, vec_rowid long, message_id string")
    rowids = spark.createDataFrame([("m1", 7), ("m2", 7), ("m3", 8), ("m4", None)], "id string, vec_rowid long")
    assert {r["id"]: r["chunk_id"] for r in first_chunks(chunks, rowids).collect()} == {"m1": "c1", "m2": "c4"}
    assert {r["id"]: r["chunk_id"] for r in first_chunks(chunks).collect()} == {"m1": "c1"}
