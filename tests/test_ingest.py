"""Incremental embedding, merging, tables and the run log."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from siftspark.functions.text import sha256
from siftspark.operators import ingest
from siftspark.sources import schemas, services, tables
from siftspark.streaming import increment

NOW = "2026-09-06T15:00:00Z"


def archive(spark):
    base = {"subject": "Hello", "lane": "inbox", "from_addr": "ada@example.com", "from_name": "Ada", "to_addrs": "bob@example.com", "date_utc": "2026-09-05T20:00:00Z", "message_id_header": "<this@x>", "in_reply_to": "<parent@x>", "references_header": "<root@x> <parent@x>"}
    ids = [("missing", "inbox"), ("rem-owned", "inbox"), ("fresh", "inbox"), ("stale", "inbox"), ("auth-1", "auth")]
    rows = spark.createDataFrame([tuple({**base, "id": i, "lane": lane}.values()) for i, lane in ids], ", ".join(f"{k} string" for k in [*base, "id"]))
    m = schemas.conform(rows, schemas.MESSAGES)
    text = m.select("id", "subject", F.lit("New line.\n> quoted").alias("body"), "from_addr")
    known = spark.createDataFrame([("rem-owned", 0, None), ("fresh", 1, "x"), ("stale", 1, "deadbeef")], "message_id string, quote_stripped int, content_hash string")
    known = known.withColumn("content_hash", F.when(F.col("content_hash") == "x", sha256(F.lit("New line."))).otherwise(F.col("content_hash")))
    meta = schemas.conform(known.withColumn("model", F.lit(ingest.MODEL)), schemas.META)
    return m, text, meta


def test_actions_and_counts(spark):
    m, text, meta = archive(spark)
    rows = ingest.incremental_actions(ingest.prepared(ingest.eligible(ingest.with_text(m, text))), meta)
    assert {r["id"]: r["action"] for r in rows.collect()} == {"missing": "missing", "rem-owned": "skip", "fresh": "skip", "stale": "stale"}
    assert ingest.incremental_counts(rows).first().asDict() == {"examined": 4, "missing": 1, "stale": 1, "skipped_quote_stripped": 1, "skipped_legacy_embedded": 1, "candidates": 2}
    one = rows.where("id = 'missing'").first()
    assert (one["cleaned_body"], one["thread_id"], one["in_reply_to"]) == ("New line.", "<root@x>", "<parent@x>")
    done = ingest.enrich_messages(m, rows.where("action <> 'skip'"))
    assert {r["id"]: r["thread_id"] for r in done.collect()}["missing"] == "<root@x>" and done.columns == m.columns
    with pytest.raises(ValueError):
        ingest.require_incremental(m.drop("thread_id"), meta)


def test_stream_is_idempotent(spark, tmp_path):
    m, text, meta_rows = archive(spark)
    root = f"file://{tmp_path}"
    ingest.with_text(m, text).write.parquet(f"{root}/in")
    meta, vec = tables.VersionedTable(spark, f"{root}/meta", schemas.META), tables.VersionedTable(spark, f"{root}/vec", schemas.VECTORS)
    meta.overwrite(meta_rows)
    calls = tmp_path / "calls"

    def make():
        def embed(texts):
            with open(calls, "a") as f:
                f.writelines("x\n" for _ in texts)
            return [[1.0, float(len(t))] for t in texts]

        return embed

    def run(checkpoint):
        stream = spark.readStream.schema(ingest.with_text(m, text).schema).parquet(f"{root}/in")
        increment.stream_embeddings(stream, meta, vec, make, f"{root}/{checkpoint}", 2, lambda: NOW).awaitTermination()

    run("c1")
    first = len(calls.read_text().splitlines())
    assert {r["message_id"] for r in vec.read().collect()} == {"missing", "stale"} and meta.read().count() == 4
    run("c1")
    run("c2")  # the same files again: every hash is known now
    assert len(calls.read_text().splitlines()) == first and meta.read().count() == 4


def test_merge(spark):
    meta = lambda ids: schemas.conform(spark.createDataFrame([(i, "m", "h") for i in ids], "message_id string, model string, content_hash string"), schemas.META)
    vec = lambda ids: spark.createDataFrame([(i, [1.0]) for i in ids], "message_id string, embedding array<float>")
    got, vectors, counts = ingest.merge_missing(meta(["a", "b"]), vec(["a", "b", "c"]), meta(["b", "c", "d", "e"]), vec(["b", "c", "d"]))
    assert counts.first().asDict() == {"examined": 4, "inserted": 2, "skipped": 1, "missing_vector": 1}
    assert sorted(r["message_id"] for r in got.collect()) == ["a", "b", "c", "d"] and vectors.count() == 4
    compat, *_ = ingest.merge_missing(meta(["a"]), vec(["a"]), meta(["c"]), vec(["c"]), compat=True)
    assert {r["message_id"]: r["content_hash"] for r in compat.collect()} == {"a": "h", "c": None}


def test_versioned_table(spark, tmp_path):
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t", schemas.VECTORS)
    assert t.read().count() == 0
    t.overwrite(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], schemas.VECTORS))
    t.upsert(spark.createDataFrame([("b", [3.0]), ("c", [4.0])], schemas.VECTORS), ["message_id"])
    assert {r[0]: r[1] for r in t.read().collect()} == {"a": [1.0], "b": [3.0], "c": [4.0]}
    with pytest.raises(Exception):
        t.overwrite(spark.createDataFrame([("x",)], "message_id string").select("message_id", F.raise_error(F.lit("no")).cast("array<float>").alias("embedding")))
    assert t.read().count() == 3


def test_schemas(spark):
    old = spark.createDataFrame([("1", "2026-01-01")], "id string, date string")
    row = schemas.conform(old, schemas.MESSAGES).first()
    assert row["date_utc"] == "2026-01-01" and row["has_attachments"] == 0 and row["lane"] is None
    new, added = schemas.migrate(old, schemas.MESSAGES)
    assert "thread_id" in added and schemas.migrate(new, schemas.MESSAGES)[1] == []


def test_hits_file_and_hooks(spark, tmp_path):
    for name, data in (("list", [{"message_id": "a"}, {"message_id": "b"}]), ("object", {"hits": [{"message_id": "a"}]}), ("one", {"message_id": "a"})):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
    assert [tables.read_hits(spark, f"file://{tmp_path}/{n}.json").count() for n in ("list", "object", "one")] == [2, 1, 1]
    assert services.load("math:sqrt")(9) == 3 and services.clamp_tokens(9) == 512 and services.clamp_tokens(None) == 768
    assert services.parse_embeddings({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}) == [[1], [2]]
    assert not services.reachable("http://127.0.0.1:9/")
    with pytest.raises(ValueError):
        services.load("math")


def test_phases(tmp_path):
    log, ran = increment.RunLog(str(tmp_path / "log.json")), []

    def fail():
        raise RuntimeError("no")

    step = lambda name: lambda: ran.append(name)
    assert log.due(now=0)
    said = increment.run_phases(log, [("headers", step("headers"), True), ("bills", fail, False), ("embed", fail, True)], now=1000)
    assert said["headers"] == "done" and said["bills"].startswith("failed") and "daily" not in log.read()
    said = increment.run_phases(log, [("headers", step("headers"), True), ("embed", step("embed"), True)], now=2000)
    assert said == {"headers": "skipped", "embed": "done"} and ran == ["headers", "embed"] and not log.due(now=2001)
    assert log.due(now=2000 + increment.FRESH_SECONDS)


def test_lock_and_guard(tmp_path):
    with increment.writer_lock(str(tmp_path / "lock")):
        with pytest.raises(increment.LockHeld):
            with increment.writer_lock(str(tmp_path / "lock")):
                pass
    with increment.writer_lock(str(tmp_path / "lock")):
        pass
    assert increment.guarded("/x/meta", ("meta",)) == "/x/meta"
    with pytest.raises(PermissionError):
        increment.guarded("/x/other", ("meta",))
