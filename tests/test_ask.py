"""Asking, tools and the archive on disk."""

from __future__ import annotations

import json
import sqlite3

from siftspark import __main__ as cli
from siftspark.functions.query_terms import phrases
from siftspark.plans.ask import ask, call, get_message, hybrid_search, query_vector, semantic_search, tools
from siftspark.plans.disk import open_store, refresh_indexes
from siftspark.plans.retrieve import Query, retrieve
from siftspark.sources import schemas
from siftspark.sources.services import ServiceError

NOW = "2026-09-06T15:00:00Z"


def archive(spark, root, indexed=True):
    rows = [("m1", "money", "Shop", "Receipt for boat paint", None, "2026-09-01T00:00:00Z", "t1"), ("m2", "auth", "Bank", "Your code is 1", "boat 123456", "2026-09-02T00:00:00Z", "t2"), ("m3", "inbox", "", "", "", "2026-09-03T00:00:00Z", "t1")]
    m = spark.createDataFrame(rows, "id string, lane string, from_addr string, subject string, snippet string, date_utc string, thread_id string")
    schemas.conform(m, schemas.MESSAGES).write.parquet(f"{root}/messages")
    text = [("m1", "Receipt for boat paint", "Paint for the boat, INV-7788", "Shop"), ("m2", "Your code is 1", "boat 123456", "Bank"), ("m3", "Boat again", "More about the boat and its paint", "Ada")]
    spark.createDataFrame(text, schemas.MESSAGE_TEXT).write.parquet(f"{root}/text")
    spark.createDataFrame([("m1", [1.0, 0.0]), ("m3", [0.8, 0.6])], schemas.VECTORS).write.parquet(f"{root}/vectors")
    if indexed:
        refresh_indexes(spark, root)


def test_search_stems_as_the_full_text_engine(spark, tmp_path):
    """An archive on disk against SQLite's porter unicode61, with words in other forms than the text's."""
    root = f"file://{tmp_path}/s"
    text = [("m1", "Invoice for paint", "He runs the boats", "Ada"), ("m2", "Invoices", "running boat and invoiced", "Bo"), ("m3", "other", "nothing, INV-7788s", "Cy"), ("m4", "Paint", "painted boats, INV 7788", "Di"), ("m5", "x", "cold days", "Ed")]
    text += [(f"n{i}", "filler", f"word{i}", "Ed") for i in range(6)]
    m = spark.createDataFrame([(i, "inbox", f, s, "2026-09-01T00:00:00Z", i) for i, s, _, f in text], "id string, lane string, from_addr string, subject string, date_utc string, thread_id string")
    schemas.conform(m, schemas.MESSAGES).write.parquet(f"{root}/messages")
    spark.createDataFrame(text, schemas.MESSAGE_TEXT).write.parquet(f"{root}/text")
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, subject, body, from_addr, tokenize='porter unicode61')")
    con.executemany("insert into f values (?, ?, ?, ?)", text)
    asked = ["invoices", "running boats", "painting", "INV-7788", "boat boats", "day"]
    want = {}
    for i, q in enumerate(asked):
        found = con.execute("select id from f where f match ? order by round(bm25(f, 0.0, 5.0, 1.0, 1.0), 9), id", (" AND ".join('"%s"' % " ".join(p) for p in phrases(q)),))
        want[i] = [r[0] for r in found]
    assert all(want.values())
    for built in (False, True):
        if built:
            refresh_indexes(spark, root)
        found = retrieve(spark, open_store(spark, root), [Query(i, q, lane="none") for i, q in enumerate(asked)], now=NOW, expand=False).where("fts_rank < 1000")
        got = {i: [] for i in range(len(asked))}
        for r in found.orderBy("query_id", "fts_rank").collect():
            got[r["query_id"]].append(r["message_id"])
        assert got == want


def test_archive_on_disk(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/a"
    archive(spark, root)
    store, text = open_store(spark, root), spark.read.parquet(f"{root}/text")
    filled = {r["id"]: r for r in store.messages.collect()}
    assert filled["m3"]["subject"] == "Boat again" and filled["m3"]["from_addr"] == "Ada" and filled["m3"]["snippet"].startswith("More about")

    embed = lambda texts: [[1.0, 0.0]]
    said = {}

    def generate(messages):
        said["prompt"] = messages[1]["content"]
        return "see m1"

    got, audit = ask(spark, store, text, "boat", now=NOW, embed=embed, generate=generate, lane="none")
    assert got.generate_mode == "live" and set(got.citations) == {"m1", "m2", "m3"} and got.citations[-1] == "m2"
    assert "Paint for the boat" in said["prompt"] and "123456" not in said["prompt"]
    row = audit.first()
    assert row["hit_count"] == 3 and row["hit_ids"].split(",") == got.citations and "Paint" not in str(row)

    def broken(_):
        raise ServiceError("down")

    assert query_vector(spark, "x", broken) is None
    hits = hybrid_search(spark, store, "INV-7788", now=NOW, embed=broken, lane="none").collect()
    assert [h["message_id"] for h in hits if h["rrf"] > 0] == ["m1"] and hits[0]["vec_rank"] == 1000
    near = semantic_search(spark, store, text, "paint", embed, 2).orderBy("distance").collect()
    assert [r["id"] for r in near] == ["m1", "m3"] and near[0]["score"] == 1.0
    assert get_message(store.messages, text, "m2")["auth_shaped"] and get_message(store.messages, text, "none") is None

    served = tools(spark, store, text, clock=lambda: NOW, embed=embed)
    assert [m["id"] for m in call(served, "get_thread", {"thread_id": "t1"})["messages"]] == ["m1", "m3"]
    assert len(call(served, "hybrid_search", {"query": "boat", "fts_only": True, "lane": "none"})["hits"]) == 3
    assert call(served, "ask", {"query": "boat", "lane": "none", "k": 0})["generate_mode"] == "hits_only"
    assert call(served, "draft_reply", {"message_id": "m1", "text": "hi"})["draft"]["status"] == "pending"
    for name, a in (("nothing", {}), ("get_thread", {}), ("draft_reply", {"message_id": "m1", "text": "x", "send": True}), ("ask", {"query": " "})):
        assert "error" in call(served, name, a)

    assert cli.main(["search", root, "boat", "--lane", "none"]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert {x["message_id"] for x in lines} == {"m1", "m2", "m3"}
    assert cli.main(["health", root]) == 2
