"""Search, fusion and threads on small archives."""

from __future__ import annotations

import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.functions.query_terms import phrases
from siftspark.operators import answers, fusion, health, lexical, thread_pack, vector
from siftspark.plans.queries import queries
from siftspark.plans.retrieve import Query, Store, retrieve, subject_then_body
from siftspark.sources import schemas

NOW = "2026-09-06T15:00:00Z"


def messages(spark, rows):
    """Rows of dicts with the defaults of a small archive."""
    full = []
    for r in rows:
        base = {"lane": "inbox", "date_utc": "2026-09-01T00:00:00Z", "thread_id": r["id"], "from_addr": "a@example.com", "snippet": r.get("subject"), "body": r.get("subject")}
        full.append(base | r)
    fields = ["id", "subject", "body", "from_addr", "lane", "date_utc", "thread_id", "snippet"]
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in full], ", ".join(f"{f} string" for f in fields))


def store(spark, rows, vecs=None):
    m = messages(spark, rows)
    v = spark.createDataFrame([(i, list(map(float, x))) for i, x in (vecs or {}).items()], "message_id string, embedding array<float>")
    index = lexical.build_index(m, ["subject", "body", "from_addr"])
    return Store(m, index, v, lexical.identifier_index(m, "id", ["body"]))


def ask(spark, s, *args, **kwargs):
    options = {k: kwargs.pop(k) for k in ("k", "scorer", "expand") if k in kwargs}
    return retrieve(spark, s, [Query(1, *args, **kwargs)], now=NOW, **options).orderBy("out_pos").collect()


def test_bm25_as_the_full_text_engine(spark):
    docs = [(1, "red fox", "the quick red fox INV-7788 jumps"), (2, "dog", "lazy dog and INV 7788 and a red fox"), (3, "", "nothing here"), (4, "inv", "7788 inv-9 red"), (5, "fox fox", "red"), (6, "", "cold day"), (7, "", "warm day today")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(id unindexed, subject, body, tokenize='unicode61')")
    con.executemany("insert into f values (?, ?, ?)", docs)
    index = lexical.build_index(spark.createDataFrame(docs, "id long, subject string, body string"), ["subject", "body"])
    for q in ("red", "fox red", "INV-7788", "day", "INV-7788 fox"):
        match = " AND ".join('"%s"' % " ".join(p) for p in phrases(q))
        want = dict(con.execute("select id, -bm25(f, 0.0, 5.0, 1.0) from f where f match ?", (match,)).fetchall())
        got = {r["id"]: r["score"] for r in lexical.match(index, lexical.phrase_table(spark, {1: phrases(q)}), {"subject": 5, "body": 1}).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want), q


def test_whole_passages(spark):
    """Passages of a table as queries: all of their phrases count, not only the first."""
    docs = [(1, "The quick red fox jumps over INV-7788"), (2, "the quick red fox sleeps"), (3, "The quick red dog, inv 7788"), (4, "7788 inv over the quick red fox jumps"), (5, "")]
    asked = [(10, "The quick red fox jumps over INV-7788"), (11, "the quick red"), (12, "the quick red fox and nobody"), (13, "red red dog."), (14, ""), (15, None), (16, "the.quick fox")]
    index = lexical.build_index(spark.createDataFrame(docs, "id long, body string"), ["body"])
    table = lexical.phrases_of(spark.createDataFrame(asked, "item_id long, text string"), "item_id", "text")
    known = {q: phrases(t) for q, t in asked}
    want = sorted(map(tuple, lexical.phrase_table(spark, known).collect()))
    assert sorted(map(tuple, table.select("query_id", "phrase", "offset", "term", "size", "phrases").collect())) == want
    got = {tuple(r) for r in lexical.holders(index, table).collect()}
    assert got == {(10, 1), (11, 1), (11, 2), (11, 3), (11, 4), (13, 3), (16, 1), (16, 2), (16, 4)}
    assert got == {(r["query_id"], r["id"]) for r in lexical.match(index, lexical.phrase_table(spark, known), {"body": 1}).collect()}


def test_benchmark_asks_whole_passages(spark, tmp_path):
    docs = [(1, "one two three four five"), (2, "one two three six")]
    fields = "doc_id long, text string, lang string, source string"
    spark.createDataFrame([(*d, "en", "web") for d in docs], fields).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four"), (2, "one two three seven")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in queries()["benchmark_batch"](spark, f"file://{tmp_path}").collect()] == [(1, 1)]


def test_index_on_disk(spark, tmp_path):
    docs = spark.createDataFrame([(1, "running dogs"), (2, "a dog runs")], "id long, body string")
    index = lexical.stemmed(lexical.build_index(docs, ["body"]))
    lexical.write_index(index, f"file://{tmp_path}/index")
    again = lexical.read_index(spark, f"file://{tmp_path}/index")
    found = lexical.match(again, lexical.phrase_table(spark, {1: [["run"], ["dog"]]}), {"body": 1})
    assert {r["id"] for r in found.collect()} == {1, 2}


def test_both_lists(spark):
    s = store(spark, [{"id": "m-sdge", "subject": "SDGE bill", "lane": "money", "date_utc": "2026-09-05T15:00:00Z"}, {"id": "m-boat", "subject": "boat", "date_utc": "2026-01-01"}], {"m-sdge": [1, 0], "m-boat": [0.5, 1]})
    hit = ask(spark, s, "SDGE bill", [1.0, 0.0], lane="none")[0]
    assert (hit["message_id"], hit["fts_rank"], hit["vec_rank"]) == ("m-sdge", 1, 1)
    assert hit["rrf"] == pytest.approx(2 / 61 * math.exp(-0.002))


def test_date_window_and_missing_rank(spark):
    s = store(spark, [{"id": "old", "subject": "SDGE bill", "lane": "money", "date_utc": "2020-01-01T00:00:00Z"}, {"id": "new", "subject": "SDGE bill", "lane": "money", "date_utc": "2026-08-01T00:00:00Z"}])
    got = ask(spark, s, "SDGE bill", after="2026-01-01", before="2026-12-31")
    assert [h["message_id"] for h in got] == ["new"] and got[0]["rrf"] == pytest.approx(1 / 61 + 1 / 1060)


def test_lane_rules(spark):
    rows = [{"id": "m-money", "subject": "SDGE bill", "lane": "money"}, {"id": "m-null", "subject": "x", "lane": None}, {"id": "m-inbox", "subject": "SDGE bill"}]
    s = store(spark, rows, {"m-null": [1, 0]})
    # the lane was inferred: the vector list alone falls back
    assert {h["message_id"] for h in ask(spark, s, "SDGE bill", [1.0, 0.0])} == {"m-money", "m-null"}
    # it was given: nothing falls back
    got = ask(spark, s, "SDGE bill", [1.0, 0.0], lane="money")
    assert [(h["message_id"], h["vec_rank"]) for h in got] == [("m-money", 1000)]
    # nothing at all in the inferred lane: it is dropped
    only = store(spark, [{"id": "m1", "subject": "SDGE bill"}])
    assert [h["message_id"] for h in ask(spark, only, "SDGE bill")] == ["m1"]


def test_identifier_query(spark):
    rows = [{"id": "a", "subject": "about INV-7788", "body": "INV-7788"}, {"id": "b", "subject": "other", "body": "nothing"}]
    got = ask(spark, store(spark, rows), "INV-7788", lane="none")
    assert got[0]["message_id"] == "a" and got[0]["rrf"] == pytest.approx((1 / 61 + 1 / 1060 + 1 / 61) * math.exp(-0.002 * 5.625), rel=1e-3)


def test_threads(spark):
    thread = [{"id": "root", "subject": "plan", "thread_id": "root", "date_utc": "2026-01-01"}] + [{"id": f"r{i}", "subject": "plan boat", "thread_id": "root", "date_utc": f"2026-01-0{i + 1}"} for i in range(1, 5)]
    s = store(spark, [*thread, {"id": "solo", "subject": "plan boat"}])
    got = ask(spark, s, "boat", k=2, lane="none")
    packed = [h for h in got if h["rrf"] > 0][:2]
    assert {h["thread_id"] for h in packed} == {"root", "solo"} and "root" in {h["message_id"] for h in got}
    assert len({h["message_id"] for h in got}) == len(got) and {"r2", "r3", "r4"} <= {h["message_id"] for h in got}
    assert len(ask(spark, s, "boat", k=2, lane="none", expand=False)) == 2
    order = [r["id"] for r in thread_pack.get_thread(s.messages, "root").collect()]
    assert order == ["root", "r1", "r2", "r3", "r4"]


def hits(spark, n=3):
    rows = [(1, chr(97 + i), i + 1, (30 - i) / 100, None, f"s{i}", "x", None) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, id string, pos long, rrf double, rerank double, subject string, snippet string, thread_id string")


def test_rerank(spark):
    order = lambda df: [r["id"] for r in df.orderBy("pos").collect()]
    got, mode = fusion.rerank(hits(spark), {1: "q"}, lambda q, d: [0.1, 0.2, 0.9])
    assert order(got) == ["c", "b", "a"] and mode == {1: "live"}
    for bad in (lambda q, d: [1.0], lambda q, d: "1, 2, 3", lambda q, d: 1 / 0):
        got, mode = fusion.rerank(hits(spark), {1: "q"}, bad)
        assert order(got) == ["a", "b", "c"] and mode == {1: "fail_open"} and not got.where("rerank is not null").count()
    got, _ = fusion.rerank(hits(spark, 25), {1: "q"}, lambda q, d: [0.5] * len(d))
    assert order(got) == [chr(97 + i) for i in range(25)] and got.where("rerank is null").count() == 5
    assert fusion.rerank(hits(spark), {1: "q"}, None)[1] == {1: "none"}


def test_citations(spark):
    live = hits(spark).withColumn("rerank", F.when(F.col("id") == "c", 0.9))
    ids = lambda df: [r["id"] for r in thread_pack.citations(df).orderBy("citation").collect()]
    assert ids(live) == ["c", "a", "b"] and ids(hits(spark)) == ["a", "b", "c"]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "message_id long, embedding array<float>").repartition(5)
    got = vector.knn(rows, [(7, x[3].tolist())], 10).orderBy("vec_rank").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [r["id"] for r in got] == np.argsort(1 - unit @ unit[3], kind="stable")[:10].tolist()
    assert vector.knn(rows, [], 10).count() == 0
    with pytest.raises(ValueError):
        vector.knn(rows, [(1, [1.0]), (2, [1.0, 2.0])], 5)


def test_subject_first(spark):
    s = store(spark, [{"id": "s1", "subject": "boat plan", "body": "x"}, {"id": "b1", "subject": "x", "body": "boat"}])
    assert [r["id"] for r in subject_then_body(spark, s, "boat", 5).orderBy("pos").collect()] == ["s1", "b1"]
    assert [r["id"] for r in lexical.subject_scan(s.messages, "BOAT p%lan").collect()] == ["s1"]


def test_prompt_and_audit_hold_back(spark):
    m = messages(spark, [{"id": "m1", "subject": "receipt"}, {"id": "m2", "subject": "code", "lane": "auth"}, {"id": "m3", "subject": "Your one-time password"}])
    cited = spark.createDataFrame([(1, "m1", 1), (1, "m2", 2), (1, "m3", 3), (1, "ghost", 4)], "query_id long, id string, citation long")
    block = answers.prompt_block(cited, m.withColumn("prompt_body", F.col("body"))).first()["block"]
    assert "m1" in block and "m2" not in block and "password" not in block and "ghost" not in block
    row = answers.audit_rows(cited, spark.createDataFrame([(1, "q")], "query_id long, query string"), NOW, "me", 8).first()
    assert row["hit_ids"] == "m1,m2,m3,ghost" and row["hit_count"] == 4 and "receipt" not in str(row)
    assert answers.answer("q", [], ["m1"], block, None).generate_mode == "hits_only"
    assert answers.answer("q", [], ["m1"], block, lambda m: "yes").generate_mode == "live"

    def broken(_):
        raise RuntimeError("down")

    out = answers.answer("q", [], ["m1"], block, broken)
    assert out.generate_mode == "fail_open" and out.citations == ["m1"]
    assert answers.draft_row(m, "m1", "hi", NOW).first()["status"] == "pending"
    with pytest.raises(ValueError):
        answers.draft_row(m, "m1", "hi", NOW, send=True)
    with pytest.raises(KeyError):
        answers.draft_row(m, "none", "hi", NOW)


def test_health(spark):
    m = messages(spark, [{"id": f"m{i}", "subject": "s"} for i in range(1, 5)])
    meta = schemas.conform(spark.createDataFrame([("m1",), ("m2",)], "message_id string"), schemas.META)
    vec = spark.createDataFrame([("m1", [1.0]), ("m2", [1.0])], "message_id string, embedding array<float>")
    report = health.run_health(m, meta, vec)
    assert (report.messages, report.embeddings, report.coverage_gap, report.exit_code) == (4, 2, 2, 0) and report.warnings
    assert health.run_health(m.union(m), meta, vec).exit_code == 1 and health.run_health(None, meta, vec).exit_code == 2
