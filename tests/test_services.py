"""Scorers, servers, runs that write, and the health run."""

from __future__ import annotations

import io
import json
import math
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark import __main__ as cli
from siftspark.functions.scores import ScoreError
from siftspark.operators import answers, vector
from siftspark.plans import checkup, runs, server
from siftspark.plans.ask import tools
from siftspark.plans.disk import migrate_table, open_store, upsert_identifiers
from siftspark.plans.retrieve import Query, retrieve
from siftspark.sources import schemas, scorers, services, tables
from siftspark.sources.commits import CommitLog
from siftspark.streaming import increment

from .test_ask import NOW, archive

# --- scorers --------------------------------------------------------------------------------------


def status(code, text=b""):
    return urllib.error.HTTPError("http://x", code, "no", {}, io.BytesIO(text))


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ({"response": "<think>no</think> Yes."}, 1.0),
        ({"response": "No"}, 0.0),
        ({"response": "0.25"}, 0.25),
        ({"response": "-3"}, 0.0),
        ({"response": "50"}, 0.5),
        ({"message": {"content": "yes"}}, 1.0),
        ({"response": "no", "logprobs": [{"token": "yes", "logprob": 0.0}, {"token": "no", "logprob": 0.0}]}, 0.5),
        ({"message": {"content": "x", "logprobs": [{"token": " Yes", "prob": 1.0}]}}, 1 / (1 + math.exp(-10))),
        ({"logprobs": {"content": [{"text": "no", "logprob": -10.0}]}}, 0.5),
        ({"response": "0.1, 0.2"}, ScoreError),
        ({"response": ""}, ScoreError),
        ({"response": "maybe"}, ScoreError),
    ],
)
def test_answers_of_a_reranker(answer, want):
    if isinstance(want, float):
        assert scorers.answered_score(answer) == pytest.approx(want)
    else:
        with pytest.raises(want):
            scorers.answered_score(answer)


def test_service_scorer():
    asked = []

    def post(first):
        def one(url, payload, timeout):
            asked.append((url.rpartition("/")[2], payload))
            if url.endswith("generate") and isinstance(first, Exception):
                raise first
            return first if url.endswith("generate") else {"message": {"content": "yes"}}

        return one

    score = scorers.service_scorer("http://x/", post=post({"response": "0.5"}))
    assert score("boat", ["a", "b"]) == [0.5, 0.5] and [a for a, _ in asked] == ["generate", "generate"]
    assert asked[0][1]["raw"] and asked[0][1]["prompt"].endswith("<|im_start|>assistant\n<think>\n\n</think>\n\n") and "<Query>: boat\n<Document>: a<|im_end|>" in asked[0][1]["prompt"]
    for failed in (status(404), status(400), json.JSONDecodeError("x", "", 0), ["no object"]):
        asked.clear()
        assert scorers.service_scorer("http://x", post=post(failed))("q", ["d"]) == [1.0]
        assert [a for a, _ in asked] == ["generate", "chat"] and asked[1][1]["messages"][1]["content"].endswith("<Document>: d")
    with pytest.raises(services.ServiceError):
        scorers.service_scorer("http://x", post=post(status(500)))("q", ["d"])
    assert scorers.service_scorer("http://x", post=post(status(500)))("q", []) == []


def test_encoder_scorer():
    def old(pairs, show_progress_bar=True):
        assert not show_progress_bar
        return np.array([0.25] * len(pairs))

    def oldest(pairs):
        return [[1.0, 1.0] for _ in pairs]

    class Encoder:
        def predict(self, pairs, prompt, show_progress_bar, convert_to_numpy):
            return [float(len(prompt) > 0)] * len(pairs)

    assert scorers.encoder_scorer(predict=old)("q", ["a", "b"]) == [0.25, 0.25]
    assert scorers.encoder_scorer(predict=oldest)("q", ["a"]) == [0.5]
    assert scorers.encoder_scorer(Encoder())("q", ["a", None]) == [1.0, 1.0] and scorers.encoder_scorer(Encoder())("q", []) == []
    with pytest.raises(ScoreError):
        scorers.encoder_scorer(predict=lambda pairs: [0.1])("q", ["a", "b"])
    with pytest.raises(services.ServiceError):
        scorers.encoder_scorer(object())("q", ["a"])
    with pytest.raises(services.ServiceError):
        scorers.encoder_scorer()("q", ["a"])  # the library is not here
    assert scorers.scorer("off") is None and callable(scorers.scorer("ollama")) and callable(scorers.scorer("crossencoder"))
    with pytest.raises(ValueError):
        scorers.scorer("other")


def test_labels():
    assert [scorers.rerank_mode(*x) for x in ((False, True), (True, True), (True, False), (True, False, "off"), (True, True, "odd"))] == ["none", "crossencoder", "fail_open", "off", "crossencoder"]
    assert len({scorers.rerank_note(m) for m in ("crossencoder", "none", "off", "fail_open")}) == 3
    cases = [(TimeoutError(), "lm_studio_timeout"), (status(404), "wrong_model"), (status(500, b"no such Model"), "wrong_model"), (status(500), "lm_studio_http"), (ConnectionRefusedError(), "port_closed")]
    cases += [(urllib.error.URLError(ConnectionRefusedError()), "port_closed"), (urllib.error.URLError(OSError(61, "x")), "port_closed"), (urllib.error.URLError("x"), "lm_studio_unreachable"), (ValueError(), "lm_studio_unreachable")]
    assert [scorers.error_label(e) for e, _ in cases] == [want for _, want in cases]
    got = answers.answer("q", [], [], "", lambda _: (_ for _ in ()).throw(ConnectionRefusedError("no")), "none")
    assert (got.generate_mode, got.generate_error) == ("fail_open", "port_closed") and "no hits" in answers.response_lines(got)


def test_prompt_of_hits():
    one = answers.hits_messages("q", [{"message_id": "a", "subject": "é"}])[1]["content"]
    assert one == 'Question:\nq\n\nHits:\n[{"message_id": "a", "subject": "é"}]'
    long = answers.hits_messages("q", [{"subject": "x" * 30_000}])[1]["content"]
    assert long.endswith("x…") and len(long) == len("Question:\nq\n\nHits:\n") + answers.HITS_CAP + 1


# --- neighbours -----------------------------------------------------------------------------------


def test_table_of_queries(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x[7] = x[3]
    vectors = spark.createDataFrame([*((f"m{i}", v.tolist()) for i, v in enumerate(x)), ("none", None)], "message_id string, embedding array<float>")
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 50)] + [(900, None)], "query_id long, v array<float>")
    got = {(r["query_id"], r["vec_rank"]): (r["id"], round(r["distance"], 6)) for r in vector.knn_table(vectors, asked, 5).collect()}
    want = {(r["query_id"], r["vec_rank"]): (r["id"], round(r["distance"], 6)) for r in vector.knn(vectors, [(i, np.float32(x[i]).tolist()) for i in range(0, 300, 50)], 5).collect()}
    assert got == want and len(got) == 30
    assert vector.knn_table(vectors.where("false"), asked, 5).count() == 0 and vector.knn_table(vectors, asked.where("false"), 5).count() == 0


# --- tables ---------------------------------------------------------------------------------------


def test_segments_and_crashes(spark, tmp_path, monkeypatch):
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t", schemas.VECTORS)
    rows = lambda *r: spark.createDataFrame([(i, [x]) for i, x in r], schemas.VECTORS)
    held = lambda: {r[0]: r[1][0] for r in t.read().collect()}
    t.upsert(rows(("a", 1.0), ("b", 2.0), ("b", 1.0)), ["message_id"])
    assert held() == {"a": 1.0, "b": 2.0} and t.read().count() == 2  # one row for each key, the greatest
    t.upsert(rows(("b", 3.0), ("c", 4.0), ("c", 4.0)), ["message_id"])
    t.upsert(rows(("b", 0.5)), ["message_id"])
    assert held() == {"a": 1.0, "b": 0.5, "c": 4.0} and t.read().count() == 3 and len(t.current()[0]) == 3

    before = t.read()
    put = CommitLog.put
    monkeypatch.setattr(CommitLog, "put", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        t.upsert(rows(("d", 9.0)), ["message_id"])
    with pytest.raises(RuntimeError):
        t.overwrite(rows(("d", 9.0)))
    monkeypatch.setattr(CommitLog, "put", put)
    assert held() == {"a": 1.0, "b": 0.5, "c": 4.0}  # a crash between writing and pointing leaves the table whole
    t.upsert(rows(("d", 9.0)), ["message_id"])
    assert len(t.current()[0]) == 1 and held() == {"a": 1.0, "b": 0.5, "c": 4.0, "d": 9.0}  # four of like size were merged
    assert before.count() == 3  # a reader of the version before keeps its files
    t.vacuum(1, grace=0)
    assert held() == {"a": 1.0, "b": 0.5, "c": 4.0, "d": 9.0} and len(list((tmp_path / "t").glob("s-*"))) == 1
    with pytest.raises(ValueError):
        t.upsert(rows(("d", 1.0)), ["message_id", "embedding"])


def test_writers_that_meet(spark, tmp_path):
    """Writers at once, each in a thread, lose no row; a number is taken once."""
    log = CommitLog(spark, f"file://{tmp_path}/l")
    assert log.put(1, {"x": 1}) and not log.put(1, {"x": 2}) and log.newest() == (1, {"x": 1})
    assert log.commit(lambda state: None) is None and log.newest()[0] == 1
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t", schemas.VECTORS)
    failed = []

    def write(i):
        try:
            t.upsert(spark.createDataFrame([(f"m{i}", [float(i)]), ("all", [float(i)])], schemas.VECTORS), ["message_id"])
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and {r[0] for r in t.read().collect()} == {"m0", "m1", "m2", "m3", "all"} and t.read().count() == 5


def test_a_change_between_reading_and_committing(spark, tmp_path):
    log, seen = CommitLog(spark, f"file://{tmp_path}/l"), []

    def change(state):
        if not seen:
            CommitLog(spark, log.root).commit(lambda s: {"n": ["other"]})  # another writer is faster
        seen.append(state)
        return {"n": [*(state or {"n": []})["n"], "own"]}

    assert log.commit(change) == {"n": ["other", "own"]} and seen == [None, {"n": ["other"]}]


def test_one_id_in_two_files(spark, tmp_path):
    base = {"subject": "s", "lane": "inbox", "from_addr": "a", "from_name": "", "to_addrs": "", "date_utc": "2026-09-05T20:00:00Z", "message_id_header": "<t@x>", "in_reply_to": "", "references_header": ""}
    made = [tuple({**base, "id": i, "body": b, "ingested_at": at}.values()) for i, b, at in (("m", "old text", "1"), ("m", "new text", "2"), ("n", "x", "1"), ("n", "x", "1"))]
    rows = spark.createDataFrame(made, ", ".join(f"{k} string" for k in [*base, "id", "body", "ingested_at"]))
    meta, vec = (tables.VersionedTable(spark, f"file://{tmp_path}/{n}", s) for n, s in (("meta", schemas.META), ("vec", schemas.VECTORS)))
    done = increment.embed_changed(rows, meta, vec, lambda: lambda texts: [[float(len(t))] for t in texts], NOW, 1)
    assert sorted(r["id"] for r in done.collect()) == ["m", "n"] and vec.read().count() == 2 and meta.read().count() == 2
    assert {r["cleaned_body"] for r in done.collect()} == {"new text", "x"}
    assert increment.embed_changed(rows, meta, vec, lambda: None, NOW, 1).count() == 0


def test_shared_folder(spark):
    class Session:
        """A session that names no folder, on a given master."""

        def __init__(self, master):
            self.conf = type("Conf", (), {"get": lambda _, key, default=None: default})()
            self.sparkContext = type("Context", (), {"master": master, "applicationId": master})()

    assert tables.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert tables.shared_folder(Session("local[4]")).startswith("file:///") and tables.shared_folder(Session("local[4]")) == tables.shared_folder(Session("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError):
            tables.shared_folder(Session(master))


# --- servers --------------------------------------------------------------------------------------


def test_http_and_tools(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    archive(spark, root, False)
    served = tools(spark, open_store(spark, root), spark.read.parquet(f"{root}/text"), clock=lambda: NOW, drafts=f"{root}/drafts")
    assert server.respond(served, "GET", "/health")[1]["tools"] == list(server.SCHEMAS)
    assert server.respond(served, "GET", "/message?id=m1")[1]["message"]["subject"] == "Receipt for boat paint"
    for method, target, body, want in (("GET", "/nothing", b"", 404), ("POST", "/ask", b"{", 400), ("POST", "/ask", b"{}", 400), ("POST", "/ask", b"[]", 400), ("POST", "/other", b"{}", 404), ("PUT", "/ask", b"", 405), ("POST", "/draft_reply", b'{"message_id": "m1", "send": true}', 400)):
        code, said = server.respond(served, method, target, body)
        assert code == want and "error" in said
    code, said = server.respond(served, "POST", "/draft_reply", b'{"message_id": "m1"}')
    assert code == 200 and not said["draft"]["sent"] and said["draft"]["status"] == "pending"
    assert open(said["draft"]["path"].removeprefix("file://")).read() == said["draft"]["text"]
    http = server.http_server(served, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/ask?q=boat") as got:
        assert set(json.load(got)["citations"]) == {"m1", "m2", "m3"}
    served["ask"] = lambda a: (_ for _ in ()).throw(RuntimeError("no\nengine"))
    with pytest.raises(urllib.error.HTTPError) as failed:  # a tool that fails is answered
        urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/ask?q=boat")
    assert failed.value.code == 500 and json.load(failed.value)["error"] == "RuntimeError: no engine"
    for wrong in (b'{"query": "x", "k": []}', b'{"query": 5}', b'{"query": "x", "lane": {}}'):
        assert server.respond(served, "POST", "/ask", wrong)[0] == 400
    with urllib.request.urlopen(f"http://127.0.0.1:{http.server_port}/ui") as page:
        assert page.headers["Content-Type"].startswith("text/html") and b"<form" in page.read()
    http.shutdown()

    line = lambda x: json.dumps(x).encode() + b"\n"
    body = json.dumps({"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "get_thread", "arguments": {"thread_id": "t1"}}}).encode()
    source = line({"id": 1, "method": "initialize"}) + line({"method": "notifications/initialized"}) + b"\n" + line({"id": 2, "method": "tools/list"}) + b"{bad\n" + line({"id": 3, "method": "none"})
    source += b"Content-Length: %d\r\n\r\n" % len(body) + body + line({"id": 5, "method": "tools/call", "params": {"name": "ask"}})
    target = io.BytesIO()
    assert server.serve_tools(served, io.BytesIO(source), target) == 0
    target.seek(0)
    said = []
    while (one := server.read_request(target)) is not None:
        said.append(one)
    assert [x["id"] for x in said] == [1, 2, None, 3, 4, 5] and [t["name"] for t in said[1]["result"]["tools"]] == list(server.SCHEMAS)
    assert [x.get("error", {}).get("code") for x in said] == [None, None, -32700, -32601, None, -32000]
    assert [m["id"] for m in json.loads(said[4]["result"]["content"][0]["text"])["messages"]] == ["m1", "m3"]


def test_neighbours_from_elsewhere(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    archive(spark, root, False)
    given = lambda queries, k: spark.createDataFrame([(q.query_id, "m3", 1) for q in queries], "query_id long, id string, vec_rank long")
    hits = retrieve(spark, open_store(spark, root), [Query(0, "paint", lane="none")], now=NOW, vec_hits=given, expand=False).collect()
    assert {h["message_id"]: h["vec_rank"] for h in hits if h["vec_rank"] < 1000} == {"m3": 1}


# --- runs -----------------------------------------------------------------------------------------


def test_backfill_merge_and_health(spark, tmp_path, capsys):
    root, other = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    for r in (root, other):
        archive(spark, r, False)
    spark.createDataFrame([("m1", "m", "v1")], "message_id string, model string, model_version string").write.parquet(f"{root}/meta")
    assert "content_hash" in migrate_table(spark, f"{root}/meta", schemas.META) and migrate_table(spark, f"{root}/meta", schemas.META) == []
    make = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    dry = runs.backfill(spark, root, None, now=NOW, dims=2, dry=True)
    assert dry["examined"] == 2 and dry["missing"] == 2 and dry["first"] == ["m1", "m3"] and dry["embedded"] == 0
    assert runs.backfill(spark, root, make, now=NOW, dims=2, choice=runs.Choice(limit=1))["embedded"] == 1
    assert runs.backfill(spark, root, make, now=NOW, dims=2)["embedded"] == 1  # goes on where it stopped
    again = runs.backfill(spark, root, make, now=NOW, dims=2)
    assert again["skipped_quote_stripped"] == 2 and again["embedded"] == 0
    read = lambda name, schema, r=root: tables.read(spark, f"{r}/{name}", schema)
    assert {r["message_id"]: r["embedding"][1] for r in read("vectors", schemas.VECTORS).collect()} == {"m1": 1.0, "m3": 1.0}
    assert {r["id"]: r["cleaned_body"] for r in read("messages", schemas.MESSAGES).collect()}["m1"] == "Paint for the boat, INV-7788"
    ids = {r["id"]: r["identifiers"] for r in read("messages_ids", schemas.MESSAGE_IDS).collect()}
    assert "INV-7788" in ids["m1"] and upsert_identifiers(spark, root, spark.createDataFrame([("m1",)], "id string")) == {"examined": 1, "updated": 1, "empty": 0}

    legacy = runs.backfill(spark, other, make, now=NOW, dims=2, legacy=True, choice=runs.Choice(max_chars=45))
    assert (legacy["due"], legacy["too_long"], legacy["embedded"]) == (1, 1, 1)
    record = read("meta", schemas.META, other).first()
    assert record["content_hash"] is None and record["quote_stripped"] == 0
    shards = [runs.backfill(spark, other, None, now=NOW, dims=2, dry=True, choice=runs.Choice(3, i))["examined"] for i in range(3)]
    assert sum(shards) == 2
    with pytest.raises(ValueError):
        runs.backfill(spark, other, None, now=NOW, dims=2)
    empty = f"file://{tmp_path}/c"
    archive(spark, empty, False)
    spark.createDataFrame([], schemas.VECTORS).write.mode("overwrite").parquet(f"{empty}/vectors")
    assert runs.merge_archives(spark, empty, [root, other], dry=True)["inserted"] > 0
    total = runs.merge_archives(spark, empty, [root, other])
    assert total["inserted"] == tables.read(spark, f"{empty}/meta", schemas.META).count() and tables.read(spark, f"{empty}/vectors", schemas.VECTORS).count() == 2
    assert runs.merge_archives(spark, empty, [root])["inserted"] == 0

    def down():
        raise services.ServiceError("down")

    lock = tmp_path / "lock"
    parts = [read(n, s) for n, s in (("messages", schemas.MESSAGES), ("meta", schemas.META), ("vectors", schemas.VECTORS))]
    with increment.writer_lock(str(lock)):
        got = checkup.checkup(spark, open_store(spark, root), *parts, now=NOW, embed=lambda _: [[1.0, 0.0]], probe=down, backups=f"{root}/backups", locks=[str(lock)])
    said = " ".join(got.warnings)
    assert got.exit_code == 0 and got.backups is False and len(got.writers) == 1 and "down" in said and "no backups" in said and "a writer runs" in said
    assert [t["query"] for t in got.texts] == ["bill", "invoice"] and all(h["vec_real"] == 0 for h in got.hybrids)
    up = checkup.checkup(spark, open_store(spark, root), *parts, now=NOW, embed=lambda _: [[1.0, 0.0]])
    assert any(h["vec_real"] for h in up.hybrids) and up.texts[0]["hits"] == 0 and not up.writers
    assert checkup.text_sample(spark, open_store(spark, root), ["boats"])[0] == {"query": "boats", "hits": 3, "subjects": ["Boat again", "Receipt for boat paint", "Your code is 1"]}
    capsys.readouterr()
    assert cli.main(["health", root, "--no-hybrid", "--backups", root]) == 0 and "text search 'bill': 0 hits" in capsys.readouterr().out
    assert cli.main(["backfill", root, "--dry-run", "--dims", "2"]) == 0 and json.loads(capsys.readouterr().out)["candidates"] == 0
    assert cli.main(["message", root, "m1"]) == 0 and json.loads(capsys.readouterr().out)["id"] == "m1"
    assert cli.main(["ask", root, "boat", "--lines"]) == 0 and "# generate_mode=hits_only" in capsys.readouterr().out
    assert cli.main(["migrate", root]) == 0 and cli.main(["draft", root, "m1", "--text", "hi"]) == 0 and cli.main(["draft", root, "none"]) == 1


def test_daily(spark, tmp_path):
    root, ran = f"file://{tmp_path}/a", []
    archive(spark, root, False)
    make = lambda: lambda texts: [[1.0, 0.0] for _ in texts]

    def down():
        raise services.ServiceError("down")

    fetch = {"headers": lambda: ran.append("headers"), "bills": lambda: 1 / 0}
    log = increment.RunLog(str(tmp_path / "log.json"))
    said = increment.run_phases(log, runs.daily_phases(spark, root, make, now=NOW, dims=2, probe=down, fetch=fetch), now=1000)
    assert list(said) == ["headers", "bodies-fts", "classify", "bills", "embed"] and said["embed"].startswith("failed: down") and said["bills"].startswith("failed") and log.due(now=1001)
    said = increment.run_phases(log, runs.daily_phases(spark, root, make, now=NOW, dims=2, fetch=fetch), now=1100)
    assert said["headers"] == "skipped" and said["embed"] == "done" and ran == ["headers"] and not log.due(now=1101)
    assert tables.read(spark, f"{root}/meta", schemas.META).where(F.col("quote_stripped") == 1).count() == 2
