"""Scalar functions against plain Python."""

from __future__ import annotations

import hashlib
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftspark.functions import candidates, identifiers, porter, query_terms, scores, text, threads, vectors


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_clean_body(spark):
    cases = {
        None: "",
        "": "",
        "Sounds good.\nOn Tue, 1 Apr 2025 at 09:00, Ada <ada@example.com> wrote:\n> earlier\n": "Sounds good.",
        "Thanks.\n-- \nAda\nphone": "Thanks.",
        "New\r\n_____\r\nold": "New",
        "Yes\n-----Original Message-----\nno": "Yes",
        "a\nBegin forwarded message:\nb": "a",
        "a\nFrom: x\nSent: y\nTo: z\nSubject: t\nb": "a",
        "a\nFrom: x\nDate: y\nSubject: t\nb": "a",
        "a\n > quoted\n\t>more\nb": "a\nb",
        "a\n\n\n\nb": "a\n\nb",
        "x\nSent from my iPhone 9": "x",
        "x\nget outlook for iOS": "x",
        "    pad \n": "pad",
    }
    assert column(spark, list(cases), text.clean_body) == list(cases.values())


def test_snippet_and_payloads(spark):
    long = "w " * 200
    assert column(spark, [None, " a \n b ", long, "x" * 180, "x" * 181], text.snippet) == ["", "a b", ("w " * 200).strip()[:179] + "…", "x" * 180, "x" * 179 + "…"]
    assert column(spark, ["b", "", None], lambda c: text.embed_text(F.lit(" s "), c)) == ["s\n\nb", "s", "s"]
    assert column(spark, ["y" * 20000], lambda c: F.length(text.embed_text(c, F.lit("")))) == [16000]
    assert column(spark, ["Qwen3-Embedding", "a:B", None], text.model_id) == ["qwen3-embedding-8b", "a-b", "qwen3-embedding-8b"]
    assert column(spark, [None, "é"], text.sha256) == [hashlib.sha256(x).hexdigest() for x in (b"", "é".encode())]


def test_dates_and_senders(spark):
    dates = {"2025-04-01": "2025-04-01T00:00:00Z", "2025-04-01T10:00:00+02:00": "2025-04-01T08:00:00Z", "2025-04-01T10:00:00.5Z": "2025-04-01T10:00:00Z", "soon": "soon", None: ""}
    assert column(spark, list(dates), text.format_date) == list(dates.values())
    pairs = {("a@x", "Ada"): "Ada <a@x>", ("a@x", "A@X"): "a@x", ("Ada <a@x>", "ada"): "Ada <a@x>", ("Bo <a@x>", "ada"): "ada Bo <a@x>", ("", "Ada"): "Ada", (None, None): ""}
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, n string")
    assert [r[1] for r in rows.select("i", text.format_from("a", "n")).orderBy("i").collect()] == list(pairs.values())


def test_document_text(spark):
    cols = [F.lit(x) for x in ("S", "a@x", "Ada", "bob@x", "2025-04-01", "inbox", "Body")]
    got = spark.range(1).select(text.document_text(*cols), text.document_text(*cols, 20)).first()
    assert got[0] == "Subject: S\nFrom: Ada <a@x>\nTo: bob@x\nDate: 2025-04-01T00:00:00Z\nLane: inbox\n\nBody"
    assert got[1] == got[0][:20]


def test_thread_keys(spark):
    assert column(spark, [None, " ", "a@b", "<a@b> <c@d>", "<a@b", "plain text", "x y@z"], threads.normalize_message_id) == [None, None, "<a@b>", "<a@b>", "<a@b>", "plain text", "x y@z"]
    rows = [(0, "<r@x> <p@x>", "p@x", "<o@x>"), (1, None, "p@x", "<o@x>"), (2, "", None, "o@x"), (3, None, " ", None)]
    df = spark.createDataFrame(rows, "id int, refs string, reply string, own string")
    got = df.select("id", threads.thread_id("refs", "reply", "own", "id")).orderBy("id").collect()
    assert [r[1] for r in got] == ["<r@x>", "<p@x>", "<o@x>", "3"]


def test_identifiers(spark):
    body = "Invoice #12345 and INV-7788, inv-7788; 123-456-78 0f8fad5b-d9cb-469f-a165-70867728950e"
    want = ["0f8fad5b-d9cb-469f-a165-70867728950e", "123-456-78", "INV-7788", "Invoice #12345", "12345", "7788"]
    assert column(spark, [body, "", None], identifiers.extract_identifiers) == [want, [], []]
    assert identifiers.query_identifiers(body) == want
    assert identifiers.is_identifier_query("where is inv-7788?") and not identifiers.is_identifier_query("hello")


def test_lane_inference():
    cases = {"SDGE bill": "money", "cost $5": "money", "Ada Lovelace": "people", "from Ada": "people", "ask Ada": "people", "The thing": None, "hello there": None, "": None}
    assert {q: query_terms.infer_lane(q) for q in cases} == cases
    assert query_terms.infer_lane("SDGE bill", "People ") == "people" and query_terms.infer_lane("SDGE bill", "none") is None


def test_phrases_and_dates():
    assert query_terms.phrases("INV-7788 café") == [["inv", "7788"], ["caf"]]
    assert query_terms.date_bounds("2026-01-01", "2026-12-31") == ("2026-01-01", "2026-12-31T23:59:59.999999Z")
    assert query_terms.date_bounds("", " ") == (None, None)


def test_filters(spark):
    hi = query_terms.date_bounds(None, "2026-12-31")[1]
    values = [None, "2026-12-31T23:59:59Z", "2026-12-31T00:00:00Z"]
    assert column(spark, values, lambda c: candidates.in_dates(c, None, hi)) == [True, False, True]
    assert column(spark, values, lambda c: candidates.in_dates(c, "2026-01-01", None)) == [False, True, True]
    assert column(spark, ["\n", " ", None, "x"], candidates.has_body) == [True, False, False, True]
    assert column(spark, [str(n) for n in (10, 15, 20, 21)], lambda c: candidates.length_skip(c.cast("int"), None, 15)) == ["too_short", "too_short", None, None]
    assert column(spark, [str(n) for n in (14, 15, 20, 21)], lambda c: candidates.length_skip(c.cast("int"), 20, 15)) == ["too_short", None, None, "too_long"]
    with pytest.raises(ValueError):
        candidates.length_skip("n", 1, 2)


def test_incremental_action(spark):
    rows = [(False, None, None), (True, 0, None), (True, 1, "h"), (True, 1, "other"), (True, 0, "h"), (True, None, " ")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p boolean, q int, s string")
    got = df.select("i", candidates.incremental_action("p", "q", "s", F.lit("h"))).orderBy("i").collect()
    assert [r[1] for r in got] == ["missing", "skip", "skip", "stale", "stale", "skip"]


@settings(max_examples=10, deadline=None)
@given(ids=st.lists(st.text(max_size=12), min_size=1, max_size=20), n=st.integers(2, 9))
def test_shards(spark, ids, n):
    want = [int.from_bytes(hashlib.sha1(i.encode()).digest()[:8], "big") % n for i in ids]
    got = column(spark, ids, lambda c: F.coalesce(*(F.when(candidates.in_shard(c, n, r), F.lit(r)) for r in range(n))))
    assert got == want


def test_scores(spark):
    said = ["Yes.", "no", "0.73", "87", "-1", "1, 2, 3", "", "1000", "<think>no</think> yes"]
    got = column(spark, said, scores.parse_score)
    assert got == [1.0, 0.0, 0.73, 0.87, 0.0, None, None, 1.0, 1.0]
    dates = ["2026-01-01T00:00:00Z", "2027-01-01", "never", None]
    assert [round(x, 6) for x in column(spark, dates, lambda c: scores.recency(c, "2026-01-11T00:00:00Z"))] == [round(2.718281828459045**-0.02, 6), 1.0, 1.0, 1.0]
    assert scores.checked_scores([1, (0.0, 0.0)], 2) == [1.0, 0.5] and scores.checked_scores(2, 1) == [2.0]
    for bad, n in ((None, 1), ("1", 1), ([1], 2), ([float("nan")], 1), ([True], 1), (1.0, 2), ([[1, 2, 3]], 1), ({}, 0)):
        with pytest.raises(scores.ScoreError):
            scores.checked_scores(bad, n)
    assert scores.yes_no_from_logprobs([{"token": "Yes", "logprob": 0.0}]) == pytest.approx(1 / (1 + 2.718281828459045**-10))
    assert scores.yes_no_from_logprobs([]) is None


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    assert df.select(vectors.l2_normalize("v")).first()[0] == [0.6, 0.8]
    assert df.select(vectors.adapt_dims("v", 1)).first()[0] == [1.0]
    for bad in (vectors.adapt_dims("v", 3), vectors.l2_normalize(F.transform("v", lambda x: x * 0))):
        with pytest.raises(Exception):
            df.select(bad).collect()


def test_stems_as_the_full_text_engine():
    """Against the Porter tokenizer of SQLite's full-text index."""
    words = "caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll running invoices payment statement the thing".split()
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    con.execute("create virtual table v using fts5vocab(t, row)")
    for word in words:
        con.execute("delete from t")
        con.execute("insert into t values (?)", (word,))
        assert porter.stem(word) == con.execute("select term from v").fetchone()[0], word


def test_index_tokens_as_the_full_text_engine(spark):
    con = sqlite3.connect(":memory:")
    texts = ["café ÅNGSTRÖM Straße", "a_b-c.d@e", "x1 2y", "Ñandú über"]
    for t in texts:
        con.execute("drop table if exists t")
        con.execute("drop table if exists v")
        con.execute("create virtual table t using fts5(x, tokenize='unicode61')")
        con.execute("create virtual table v using fts5vocab(t, instance)")
        con.execute("insert into t values (?)", (t,))
        want = [r[0] for r in con.execute("select term from v order by offset")]
        assert column(spark, [t], text.tokens)[0] == want == query_terms.fold_tokens(t)
