"""What every operator and stage must bear: clashing columns, bytes that are no text, very long texts, ties, repeated rows;
and the two learned operators against plain loops."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.llm import chat_format, exact_dedup, jaccard_join, language_id, line_dedup, mixing, packing, toxicity, url_filter
from siftspark.llm.common import BATCH_BYTES, mix
from siftspark.llm.queries import tokenizer_file

from .test_texts import language_rows, toxic_rows

CLASHING = ["_id", "_sha", "_row", "_text", "score", "id", "sha", "doc", "copies", "copy", "size", "target", "part", "nth", "tie", "alike", "component_id", "text_sha256", "kept", "n_bytes", "owner", "a b.c`d"]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns of every name that an operator might use itself, and a map."""
    rows = [(i, "clean words here are many " + "w%d " % (i // 2) * 8, "en", "ab"[i % 2], 5) for i in range(12)] + [(3, "clean words here are many " + "w1 " * 8, "en", "b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        df = df.withColumn(name, F.concat(F.lit("own "), F.col("doc_id").cast("string")))
    return df.withColumn("kinds", F.create_map(F.lit("k"), F.col("doc_id")))


def stages(spark):
    machine = toxicity.constant(np.zeros(3))
    return {
        "toxicity": lambda d: toxicity.reject_toxic(d, machine),
        "exact": exact_dedup.drop_copies,
        "near": jaccard_join.drop_near_copies,
        "mixing": mixing.mix,
    }


@pytest.mark.parametrize("stage", ["toxicity", "exact", "near", "mixing"])
def test_columns_of_any_name(spark, docs, stage):
    out = stages(spark)[stage](docs)
    assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert rows and all(r[name] == f"own {r['doc_id']}" for r in rows for name in CLASHING) and all(r["kinds"] == {"k": r["doc_id"]} for r in rows)
    want = {"toxicity": 13, "exact": 6, "near": 6}
    assert len(rows) == want.get(stage, len(rows))


def broken(spark):
    """Texts with bytes that are not UTF-8, and a good one."""
    rows = [(1, "C3"), (2, "6120C3280A6220FF"), (3, "61"), (4, "C3"), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, hex string").select("doc_id", F.unhex("hex").cast("string").alias("text"), F.lit("en").alias("lang"), F.unhex("hex").cast("string").alias("source"))


def test_bytes_that_are_no_text(spark):
    df = broken(spark)
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(df).select("doc_id", "keep_id").collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(df).select("doc_id").collect()) == [1, 2, 3, 5]
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(df, k=3, num=90).collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 5}
    got = {r["doc_id"]: r for r in packing.pack(df, tokenizer_file()).collect()}
    encode = packing.word_tokenizer(tokenizer_file())
    assert {i: r["length"] for i, r in got.items()} == {i: len(encode(t)) // 4 + 1 for i, t in ((1, "�"), (2, "a �(\nb �"), (3, "a"), (4, "�"), (5, ""))}
    lines = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["hash"]) for r in line_dedup.line_dedup(df, least=2).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("hash")).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert lines == {1: (1, 1, sha(b"")), 4: (1, 1, sha(b"")), 3: (1, 0, sha(b"a")), 5: (1, 0, sha(b"")), 2: (2, 0, sha(bytes.fromhex("6120C3280A6220FF")))}
    assert mixing.mix_report(df).count() == 5 and toxicity.score(df, toxicity.constant(np.zeros(2))).count() == 5 and language_id.language_id(df).count() == 5
    pages = df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://casino.x/"), "text").alias("url"))
    assert {r["page_id"]: r["verdict"] for r in url_filter.url_filter(pages).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_very_long_texts(spark):
    """Texts beyond any batch, alone and beside short ones; two differ in their last word only."""
    word = "boat harbour mast " * (BATCH_BYTES // 12)
    rows = [(1, word + "x", "a"), (2, word + "y", "a"), (3, word + "x", "b"), (4, "short one here", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).withColumn("lang", F.lit("en"))
    assert len(rows[0][1]) > BATCH_BYTES
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_dedup(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    n = len(rows[0][1].split())
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(df, k=3, num=60).collect()}
    assert near == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (1, 4)}
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix_report(df).collect()}
    assert sizes == {1: n, 2: n, 3: n, 4: 3}
    pieces = packing.pack(df, tokenizer_file()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("piece").alias("last")).collect()
    assert all(r["last"] == -(-r["n"] // packing.CAPACITY) - 1 for r in pieces) and min(r["n"] for r in pieces if r["doc_id"] != 4) > n
    lined = df.withColumn("text", F.replace("text", F.lit("mast "), F.lit("mast\n")))
    kept = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.line_dedup(lined, least=3).collect()}
    m = BATCH_BYTES // 12
    assert kept == {1: (m + 1, m, "x"), 2: (m + 1, m, "y"), 3: (m + 1, m, "x"), 4: (1, 0, "short one here")}
    assert toxicity.score(df, toxicity.constant(np.zeros(2))).count() == 4 and {r["lang_pred"] for r in language_id.language_id(df).collect()} <= {"en", "und"}
    turns = df.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.col("source").alias("role"), "text")
    assert chat_format.chat_perspectives(turns).select(F.max(F.length("rendered")).alias("n")).first()["n"] > 3 * BATCH_BYTES
    urls = df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x.net/"), F.replace("text", F.lit(" "), F.lit("/")), F.lit("/casino")).alias("url"))
    assert {r["verdict"] for r in url_filter.url_filter(urls).collect()} == {"block"}


def test_ties_and_repeated_rows(spark):
    turns = spark.createDataFrame([(1, 1, "b", "two"), (1, 1, "a", "one"), (1, 1, "a", "one"), (1, 0, "b", "x"), (1, 0, "b", "a")], "conv_id long, turn long, role string, text string")
    got = {r["speaker"]: r for r in chat_format.chat_perspectives(turns).collect()}
    said = "<|assistant|>\na<|end|>\n<|assistant|>\nx<|end|>\n<|user name=a|>\none<|end|>\n<|user name=a|>\none<|end|>\n<|assistant|>\ntwo<|end|>\n"
    assert set(got) == {"a", "b"} and got["b"]["rendered"] == said and got["b"]["n_turns"] == 5
    assert [said[int(x) : int(y)] for x, y in (s.split("-") for s in got["b"]["loss_spans"].split(","))] == ["a<|end|>", "x<|end|>", "two<|end|>"]
    pages = spark.createDataFrame([(None, "http://sex.x.net/free/free"), (1, "http://free.x.net/free"), (1, "http://free.x.net/free"), (2, "http://x.net/bet/win")], "page_id long, url string")
    assert Counter((r["page_id"], r["verdict"]) for r in url_filter.url_filter(pages).collect()) == {(None, "block"): 1, (1, "allow"): 2, (2, "block"): 1}


# --- learned operators against plain loops ---------------------------------------------------------


def test_scores_by_hand(spark):
    """The machine's score of every text, term by term and pair by pair."""
    rows, labels = toxic_rows(300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    place = {int(b): i for i, b in enumerate(machine.bucket)}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, machine).collect()}
    for doc_id, text in rows[::7]:
        data = np.frombuffer(text.encode(), np.uint8)
        buckets = toxicity._terms(data, np.array([0, len(data)]))[0]
        terms = sorted({place[int(b)] for b in buckets if int(b) in place})
        logit = machine.bias + sum(machine.weight[t] for t in terms)
        for n, i in enumerate(terms):
            for j in terms[n + 1 :]:
                logit += sum(float(a) * float(b) for a, b in zip(machine.factor[i], machine.factor[j]))
        assert got[doc_id] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, logit)))), abs=1e-9)


def test_languages_by_hand(spark):
    """The nearest centroid of every text, from counts of its n-grams in a dictionary."""
    rows = language_rows(150)
    df = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, source string")
    model = language_id.train(df)
    got = {r["doc_id"]: r for r in language_id.language_id(df).collect()}
    for doc_id, text, _ in rows[::5]:
        raw = [b if chr(b).isalpha() or b >= 128 else 32 for b in text.lower().encode()]
        counts: Counter = Counter()
        for n in language_id.NGRAMS:
            for a in range(len(raw) - n + 1):
                word = int.from_bytes(bytes(raw[a : a + n]), "big") + (n << 40)
                counts[int(mix(np.array([word], np.uint64))[0]) % language_id.DIMS] += 1
        x = {d: math.log1p(c) * float(model.idf[d]) for d, c in counts.items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        near = [sum(v / length * float(center[d]) for d, v in x.items()) for center in model.center]
        best = max(near)
        assert got[doc_id]["score"] == pytest.approx(best, abs=1e-4)
        assert got[doc_id]["lang_pred"] in {model.languages[i] for i, s in enumerate(near) if s > best - 1e-5}
        assert got[doc_id]["rejected"] == (best < model.radius[near.index(best)]) or abs(best - model.radius[near.index(best)]) < 1e-4


def test_a_vocabulary_of_weights(spark):
    """Thousands of terms from a table: weights of distinct terms add up, repeats and parts of words do not count."""
    terms = [(f"w{i}", 0.4) for i in range(5000)] + [("Bad", 1.0), ("bad", 0.2), ("", 9.0), (None, 9.0), ("null", None), ("w1x", 0.7)]
    vocabulary = spark.createDataFrame(terms, "term string, weight double")
    urls = ["http://x.net/bad", "http://x.net/w1/w1/w1", "http://x.net/w1-w2", "http://x.net/w1/w2/w4999", "http://x.net/w1x.w7", "http://x.net/badly", None, "http://x.org/bad", "http://x.net/w1/w2/w4999"]
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = Counter((r["page_id"], r["verdict"], r["rule"]) for r in url_filter.url_filter(pages, vocabulary=vocabulary, limit=1.0).collect())
    assert got == Counter([(None, "block", None), (1, "allow", None), (2, "allow", None), (3, "block", None), (4, "block", None), (5, "allow", None), (6, "allow", None), (7, "allow", "org/"), (8, "block", None)])
    assert {r["verdict"] for r in url_filter.url_filter(pages.where("page_id <> 7"), vocabulary=vocabulary.where("false")).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_filter.weights_of(spark.range(url_filter.MOST_TERMS + 1).selectExpr("string(id) AS term", "1.0 AS weight"))


def test_more_languages_than_are_learned(spark):
    rows = [(i, f"der die das und {i} nicht ist " * 3, "de") for i in range(40)] + [(100 + i, f"the and of is {i} not with " * 3, "en") for i in range(30)]
    rows += [(1000 + i, f"junk {i} words", f"x{i}") for i in range(50)]
    got = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=2, most_rows=30)
    assert set(got.languages) == {"de", "en"}
