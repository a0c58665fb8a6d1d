"""Operators on single documents, pages and dialogues."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftspark.llm import chat_format, language_id, line_dedup, mixing, packing, toxicity, url_filter
from siftspark.llm.common import Scratch
from siftspark.llm.queries import oracle_sql, queries, tokenizer_file


def table(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns).repartition(3)


# --- packing --------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 6), max_size=15))))
def test_plan(case):
    capacity, lengths = case
    rows, bins = packing.plan(lengths, capacity), defaultdict(list)
    for size, n in lengths.items():
        own = rows[rows[:, 0] == size]
        for rank in range(n):
            _, first, base, each, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            bins[base + (rank - first) // each].append((offset + (rank - first) % each * size, size))
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= capacity and sum(3 * s > capacity for _, s in held) <= 2
    # largest first, best fit, one piece at a time
    gaps: list[int] = []
    for size in sorted((s for s, n in lengths.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= size), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - size)
    assert sorted(bins) == list(range(len(bins))) and len(bins) <= len(gaps) + 1


def test_pack(spark):
    from tokenizers import Tokenizer

    rng = random.Random(0)
    rows = [(i, " ".join(rng.choices(["one", "Two,", "drei!", "déjà", "x1"], k=rng.choice([1, 5, 30, 90, 400])))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, " \n "), (None, "one two"), (7, rows[7][1])]
    df = table(spark, [(*r, 1, 2) for r in rows], "doc_id long, text string, length int, salt int")
    got = packing.pack(df, tokenizer_file(), capacity=100).collect()
    tok = Tokenizer.from_file(tokenizer_file())
    want = Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for piece, a in enumerate(range(0, len(ids), 100)):
            want[i, piece, a, len(ids[a : a + 100]), zlib.crc32(ids[a : a + 100].tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) <= 1.05 * sum(r["length"] for r in got) / 100 + 1
    assert packing.pack(df.where("false"), tokenizer_file()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aZé .,'<|>\n\t5İß end of text", max_size=40))
def test_word_tokenizer(text):
    from tokenizers import Tokenizer

    global _TOKENIZERS
    try:
        fast, whole = _TOKENIZERS
    except NameError:
        fast, whole = _TOKENIZERS = packing.word_tokenizer(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    assert np.frombuffer(fast(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


# --- mixing ---------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Words to take of each source: shared by weight, the excess reshared until no source is above its limit."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: float(weights[i % len(weights)]) for i, (name, _) in enumerate(order)}
    size = {name: float(n) for name, n in order}
    total, out, free = share * sum(size.values()), {}, set(size)
    while free:
        each = total / sum(weight[s] for s in free)
        above = {s for s in free if each * weight[s] > most * size[s]}
        if not above:
            return out | {s: each * weight[s] for s in free}
        out |= {s: most * size[s] for s in above}
        total -= sum(out[s] for s in above)
        free -= above
    return out


def test_targets(spark):
    def targets(rows):
        got = mixing.targets(spark.createDataFrame(rows, "source string, source_size long"), Scratch(spark, "targets"))
        return {r["source"]: r["target"] for r in got.collect()}

    got = targets([("b", 100), (None, 10), ("a", 100)])
    assert sum(got.values()) == pytest.approx(315) and got[None] == 20 and got["a"] == pytest.approx(200) and got["b"] == pytest.approx(95)
    assert targets([]) == {} and targets([("a", 0)]) == {"a": 0.0}
    rng = random.Random(1)
    many = [(f"s{i:03d}", rng.choice([0, 1, 10, 100, 5000])) for i in range(90)]
    assert targets(many) == pytest.approx(plain_targets(many))


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice("abbbbb"), "x") for i in range(600)] + [(900, None, None, "x"), (901, "one two", None, "x")]
    rows += [rows[5]] * 3
    df = table(spark, rows, "doc_id long, text string, source string, position string")
    report = mixing.mix_report(df).collect()
    assert Counter(r["doc_id"] for r in report) == Counter(r[0] for r in rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in report:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert target == pytest.approx(plain_targets(list(sizes.items())))
    assert all(abs(taken[s] - target[s]) <= max(40, 0.01 * target[s]) for s in sizes)
    again = mixing.mix_report(df.repartition(7)).collect()
    assert Counter(map(str, again)) == Counter(map(str, report))
    mixed = mixing.mix(df)
    copies = Counter()
    for r in report:
        copies[r["doc_id"]] += r["copies"]
    assert mixed.columns == df.columns and Counter(r["doc_id"] for r in mixed.collect()) == +copies
    assert mixing.mix_report(df.where("false")).count() == 0 and mixing.mix(df.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_mix_is_near_its_targets(spark, seed):
    """Small sources, whose sizes are far apart: never off by more than the largest document, and by little as a rule."""
    rng = random.Random(seed)
    rows = [(i, "w " * int(rng.lognormvariate(4, 1.2)), f"s{i % 25}") for i in range(25 * 12)]
    report = mixing.mix_report(table(spark, rows, "doc_id long, text string, source string")).collect()
    taken, target, largest = Counter(), {}, Counter()
    for r in report:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    off = {s: abs(taken[s] - target[s]) for s in target}
    assert all(off[s] <= largest[s] for s in off)
    assert np.median([off[s] / target[s] for s in off]) < 0.03 and np.mean([off[s] / target[s] for s in off]) < 0.08


# --- lines ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("asks", [10_000, 3])
def test_lines(spark, monkeypatch, asks):
    monkeypatch.setattr(line_dedup, "ASKS", asks)
    rng = random.Random(4)
    pool = ["Common", " common\t", "COMMON", "rare", "", "  ", "É x", "é x"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 6)))) for i in range(40)] + [(50, None), (51, ""), (52, "tail\n"), (None, "common"), (3, "common\nown")]
    keys = [{line_dedup.line_key(x) for x in (t or "").split("\n")} for _, t in rows]
    counts = Counter(k for s in keys for k in s if k)
    df = table(spark, [(*r, 1) for r in rows], "doc_id long, text string, k1 int")
    got = line_dedup.line_dedup(df, least=10).collect()
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if counts[line_dedup.line_key(x)] < 10]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert Counter(map(tuple, got)) == Counter(want) and any(w[2] for w in want)
    assert line_dedup.line_dedup(df.where("false")).count() == 0


def test_lines_are_reversible(spark, tmp_path):
    a, b = table(spark, [(1, "x\ny"), (2, "x")]), table(spark, [(3, "y\ny\nz")])
    before = line_dedup.build(a, least=2)
    both = line_dedup.insert(before, b)
    assert sorted(r["n"] for r in both.counts.collect()) == [1, 2, 2]
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    again = line_dedup.delete(both, b)
    assert rows(again.counts) == rows(before.counts)

    def held(index):
        """Which of x, y and z the stored filters hold, and how many marks there are in all."""
        filters = {r["shard"]: line_dedup.CuckooFilter.of(r["marks"]) for r in index.filters.collect()}
        keys = [line_dedup.key_hash(k) for k in "xyz"]
        return [k2 % index.shards in filters and k1 in filters[k2 % index.shards] for k1, k2 in keys], sum(int((f.table > 0).sum()) for f in filters.values())

    assert held(before) == ([True, False, False], 1) and held(both) == ([True, True, False], 2) and held(again) == held(before)
    path = f"file://{tmp_path}/index"
    both.save(path)
    kept = {r["doc_id"]: r["kept"] for r in line_dedup.line_dedup(table(spark, [(7, "z\nY\nq"), (8, "z")]), index=line_dedup.LineIndex.load(spark, path)).collect()}
    assert kept == {7: "z\nq", 8: "z"}


def test_filters_that_overflow(spark):
    """A shard that grows far beyond its first filter, and back."""
    few, many = table(spark, [(1, "a\nb")]), table(spark, [(i, f"l{j}") for j in range(9000) for i in (2 * j, 2 * j + 1)])
    before = line_dedup.insert(line_dedup.build(few, least=2), few)
    after = line_dedup.insert(before, many)
    filters = {r["shard"]: line_dedup.CuckooFilter.of(r["marks"]) for r in after.filters.collect()}
    keys = [line_dedup.key_hash(k) for k in ["a", "b", *(f"l{j}" for j in range(9000))]]
    assert all(k1 in filters[k2 % after.shards] for k1, k2 in keys) and sum(int((f.table > 0).sum()) for f in filters.values()) == len(keys)
    back = line_dedup.delete(after, many)
    assert sum(int((line_dedup.CuckooFilter.of(r["marks"]).table > 0).sum()) for r in back.filters.collect()) == 2


def test_cuckoo_filter():
    keys = [random.Random(i).getrandbits(64) - (1 << 63) for i in range(3000)]
    f = line_dedup.build_filter(keys)
    assert all(k in f for k in keys)
    for k in keys[:1500]:
        f.delete(k)
    assert all(k in f for k in keys[1500:]) and sum(k in f for k in keys[:1500]) < 30
    with pytest.raises(KeyError):
        line_dedup.build_filter([]).delete(5)
    small = line_dedup.CuckooFilter(4)
    with pytest.raises(OverflowError):
        for k in keys[:200]:
            small.add(k)


# --- urls -----------------------------------------------------------------------------------------


def test_urls(spark):
    cases = {
        "https://WWW.Free-Bets.example.net/en/1?x": ("www.free-bets.example.net", "/en/1", None, "block"),
        "http://casino.example.net": ("casino.example.net", "", None, "block"),
        "http://casinos.example.net/a": ("casinos.example.net", "/a", None, "allow"),
        "http://free.example.net/free": ("free.example.net", "/free", None, "allow"),
        "https://casino.example.com/fr/1": ("casino.example.com", "/fr/1", "com/fr/", "allow"),
        "https://x.com/de/1#a": ("x.com", "/de/1", "com/de/", "block"),
        "https://a.example.org/en/1": ("a.example.org", "/en/1", "example.org/en/1", "block"),
        "https://a.example.org/en/2": ("a.example.org", "/en/2", "org/", "allow"),
        "https://aexample.org": ("aexample.org", "", None, "allow"),
        "no scheme casino": ("", "", None, "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = table(spark, [(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert url_filter.url_filter(df.where("false")).count() == 0


# --- models ---------------------------------------------------------------------------------------


def language_rows(n=240):
    rng = random.Random(5)
    parts = {"en": ["the", "ing", "wh", "tion"], "de": ["sch", "ung", "ß", "ein"], "fr": ["que", "eau", "é", "oi"]}
    rows = []
    for i in range(n):
        lang = "en de fr".split()[i % 3]
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.choice([3, 40]))), lang))
    return rows


def test_language(spark):
    rows = language_rows() + [(900, None, "en"), (901, "12 !?", "de"), (902, "", None), (903, "the wh", None), (5, "sch ung", "de")]
    df = table(spark, [(*r, 0.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {(r["doc_id"], r["lang_pred"]): r for r in language_id.language_id(df).collect()}
    assert all((i, "und") in got and got[i, "und"]["score"] == 0 for i in (900, 901, 902))
    held = [(i, lang) for i, _, lang in rows[:240] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(h in got for h in held) >= 0.95 * len(held)
    assert all(got[h]["held_out"] and 0 <= got[h]["score"] <= 1 for h in held if h in got)
    assert {r["lang_pred"] for r in language_id.language_id(df.drop("lang").withColumnRenamed("score", "lang").withColumn("lang", df["text"].substr(0, 0)).where("false")).collect()} == set()


def toxic_rows(n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        w = rng.choices([f"w{j}ord" for j in range(200)], k=rng.choice([5, 60, 400]))
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["Grobble", "splunk"]) + rng.choice(["", "er", "ish", f"x{i}"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    rows += [(9000, None), (9001, ""), (5, "w1ord")]
    df = table(spark, [(*r, 1) for r in rows], "doc_id long, text string, label int")
    lab = spark.createDataFrame([*labels, (7777, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    caught = sum(r["predicted"] for r in held if truth[r["doc_id"]])
    assert caught >= 0.9 * sum(truth[r["doc_id"]] for r in held) and not sum(r["predicted"] for r in held if not truth[r["doc_id"]])
    machine = toxicity.train(df, lab)
    kept = toxicity.reject_toxic(df, machine)
    assert kept.columns == df.columns and 400 < kept.count() < 500
    none = toxicity.toxicity(df, lab.where("false")).collect()
    assert len(none) == len(rows) and not any(r["predicted"] for r in none)
    assert toxicity.score(df.where("false"), machine).count() == 0


def test_pairs_of_terms():
    """Two terms that are toxic only together: no sum of their own weights can say so."""
    rows, label = [], []
    for i in range(800):
        a, b = i % 2, i // 2 % 2
        rows.append(np.array([0] * a + [1] * b + [2 + i % 50], np.int64))
        label.append(a and b)
    m = toxicity.fit(rows, np.array(label), np.arange(52))
    score = lambda *terms: m.logits(np.array(terms), np.zeros(len(terms), int), 1)[0]
    assert score(0, 1) > 1 > 0 > max(score(0), score(1))
    assert score(0, 1) - score(0) > score(1) - m.bias + 0.5  # the pair adds to its parts
    found = [score(*r) > 0 for r in rows]
    assert found == [bool(x) for x in label]


def test_pairs_reach_the_machine(spark):
    """Words that are common in clean rows, and toxic only together, from the texts on."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(1600):
        a, b = i % 2, i // 2 % 2
        w = rng.choices(words, k=40) + ["grobble"] * a + ["folk"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, a & b))
    df, lab = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in toxicity.toxicity(df, lab).collect() if r["held_out"]]
    assert sum(t for _, t in held) > 100 and sum(p == t for p, t in held) >= 0.99 * len(held)
    some = table(spark, [(1, "grobble " + words[0]), (2, "folk " + words[0]), (3, "folk grobble " + words[0])])
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(some, toxicity.train(df, lab)).collect()} == {1: 0, 2: 0, 3: 1}


# --- dialogues ------------------------------------------------------------------------------------


def test_chat(spark):
    rows = [(1, 2, "bob", "hi <|end|>", 0), (1, 0, "system", "s", 0), (1, 1, "ann", None, 0), (2, 0, None, "alone", 0), (None, 1, "x", "y", 0), (3, 0, "system", "only", 0), (1, 3, "ann", "bye", 0)]
    df = table(spark, rows, "conv_id long, turn long, role string, text string, parts int")
    got = {(r["conv_id"], r["speaker"]): r for r in chat_format.chat_perspectives(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "x")}
    ann = got[1, "ann"]
    assert ann["rendered"] == "<|system|>\ns<|end|>\n<|assistant|>\n<|end|>\n<|user name=bob|>\nhi < |end|><|end|>\n<|assistant|>\nbye<|end|>\n"
    masked = [ann["rendered"][int(a) : int(b)] for a, b in (s.split("-") for s in ann["loss_spans"].split(","))]
    assert masked == ["<|end|>", "bye<|end|>"] and ann["n_loss_chars"] == sum(map(len, masked)) and ann["n_turns"] == 4
    assert chat_format.chat_perspectives(df.where("false")).count() == 0


def test_registry():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] and set(oracle_sql()) <= set(names)
