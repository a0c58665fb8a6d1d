"""Registered queries against their SQL on small tables with what the generated ones lack."""

from __future__ import annotations

import math

import duckdb
import pytest

from siftspark.plans.oracles import ORACLES
from siftspark.plans.queries import queries

FUSED = ["rrf_fuse", "rrf_identifiers", "hybrid_rrf", "rerank_head_tail", "thread_packs", "thread_spine", "citation_order", "search_smoke", "prompt_blocks", "audit_log"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents 0 to 59, and vectors of them and of as many that are not there."""
    root = tmp_path_factory.mktemp("tables")
    words = ["that the and boat", "der die und Haus", "que de la mer", "with nothing", "the sea"]
    docs = [(i, f"{words[i % 5]} {i}\n{words[i % 3]} again", "en de fr".split()[i % 3], f"src{i % 4}", 20) for i in range(60)]
    vectors = [(i, [math.cos(i), math.sin(i), math.cos(3 * i), *(0.01 * math.sin(i * j) for j in range(4, 18))], 0) for i in range(120)]
    frames = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "embeddings": (vectors, "vec_id long, embedding array<float>, label int"),
        "labels": ([(i, i % 2, i % 3) for i in range(0, 60, 4)], "doc_id long, quality int, toxic int"),
        "pages": ([(i, f"https://x.com/{i}", "<p>invoice 1234</p>" if i % 2 else "<p>none</p>") for i in range(30)], "page_id long, url string, html string"),
        "benchmark": ([(i, words[i % 5]) for i in range(12)], "item_id long, text string"),
        "conversations": ([(i // 3, i % 3, "ann", f'said "{i}" é ' + "long " * (i * 20)) for i in range(12)], "conv_id long, turn long, role string, text string"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{root}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{root}/{name}.parquet/*.parquet'")
    return f"file://{root}", con


def shown(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def same(spark, tables, name):
    root, con = tables
    got = queries()[name](spark, root)
    columns = sorted(got.columns)
    found = con.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in found.fetchall())
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    assert rows == want
    return rows


@pytest.mark.parametrize("name", FUSED)
def test_vectors_without_a_message_are_hits(spark, tables, name):
    rows = same(spark, tables, name)
    if name == "hybrid_rrf":
        assert len(rows) == 60  # three queries, twenty hits each
        assert any(int(r[1]) >= 60 for r in rows)  # columns by name: fts_rank, id, ...


@pytest.mark.parametrize("name", sorted(set(ORACLES) - set(FUSED) - {"stream_available_now", "stream_again"}))
def test_queries(spark, tables, name):
    same(spark, tables, name)
