"""Exact neighbours by cells against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from siftspark.operators import vector

FIELDS = "message_id long, embedding array<float>"


def brute(held, queries, k):
    out = set()
    for q, v in queries:
        far = []
        for i, x in held:
            if x is not None:
                a, b = np.float32(v).astype(float), np.float32(x).astype(float)
                far.append((round(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), 12), i))
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(sorted(far)[:k])}
    return out


@pytest.mark.parametrize("block,cells", [(65_536, None), (7, 5), (65_536, 1)])
def test_cells_find_what_brute_force_finds(spark, tmp_path, monkeypatch, block, cells):
    monkeypatch.setattr(vector, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(12, 8))
    held = [(i, (centres[i % 12] + rng.normal(size=8) * 0.02).tolist()) for i in range(240)]
    held += [(900 + i, held[i][1]) for i in range(6)] + [(990, None)]  # copies, which tie, and a vector that is null
    queries = [(i, held[i][1]) for i in range(0, 240, 24)] + [(500, (-centres[0]).tolist()), (501, None)]
    made = vector.make_cells(spark.createDataFrame(held, FIELDS), f"file://{tmp_path}/rows", cells=cells)
    near, opened = vector.knn_cells(made, spark.createDataFrame(queries, "query_id long, v array<float>"), 9, f"file://{tmp_path}")
    got = {(r["query_id"], r["id"], r["vec_rank"]) for r in near.collect()}
    assert got == brute(held, queries[:-1], 9)
    share = [r["opened"] / len(made.counts) for r in opened.where("query_id < 500").collect()]
    assert len(share) == 10 and made.counts.sum() == 246
    if cells is None:
        assert max(share) < 0.5  # near vectors stand together, so most cells stay closed


def test_cells_of_few_or_none(spark, tmp_path):
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], FIELDS)
    asked = spark.createDataFrame([(7, [1.0, 0.1])], "query_id long, v array<float>")
    near, _ = vector.knn_cells(vector.make_cells(some, f"file://{tmp_path}/a"), asked, 50, f"file://{tmp_path}/an")
    assert [(r["id"], r["vec_rank"]) for r in near.orderBy("vec_rank").collect()] == [(1, 1), (2, 2)]
    near, _ = vector.knn_cells(vector.make_cells(some.where("false"), f"file://{tmp_path}/b"), asked, 50, f"file://{tmp_path}/bn")
    assert near.count() == 0
