"""Recall and exact scores against brute force; vectors that take no part."""

import numpy as np
import pytest

from eligra.llm import neighbours as nn


def plain(ids, x, every, k):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = nn.inner(x, q)
            order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
            out[i] = [(d, -v) for v, d in order]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(8, 24))
    x = (centre[rng.integers(8, size=3000)] + rng.normal(size=(3000, 24)) * 0.6) * rng.uniform(0.5, 2, (3000, 1))
    x[200:260] = x[200]  # equal vectors: ties by id
    return list(range(3000)), x.astype(np.float32).astype(np.float64)


def frame(spark, ids, x):
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, list int").repartition(5)


def test_recall_and_order(spark, data):
    ids, x = data
    want = plain(ids, x, 20, 20)
    rows = nn.top(frame(spark, ids, x), per_list=150).collect()
    hits = 0
    for q in want:
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [m[1:] for m in mine] == sorted(((d, s) for _, d, s in mine), key=lambda p: (-p[1], p[0]))
        for _, d, s in mine:
            assert s == nn.inner(x[d:d + 1], x[q])[0]
        hits += len({d for d, _ in want[q]} & {m[1] for m in mine})
    assert hits / (20 * len(want)) >= 0.9


def test_all_lists_probed_in_small_blocks_is_exact(spark, data, monkeypatch):
    monkeypatch.setattr(nn, "LIST_ROWS", 100)
    monkeypatch.setattr(nn, "LIST_QUERIES", 7)
    ids, x = data[0][:800], data[1][:800]
    want = plain(ids, x, 20, 20)
    got = {}
    for r in sorted(nn.top(frame(spark, ids, x), per_list=200, probe=1.0, slack=50.0).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 1.0]),
            (20, [0.5, 0.5]), (8, []), (1, [9.0, 9.0]), (40, [0.0, 0.0])]
    got = nn.top(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2.0), (0, 2, 20, 0.5), (20, 1, 1, 1.5), (20, 2, 0, 0.5)]
    assert nn.top(spark.createDataFrame(rows[2:4], "vec_id long, embedding array<float>")).count() == 0
    assert nn.top(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_turns_are_exact_and_few_rows_come_back(spark, data, monkeypatch):
    """The first list bounds what cells give back: rows follow the queries, not queries times lists."""
    monkeypatch.setattr(nn, "LIST_ROWS", 100)
    ids, x = data
    came = []
    monkeypatch.setattr(nn, "GROWTH", 1)  # several turns
    want = plain(ids, x, 20, 20)
    got = {}
    for r in sorted(nn.top(frame(spark, ids, x), per_list=50, probe=1.0, slack=50.0).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    lifted, q = nn.lift(x, 20.0), x[:400:20]
    ql = np.concatenate([q, np.zeros((len(q), 1))], 1) @ nn.rotation(25)
    least = np.array([want[i][-1][1] for i in range(0, 400, 20)])
    best = (q * q).sum(1) + 400.0 - 2 * least
    for lo in range(0, 3000, 500):
        part = slice(lo, lo + 500)
        came.append(len(nn.search(np.arange(3000)[part], x[part], lifted[part], np.arange(0, 400, 20), q, ql, best.copy(), 20, 50.0, 20.0)[0]))
    ties = sum(sum(s == t for s in nn.inner(x, v)) for v, t in zip(q, least))
    assert sum(came) <= 20 * len(q) + ties < 6 * 20 * len(q)


def test_no_query_at_all(spark):
    assert nn.top(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(1, 15)], "vec_id long, embedding array<float>")).count() == 0
