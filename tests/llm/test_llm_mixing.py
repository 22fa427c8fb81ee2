"""Targets against plain water filling; balance, bounds and reruns of the sample."""

import random

import numpy as np
import pytest

from eligra.llm import mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if cap * sizes[s] <= level * weight[s]]
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            open_.discard(s)
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, "w " * int(rng.paretovariate(1) * 20), f"s{i % 7}" if i % 7 else None) for i in range(1500)]
    rows += [(None, "a b c", "s1"), (None, "a b c", "s1"), (5000, None, "s2"), (5001, "", "empty"), (5002, "x " * 30_000, "Ähre"), (3, rows[3][1], rows[3][2])]
    return spark.createDataFrame([(*r, 0, 1.0) for r in rows], "doc_id long, text string, source string, copies int, target double").repartition(7)


def test_targets_sizes_and_bounds(docs):
    rows = mixing.decide(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = plain_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        if s not in ("Ähre", "empty"):  # one document each
            assert taken[s] == pytest.approx(t, rel=0.02)


def test_small_blocks_meet_in_levels_and_reruns_agree(docs):
    a, b = (sorted(map(tuple, mixing.decide(d, block=50).collect()), key=str) for d in (docs, docs.repartition(3)))
    assert a == b
    rows = [r for r in a if r[2] == "s3"]
    assert sum(r[7] for r in rows) == pytest.approx(rows[0][5], rel=0.02)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    p, x = rng.random(500).tolist(), rng.integers(0, 50, 500).tolist()
    before = sum(p), sum(a * b for a, b in zip(p, x))
    left = mixing.flight(p, x, rng)
    assert len(left) <= 2 and all(v in (0.0, 1.0) for i, v in enumerate(p) if i not in left)
    assert (sum(p), sum(a * b for a, b in zip(p, x))) == pytest.approx(before)


def test_expected_inclusion():
    hits = np.zeros(40)
    for seed in range(400):
        p, x = [0.3] * 40, list(range(40, 0, -1))
        left = mixing.flight(p, x, np.random.default_rng(seed))
        hits += [0.3 if i in left else v for i, v in enumerate(p)]
    assert abs(hits / 400 - 0.3).max() < 0.12


def test_mix_returns_rows_taken(docs):
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copies_", "target_"]
    assert out.count() == mixing.decide(docs).where("copies > 0").count()


def test_empty_table(docs):
    assert mixing.decide(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.decide(docs.where("source = 'empty'")).first().taken == 0
