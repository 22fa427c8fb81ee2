"""Benchmark leaks: planted exact, changed and partial passages, decoys and odd rows."""

import random

import numpy as np
import pytest

from eligra.llm import decontamination as dc

RNG = random.Random(9)
WORDS = [f"w{i}" for i in range(400)]
ITEMS = {i: RNG.choices(WORDS, k=n) for i, n in enumerate((40, 55, 20, 15, 6, 1))}


def around(words):
    return " ".join(RNG.choices(WORDS, k=60) + words + RNG.choices(WORDS, k=60))


def changed(words, every):
    return [f"other{i}" if i % every == every - 1 else w for i, w in enumerate(words)]


DOCS = [
    (1, around(ITEMS[0]).upper().replace(" ", ", ")), (2, around(changed(ITEMS[0], 6))), (3, around(ITEMS[1][10:30])), (4, around(ITEMS[1][10:18])),
    (5, around(changed(ITEMS[1], 2))), (6, around(ITEMS[2])), (7, around(ITEMS[3])), (8, around(ITEMS[4])), (9, around(ITEMS[4][:5])), (10, None), (11, ""),
    (12, "?! ..."), (None, around(ITEMS[0])), (14, around(ITEMS[0]) + " " + around(ITEMS[2])), (15, " ".join(ITEMS[0])), (16, "x " * 200_000 + " ".join(ITEMS[1])),
    (1, around(ITEMS[3])), (15, " ".join(ITEMS[0])),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(d, t, "s", 5) for d, t in DOCS], "doc_id long, text string, seed string, item_id int").repartition(4)
    items = [(i, " ".join(w)) for i, w in ITEMS.items() if i < 5] + [(90, None), (91, ""), (0, " ".join(ITEMS[0]))]
    return docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


def test_finds_planted_overlaps_only(tables):
    got = {(r.doc_id, r.item_id) for r in dc.leaks(*tables).collect()}
    assert got == {(1, 0), (1, 3), (2, 0), (3, 1), (6, 2), (7, 3), (8, 4), (None, 0), (14, 0), (14, 2), (15, 0), (16, 1)}


def test_offsets(tables):
    row = next(r for r in dc.leaks(*tables).collect() if (r.doc_id, r.item_id) == (3, 1))
    assert (row.first_word, row.end_word, row.n_equal, row.item_words) == (60, 80, 20, 55)


def test_overlap_against_all_stretches():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, 2, n), rng.integers(0, 2, n)
        best = 0
        for i in range(n):
            for j in range(i + 1, n + 1):
                eq = (a == b)[i:j]
                if eq[0] and eq[-1] and eq.mean() >= 0.8 - 1e-9 and j - i >= 5:
                    best = max(best, j - i)
        got = dc.overlap(a, b, 5, 0.8)
        assert (got[1] - got[0] if got else 0) == best


def test_clean_keeps_the_rest_whole(tables):
    docs, items = tables
    out = dc.clean(docs, items)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [4, 5, 9, 10, 11, 12]


def test_empty_tables(tables):
    docs, items = tables
    assert dc.leaks(docs.where("false"), items).count() == 0
    assert dc.leaks(docs, items.where("false")).count() == 0
    assert dc.clean(docs, items.where("false")).count() == docs.count()


def test_masks_hit_every_overlap():
    """The best score (+1 for an equal word, -4 for another) of any sequence that no mask fits, worked out over all of them, is negative."""
    span = max(map(len, dc.MASKS))
    ids = np.arange(1 << span)
    free = np.ones(1 << span, bool)
    for mask in dc.MASKS:
        free &= (ids & int(mask, 2)) != int(mask, 2)

    def scores(start, upto):
        best = start
        for _ in range(upto):
            b = np.maximum(best[:1 << (span - 1)], best[1 << (span - 1):])
            best = np.full(1 << span, -10**6)
            best[0::2], best[1::2] = b - 4, b + 1
            best[~free] = -10**6
            yield best

    first = np.full(1 << span, -10**6)
    first[1] = 1
    for n, best in enumerate(scores(first, 200), start=2):
        assert n < 13 or best[1::2].max() < 0
    anywhere = [b.max() for b in scores(np.where(free, 0, -10**6), 60)]
    assert anywhere[59] < 0 and 3 * anywhere[59] + max(anywhere) < 0  # so longer ones are negative too


@pytest.mark.parametrize("same", [0.8, 0.7, 1.0])
def test_masks_of_whole_short_items(same):
    for n in range(1, 13):
        masks = [int(m, 2) for m in dc.whole_masks(n, same)]
        for bits in range(1 << n):
            if bits & 1 and bits >> (n - 1) and bits.bit_count() >= same * n - 1e-9:
                assert any(bits & m == m for m in masks)


@pytest.mark.parametrize(("least", "same"), [(13, 0.8), (9, 0.75)])
def test_equals_search_of_all_diagonals(spark, least, same):
    """Random substitutions up to the limit in passages of any length, short items too."""
    rng = random.Random(12)
    items = {i: rng.choices(WORDS, k=n) for i, n in enumerate([*range(3, 40), 60])}
    docs = {}
    for d in range(300):
        words = items[rng.choice(list(items))]
        n = rng.randint(min(13, len(words)), len(words))
        at = rng.randint(0, len(words) - n)
        part = list(words[at:at + n])
        for i in rng.sample(range(n), min(n, round(0.2 * n) + rng.randint(-1, 1)) if n > 4 else 0):
            part[i] = f"other{i}"
        docs[d] = rng.choices(WORDS, k=20) + part + rng.choices(WORDS, k=20)
    code = {w: k for k, w in enumerate(sorted({w for ws in [*items.values(), *docs.values()] for w in ws}))}
    want = set()
    for d, words in docs.items():
        a = np.array([code[w] for w in words])
        for i, item in items.items():
            b = np.array([code[w] for w in item])
            for diagonal in range(-len(b) + 1, len(a)):
                lo, hi = max(0, diagonal), min(len(a), diagonal + len(b))
                if dc.overlap(a[lo:hi], b[lo - diagonal:hi - diagonal], min(least, len(b)), same):
                    want.add((d, i))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(frame, tests, least=least, same=same).collect()} == want
