"""Repeated byte strings against counting every one of them; the merge against sorting."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from eligra.llm import suffix_dedup as sd


def plain(texts):
    count = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i:i + 200]] > 1:
                mark[i:i + 200] = True
        spans = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        out.append((len(t), int(mark.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~mark])).hexdigest()))
    return out


def rows():
    rng = random.Random(4)

    def noise(n):
        return "".join(rng.choices("ab cdéf", k=n))

    shared = [noise(n) for n in (150, 180, 199, 200, 201, 215, 260, 400, 900)]
    out = []
    for i in range(120):
        t = noise(rng.randint(0, 500))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            t += p[rng.randint(0, 40):len(p) - rng.randint(0, 40)] + noise(rng.randint(0, 300))
        out.append((i, t))
    return out + [(1000, None), (1001, ""), (1002, "x" * 1000), (1003, "x" * 250), (1004, "ab" * 300), (1005, out[3][1]), (1006, "é" * 150), (None, noise(900)), (7, out[7][1]),
                  (1007, noise(60_000) + shared[7])]


@pytest.mark.parametrize("crowd", [sd.CROWD, 3])
def test_equals_counting(spark, monkeypatch, crowd):
    monkeypatch.setattr(sd, "CROWD", crowd)
    monkeypatch.setattr(sd, "RUN", 50)
    data = rows()
    want = sorted(((d, *r) for (d, _), r in zip(data, plain([(t or "").encode() for _, t in data]))), key=str)
    docs = spark.createDataFrame([(d, t, 1, "b") for d, t in data], "doc_id long, text string, k1 int, body string").repartition(5)
    assert sorted(map(tuple, sd.remove_repeats(docs).collect()), key=str) == want


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert tuple(sd.remove_repeats(spark.createDataFrame([(1, None)], "doc_id long, text string")).first())[:4] == (1, 0, 0, 0)


def test_merge_equals_sorting():
    rng = random.Random(2)
    for k in (0, 1, 2, 3, 7):
        runs = [sorted(bytes(rng.choices(b"ab\x00", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        got = list(sd.merge([sd.front_code(r) for r in runs]))
        assert [s for _, _, s, _ in got] == sorted(s for r in runs for s in r)
        assert all(runs[r][p] == s for r, p, s, _ in got)
        before = b""
        for _, _, s, shared in got:
            assert shared == len(os.path.commonprefix([before, s]))
            before = s


def test_every_string_has_an_anchor_that_moves_with_it():
    rng = random.Random(6)
    core = bytes(rng.choices(b"abcdef", k=200))
    seen = set()
    for _ in range(20):
        low = rng.randint(0, 400)
        text = bytes(rng.choices(b"abcdef", k=low)) + core + bytes(rng.choices(b"abcdef", k=300))
        at, first, last = sd.anchors(np.frombuffer(text, np.uint8))
        k = int(np.flatnonzero((first <= low) & (low <= last))[0])
        seen.add(int(at[k]) - low)
    assert len(seen) == 1 and 0 <= seen.pop() < sd.REACH
