"""Repeated word windows against looking every window up."""

import hashlib
import random
import re

import numpy as np
import pytest

from eligra.llm import substring_dedup as sd


def plain(rows):
    found = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, w in found:
        if d is not None:
            for i in range(len(w) - 49):
                key = tuple(w[i:i + 50])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in found:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if d is not None and least[tuple(w[i:i + 50])] < d:
                gone[i:i + 50] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def rows():
    rng = random.Random(8)

    def noise(n):
        return rng.choices("a b c dé F fé".split(), k=n)

    shared = [noise(n) for n in (30, 49, 50, 51, 60, 81, 130, 400)]
    out = []
    for i in range(150):
        words = noise(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            words += p[rng.randint(0, 12):len(p) - rng.randint(0, 12)] + noise(rng.randint(0, 70))
        out.append((i * 3 % 151, rng.choice(" \t\n").join(words)))
    passage = " ".join(shared[7])
    return out + [(None, passage), (None, passage), (900, None), (901, ""), (902, " \n "), (903, "x " * 300), (904, "x " * 300), (7, out[5][1]), (7, out[5][1]),
                  (905, " ".join(noise(60_000)) + " " + passage), (906, passage), (907, passage + " "), (908, "x " * 49)] + [
                      (1000 + k, f"p{k} " * 20 + " ".join(shared[5]) + f" q{k}" * 20) for k in range(90)]


def test_equals_looking_up(spark):
    data = rows()
    docs = spark.createDataFrame([(d, t, 1, "b") for d, t in data], "doc_id long, text string, k1 int, least string").repartition(5)
    got = sorted(map(tuple, sd.remove_repeats(docs).collect()), key=str)
    assert got == sorted(plain(data), key=str)
    assert sum(r[2] > 0 for r in got) > 100


def test_ids_of_another_type_and_empty_table(spark):
    text = " ".join(map(str, range(70)))
    got = {r.doc_id: r.n_removed for r in sd.remove_repeats(spark.createDataFrame([("b", text), ("a", "x " + text), ("c", text + " y")], "doc_id string, text string")).collect()}
    assert got == {"a": 0, "b": 70, "c": 70}
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_remainder_is_a_difference():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))
    assert sd.CORE + sd.PERIOD - 1 == sd.LENGTH and 2 * sd.ARM == sd.PERIOD - 1


@pytest.mark.parametrize("shift", range(31))
def test_equal_windows_share_an_anchor(shift):
    passage = " ".join(f"w{i}" for i in range(50)).encode()

    def cores(before):
        words = sd.Words(b"z " * before + passage + b" y" * 40)
        at = words.anchors()
        inside = at[(at >= before) & (at <= before + 30)]
        return set(words.slices(inside, inside + sd.CORE))

    assert cores(3) & cores(3 + shift)
