"""Importance resampling against plain loops; ranks against sorting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from eligra.llm import importance as im


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, target, run=1, buckets=10_000):
    def bucket(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in bucket(x)), Counter(b for x in target for b in bucket(x))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for d, x in docs:
        found = bucket(x)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in found]
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * 10 // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def data():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "A1", "日本"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(5, docs[5][1])] * 60 + [(None, docs[9][1])] * 40 + [(900, None), (901, ""), (902, "?!"), (903, "w1 " * 50_000), (904, None)]
    return docs, [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(20)] + [None, ""]


def test_equals_plain_loops(spark):
    docs, target = data()
    df = spark.createDataFrame([(d, x, 1.0, 2) for d, x in docs], "doc_id long, text string, score double, _row int").repartition(6)
    items = spark.createDataFrame([(x,) for x in target], "text string")
    for run in (1, 2):
        got = im.resample(df, items, run=run)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, run)


def test_ranks_equal_sorting(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, rng.randint(-50, 50)]), rng.choice([None, rng.randint(0, 10)])) for _ in range(3000)]
    got = im.ranked(spark.createDataFrame(rows, "score long, k long").repartition(7), "score", "k").collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    assert [(r.score, r.k) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, "w " * 25)], "doc_id long, text string")
    assert im.resample(none, none).count() == 0
    assert [r["rank"] for r in im.resample(some, none).collect()] == [None, None]
