"""SimHash components against brute force over all pairs."""

import random

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from eligra.llm import simhash
from eligra.llm.common import components


def plain_fingerprint(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(ids, prints, distance=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def sample():
    rng = random.Random(5)
    vocabulary = ["Wort%d" % i for i in range(300)] + ["Äö", "naïve"]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two three"), (6, "a b c d"), (None, "a b c d"), (None, "quite alone here ok then")]
    for i in range(30):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        rows.append((10 + 4 * i, " ".join(words)))
        for k in range(3):
            copy = list(words)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((11 + 4 * i + k, "  ".join(copy)))
    return rows + [rows[20], rows[20]] + [(999, "word " * 50_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([Row(doc_id=d, text=t, fp="x", key=1, component_id="y") for d, t in sample()], "doc_id long, text string, fp string, key int, component_id string")


def test_equals_brute_force(docs):
    rows = sample()
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, plain_components([d for d, _ in rows], prints))), key=str)
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == want


@pytest.mark.parametrize("bucket", [512, 1])
def test_links_lose_none_in_crowded_buckets(spark, bucket):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for _ in range(40):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 9)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {r.node: r.root for r in components(simhash.links(frame, 4, bucket)).collect()}
    want = plain_components([p - (1 << 64) if p >> 63 else p for p in prints], prints)
    assert [got.get(p - (1 << 64) if p >> 63 else p, p - (1 << 64) if p >> 63 else p) for p in prints] == want


def test_one_of_each_component_stays(docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    parts = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(set(parts.values()))
    assert kept.where("doc_id is null").count() == 1  # the one whose component has no other id


def test_empty_table(spark, docs):
    none = docs.where("false")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components(chain).select("root").distinct().collect() == [Row(root=0)]
