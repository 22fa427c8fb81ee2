"""Near copies of the pipeline's stage against shingle sets compared pair by pair."""

import random

import numpy as np
import pytest

import corpus_pipeline
from eligra.llm import near_copies


def plain_sets(texts):
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        out.append(frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    return out


def plain_kept(rows):
    sets, root = plain_sets([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def sample():
    rng = random.Random(8)
    vocabulary = [f"Wort{i}" for i in range(2_000)] + ["Äö", "naïve"]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE  two"), (5, "one three"), (6, "a b c d e"), (7, "a b c d f")]
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(40, 700))
        rows.append((100 + 10 * i, " ".join(words)))
        for k in range(4):  # similarity about 0.65 to 1
            copy = list(words)
            for p in rng.sample(range(len(copy)), int(len(copy) * 0.01 * k) + k):
                copy[p] = f"other{rng.random()}"
            rows.append((101 + 10 * i + k, "  ".join(copy)))
    base = rng.choices(vocabulary, k=300)  # a chain, each link similar to its neighbours only, and a crowd around one text
    for k in range(12):
        base = base[12:] + [f"new{k}-{i}" for i in range(12)]
        rows.append((2_000 + k, " ".join(base)))
    for k in range(80):
        copy = list(base)
        for p in rng.sample(range(300), rng.randint(1, 16)):
            copy[p] = f"crowd{k}-{p}"
        rows.append((3_000 + k, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [near_copies.CROWD, 2])
def test_stage_equals_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rows = sample()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, size int").repartition(4)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_substituted_words(spark):
    words = [f"w{i}" for i in range(400)]
    changed = [f"x{i}" if i in (40, 120, 200, 280, 360) else w for i, w in enumerate(words)]  # similarity 0.88
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [1]


def test_repeated_and_nameless_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "quite alone here ok then"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in near_copies.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, "a b c"), (None, "quite alone here ok then"), (2, None)], key=str)
    assert near_copies.keep_one(docs.where("false")).count() == 0


def test_stage_on_the_smallest_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want


def test_apart_lets_all_similar_sets_meet():
    """Random copies of a hub, small and large, with words lost, replaced and added: sets that are similar share a key by the rules of the crowd."""
    rng = np.random.default_rng(5)
    hub, met = np.sort(rng.choice(1 << 40, 150, replace=False).astype(np.uint64)), 0
    pools = [rng.choice(1 << 40, 60, replace=False).astype(np.uint64) + np.uint64(1 << 41) for _ in range(4)]
    sets = []
    for _ in range(260):
        pool = pools[rng.integers(4)]
        kept = hub[rng.permutation(150)[:rng.integers(90, 151)]] if rng.random() < 0.5 else hub[:rng.integers(100, 151)]
        sets.append(np.unique(np.concatenate([kept, pool[:rng.integers(0, 60)] if rng.random() < 0.7 else rng.choice(pool, rng.integers(0, 60))])))
    near = [near_copies.similar_enough(x, hub, 0.8) for x in sets]
    keys = [near_copies.apart(hub, x, n, 0.8) for x, n in zip(sets, near)]
    for i in range(len(sets)):
        for j in range(i):
            if near_copies.similar_enough(sets[i], sets[j], 0.8) and not (near[i] and near[j]) and not np.array_equal(sets[i], sets[j]):
                a, b = (keys[k][0] if near[i] or near[j] else keys[k][0][:keys[k][1]] for k in (i, j))
                assert len(np.intersect1d(a, b))
                met += 1
    assert met > 100 and 20 < sum(near) < 240


def test_last_bits_of_minima_are_counted():
    rng = np.random.default_rng(2)
    for share in (0.0, 0.5, 1.0):
        a, b = rng.integers(0, 1 << 32, (2, 128), dtype=np.uint32)
        b = np.where(rng.random(128) < share, a, b)
        assert near_copies.equal_minima(near_copies._last_bits(a), near_copies._last_bits(b)) == int(((a & 3) == (b & 3)).sum())


@pytest.mark.parametrize("rows", [4096, 9])
def test_a_crowd_gives_no_more_links_than_members(spark, monkeypatch, rows):
    """Copies around one text that are similar to few others: all pairs within a hub are tried, none of them is a row."""
    monkeypatch.setattr(near_copies, "CELL_ROWS", rows)
    rng = random.Random(3)
    base, sets = [f"w{i}" for i in range(250)], {}
    for k in range(60):
        words = list(base)
        for p in rng.sample(range(250), 18):
            words[p] = f"own{k // 2}-{p}" if rng.random() < 0.9 else f"x{rng.random()}"
        if k % 2:  # close to its predecessor, to others only through the base
            words = previous[:-2] + ["y", f"z{k}"]
        previous = words
        found = near_copies.shingles(" ".join(words))
        sets[k] = (" ".join(words), found)
    nodes = spark.createDataFrame([(k, len(f), near_copies._last_bits(near_copies.minima(f)), k) for k, (_, f) in sets.items()],
                                  "fp long, size int, last binary, text_hash long")
    texts = spark.createDataFrame([(k, t) for k, (t, _) in sets.items()], "text_hash long, text string")
    spokes = spark.createDataFrame([(1000, k, k) for k in sets], "hub long, fp long, root long")
    got = near_copies._crowd_links(spokes, nodes, texts, 5, 0.8).collect()
    want = {(i, j) for i in sets for j in range(i) if near_copies.similar_enough(sets[i][1], sets[j][1], 0.8)}

    def groups(pairs):
        root = {k: k for k in sets}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {k: new if r == old else r for k, r in root.items()}
        return {frozenset(k for k in root if root[k] == r) for r in root.values()}

    assert len(want) >= 30 and {(r.b, r.a) for r in got} <= want
    assert groups((r.a, r.b) for r in got) == groups(want)
    assert rows < 4096 or len(got) < len(sets)


def test_close_fingerprints_are_candidates(spark):
    """Chains of the SimHash find copies with a changed word; the fingerprint is the majority of the set's bits."""
    rng, texts = random.Random(6), []
    for i in range(30):
        words = [f"{i}-{rng.randrange(900)}" for _ in range(400)]
        texts += [" ".join(words), " ".join(words[:200] + ["changed"] + words[201:])]
    found = [near_copies.shingles(t) for t in texts]
    for f in found[:4]:
        bits = [sum(int(h) >> b & 1 for h in f) * 2 > len(f) for b in range(64)]
        assert near_copies.fingerprint(f) % (1 << 64) == sum(1 << b for b in range(64) if bits[b])
    assert near_copies.fingerprint(found[0][:0]) == 0
    sims = [near_copies.fingerprint(f) for f in found]
    nodes = spark.createDataFrame([(k, len(f), s) for k, (f, s) in enumerate(zip(found, sims))], "fp long, size int, sim long")
    got = {(min(r), max(r)) for r in near_copies.chained(nodes).collect()}
    near = {(i, j) for j in range(60) for i in range(j) if ((sims[i] ^ sims[j]) & (1 << 64) - 1).bit_count() <= 4}
    assert got == near and len({(i, i + 1) for i in range(0, 60, 2)} & got) >= 20
