"""All pairs, hit or not: completion, sampling, splits and limits that are gone; ids as text."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from eligra.operators import graph as gr
from eligra.operators import labels as la
from eligra.operators import match as mt
from eligra.operators import report as rp
from eligra.operators import splits as sp
from eligra.operators import visits as vi


@pytest.fixture(scope="module")
def scores(spark):
    """150 trials with text ids, some without criteria that ask for anything; 60 patients."""
    rng = random.Random(2)
    pairs = [(p, f"NCT{t:08d}", rng.random(), rng.random()) for p in range(60) for t in range(150) if rng.random() < 0.2]
    defaults = [(f"NCT{t:08d}", 1.0 if t % 10 == 0 else 0.0, 0.9 if t % 25 == 0 else 0.0) for t in range(150)]
    made = mt.PairScores(spark.createDataFrame(pairs, "patient_id long, trial_id string, m_inc double, m_exc double"),
                         spark.createDataFrame(defaults, "trial_id string, m_inc double, m_exc double"))
    return la.label_pairs(made), {(p, t): (i, e) for p, t, i, e in pairs}, {t: (i, e) for t, i, e in defaults}


@pytest.fixture(scope="module")
def patients(spark):
    return spark.range(60).select(F.col("id").alias("patient_id"))


def dense(hits, defaults):
    return {(p, t): hits.get((p, t), defaults[t]) for p in range(60) for t in defaults}


def test_every_pair_once_with_its_score(scores, patients):
    labels, hits, defaults = scores
    rows = la.complete_pairs(labels, patients).collect()
    assert len(rows) == 60 * 150
    assert {(r.patient_id, r.trial_id): (r.m_inc, r.m_exc) for r in rows} == dense(hits, defaults)
    assert all(r.y == int(r.m_inc >= 0.15 and r.m_exc < 0.8) for r in rows)


def test_quadrants_are_not_thinned(scores, patients):
    labels, _, defaults = scores
    p = sp.partition_ids(patients, "patient_id", 0)
    t = sp.partition_ids(labels.defaults, "trial_id", 1)
    sizes = {r.quadrant: (r.n_pairs, r.n_pos) for r in sp.quadrant_sizes(labels, p, t).collect()}
    pairs = sp.split_pairs(labels, p, t)
    got = {r.quadrant: (r.n, r.y) for r in pairs.groupBy("quadrant").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()}
    assert got == sizes and set(got) == set(sp.QUADRANTS)
    assert sp.overlapping_pairs(pairs).count() == 0


def test_weak_pairs_and_hard_negatives_include_pairs_without_a_hit(scores, patients):
    labels, hits, defaults = scores
    full = dense(hits, defaults)
    weak = {(r.patient_id, r.trial_id) for r in la.weak_pairs(labels, patients, 0.3).collect()}
    assert weak == {k for k, (i, _) in full.items() if i >= 0.3}
    positives = patients.select("patient_id", F.lit("NCT00000000").alias("trial_id"))
    hard = {(r.patient_id, r.negative_trial_id) for r in la.hard_negatives(labels, positives).collect()}
    assert hard == {k for k, (i, e) in full.items() if i >= 0.15 and e >= 0.8 and k[1] != "NCT00000000"}


def test_round_robin_for_text_ids(scores, patients):
    labels, _, _ = scores
    rows = la.weak_pairs(labels, patients, 2.0).collect()
    assert sorted((r.patient_id, r.trial_id) for r in rows) == [(p, f"NCT{p:08d}") for p in range(60)]


@pytest.mark.parametrize("n_trials, n", [(150, 5), (6, 5), (5, 5), (3, 5), (1, 5), (64, 1)])
def test_random_negatives_always_give_n(spark, n_trials, n):
    trials = spark.createDataFrame([(f"NCT{t}",) for t in range(n_trials)], "trial_id string")
    pairs = spark.range(300).select(F.col("id").alias("patient_id"), F.concat(F.lit("NCT"), F.col("id") % n_trials).alias("trial_id"))
    rows = sp.random_negative_trials(pairs, trials, n, 4).collect()
    by_pair = {k: [r.negative_trial_id for r in g] for k, g in itertools.groupby(
        sorted(rows, key=lambda r: (r.patient_id, r.trial_id)), key=lambda r: (r.patient_id, r.trial_id))}
    want = min(n, n_trials - 1)
    assert len(by_pair) == (300 if want else 0)
    assert all(len(set(v)) == len(v) == want and k[1] not in v for k, v in by_pair.items())


def test_random_negatives_are_even(spark):
    trials = spark.range(20).select(F.col("id").alias("trial_id"))
    pairs = spark.range(4000).select(F.col("id").alias("patient_id"), F.lit(0).cast("long").alias("trial_id"))
    counts = {r.negative_trial_id: r["count"] for r in sp.random_negative_trials(pairs, trials, 5, 1).groupBy("negative_trial_id").count().collect()}
    assert set(counts) == set(range(1, 20)) and max(counts.values()) < 1.25 * min(counts.values())


@pytest.mark.parametrize("n_trials", [10, 150])
def test_training_trials_for_text_ids(scores, patients, n_trials):
    labels, hits, defaults = scores
    few = labels.defaults.where(F.col("trial_id") < f"NCT{n_trials:08d}")
    part = mt.PairScores(labels.pairs.where(F.col("trial_id") < f"NCT{n_trials:08d}"), few)
    rows = vi.training_trials(part, patients, 3, 3).collect()
    full = {k: v for k, v in dense(hits, defaults).items() if k[1] < f"NCT{n_trials:08d}"}
    for p in range(60):
        mine = [r for r in rows if r.patient_id == p]
        best = sorted((k[1] for k in full if k[0] == p), key=lambda t: (-full[(p, t)][0], t))[:3]
        assert sorted(r.trial_id for r in mine if r.role == "top") == sorted(best)
        assert len({r.trial_id for r in mine}) == 6


@pytest.mark.parametrize("members", [gr.LIST, 20])
def test_comorbidity_counts_codes_of_any_size(spark, monkeypatch, members):
    monkeypatch.setattr(gr, "LIST", members)
    monkeypatch.setattr(gr, "BLOCK", 100)
    rng = random.Random(3)
    rows = [(p, "common") for p in range(600)] + [(p, f"often{k}") for p in range(600) for k in range(70) if rng.random() < 0.15] + [(p, f"rare{rng.randrange(60)}") for p in range(600) for _ in range(3)]
    codes = {}
    for p, c in rows:
        codes.setdefault(p, set()).add(c)
    want = {(a, b, len(codes[a] & codes[b])) for a, b in itertools.permutations(codes, 2) if len(codes[a] & codes[b]) >= 2}
    got = gr.comorbidity_edges(spark.createDataFrame(rows, "subject_id long, icd10_code string"))
    assert {tuple(r) for r in got.collect()} == want


def test_wilcoxon_p_for_more_than_twelve_pairs(spark):
    d = [0.4, -0.1, 0.3, 0.2, 0.2, -0.5, 0.7, 0.6, 0.9, 1.0, 1.1, -0.3, 1.2, 1.3]
    got = rp.wilcoxon(spark.createDataFrame([(x,) for x in d], "d double")).first()
    order = sorted(abs(x) for x in d)
    rank = {v: sum(i + 1 for i, x in enumerate(order) if x == v) / order.count(v) for v in order}
    low = min(sum(rank[abs(x)] for x in d if x > 0), sum(rank[abs(x)] for x in d if x < 0))
    hits = sum(sum(r for r, bit in zip(map(rank.get, order), bits) if bit) <= low for bits in itertools.product((0, 1), repeat=len(d)))
    assert got.statistic == low and got.p_value == pytest.approx(min(1.0, 2 * hits / 2 ** len(d)))


def test_three_hundred_absence_exclusions(spark):
    crit = spark.createDataFrame([(1, i, "diagnosis", f"C{i}", "NOT_EXISTS", None, None, False, 0.5 + i / 1000) for i in range(300)] + [
        (1, 300, "diagnosis", "D", "EXISTS", None, None, True, 1.0)],
        "trial_id long, criterion_idx int, entity_type string, entity_code string, operator string, value double, max_value double, is_inclusion boolean, severity_weight double")
    codes = spark.createDataFrame([(7, "diagnosis", f"C{i}", None) for i in range(290, 300)], "patient_id long, entity_type string, code string, value double")
    row = mt.score_pairs(crit, codes, "L").pairs.first()
    assert row.m_exc == pytest.approx(0.5 + 289 / 1000)


def test_forced_salt_changes_nothing(spark):
    from eligra.plans.base import Inputs

    i = Inputs(spark, "/root/testdata/sf0.001")

    def rows():
        return sorted((r.patient_id, r.trial_id, round(r.m_inc, 9), round(r.m_exc, 9)) for r in i.scores("L").pairs.collect())

    plain = rows()
    spark.conf.set("eligra.salt", "4")
    try:
        assert rows() == plain
    finally:
        spark.conf.unset("eligra.salt")


@pytest.mark.parametrize("mode", ["mean", "sym"])
def test_neighbour_vectors_with_hubs(spark, monkeypatch, mode):
    monkeypatch.setattr(gr, "EDGES_AT_ONCE", 64)
    rng = random.Random(9)
    vectors = {f"n{i}": [rng.random() for _ in range(5)] for i in range(40)}
    edges = [("n0", f"n{rng.randrange(40)}") for _ in range(300)] + [(f"n{rng.randrange(45)}", "n1") for _ in range(300)]
    edges += [(f"n{rng.randrange(45)}", f"n{rng.randrange(50)}") for _ in range(200)]  # some ends have no vector
    out = {s: sum(e[0] == s for e in edges) for s, _ in edges}
    want = {}
    for d in {d for s, d in edges if s in vectors}:
        mine = [s for s, t in edges if t == d and s in vectors]
        scale = [1.0 if mode == "mean" else out[s] ** -0.5 for s in mine]
        want[d] = [sum(vectors[s][i] * w for s, w in zip(mine, scale)) / (len(mine) if mode == "mean" else len(mine) ** 0.5) for i in range(5)]
    got = gr.neighbor_mean(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(list(vectors.items()), "node string, vec array<double>"), mode, grid=3)
    assert {r.node: r.vec for r in got.collect()} == {d: pytest.approx(v) for d, v in want.items()}
