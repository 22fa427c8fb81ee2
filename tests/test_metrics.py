"""Metrics, splits, resampling and models against plain Python or by invariant."""

import random

import pytest
from pyspark.sql import functions as F

from eligra.operators import features, graph, labels, match, metrics, models, ranking, report, resampling, splits


def auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(1)
    rows = [(g, int(rng.random() < 0.3), rng.randint(-9, 9) / 4) for g in range(3) for _ in range(60)] + [(9, 1, 0.5), (9, 1, 0.1)]
    df = spark.createDataFrame(rows, "g int, y int, score double")
    got = {r.g: r for r in metrics.curve_metrics(metrics.histogram(df, ["g"]), ["g"]).collect()}
    for g in range(3):
        assert got[g].roc_auc == pytest.approx(auc([(y, s) for k, y, s in rows if k == g]))
    assert got[9].roc_auc is None and got[9].average_precision == 1.0


def test_random_scores_ap_is_prevalence(spark):
    df = spark.range(50_000).withColumn("y", (F.col("id") % 50 == 0).cast("int"))
    scored = splits.random_scores(df, 4, ["id"])
    ap = metrics.curve_metrics(metrics.histogram(scored)).first().average_precision
    assert ap == pytest.approx(0.02, abs=0.01)


def test_cluster_interval_is_wider(spark):
    rng = random.Random(7)
    rows = []
    for t in range(20):
        shift = rng.gauss(0, 1)
        rows += [(t, t * 200 + i, int(rng.random() < 0.2), rng.gauss(0, 1) + shift) for i in range(200)]
    rows = [(t, i, y, s + (0.5 if y else 0.0) * (1 if t % 2 else 3)) for t, i, y, s in rows]
    df = spark.createDataFrame(rows, "t int, i int, y int, score double")
    wide = resampling.cluster_bootstrap_ci(df, "t", n_boot=60).first()
    narrow = resampling.cluster_bootstrap_ci(df, "i", n_boot=60).first()
    assert wide.roc_auc_hi - wide.roc_auc_lo > narrow.roc_auc_hi - narrow.roc_auc_lo
    few = resampling.cluster_bootstrap_ci(df, "t", n_boot=10).first()
    assert few.roc_auc_lo is None


def test_bootstrap_draws_are_whole(spark):
    draws = resampling.bootstrap_draws(spark.range(11).withColumnRenamed("id", "t"), "t", 30, 1)
    assert {r.n for r in draws.groupBy("draw").agg(F.sum("times").alias("n")).collect()} == {11}


def test_paired_bootstrap(spark):
    rng = random.Random(2)
    rows = [(i % 8, y, y + rng.random(), rng.random()) for i in range(400) for y in [int(rng.random() < 0.4)]]
    df = spark.createDataFrame(rows, "t int, y int, good double, bad double")
    test = resampling.paired_bootstrap_test(df, "t", "good", "bad", n_boot=50).first()
    assert test["diff"] > 0.3 and test.p_value < 0.05 and test.ci_lo > 0
    sign = resampling.sign_bootstrap(df, "t", "bad", "good", n_boot=50).first()
    assert sign.diff_lo > 0 and sign.p_value == 0.0
    three = {r.name: r for r in resampling.three_way_bootstrap(df, "t", ["good", "bad"], n_boot=30).collect()}
    assert three["good"].lo == pytest.approx(1.0) and three["bad"].hi < 0.7


def test_positions_and_quantiles(spark):
    rng = random.Random(3)
    xs = [rng.gauss(0, 5) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = {r.prob: r.quantile for r in ranking.exact_quantiles(df, "v", [0.0, 0.25, 0.5, 1.0]).collect()}
    s = sorted(xs)
    at = lambda q: s[int(q * 499)] + (s[min(int(q * 499) + 1, 499)] - s[int(q * 499)]) * (q * 499 - int(q * 499))
    assert all(got[q] == pytest.approx(at(q)) for q in got) and len(got) == 4
    pos = [r.pos for r in ranking.shuffled_position(spark.range(300), ["id"], 1).collect()]
    assert sorted(pos) == list(range(300))


def test_split_sizes_and_disjoint(spark):
    parts = splits.partition_ids(spark.range(101).withColumnRenamed("id", "p"), "p", 0)
    assert {r.split: r["count"] for r in parts.groupBy("split").count().collect()} == {"train": 71, "val": 15, "test": 15}
    assert splits.overlapping_ids(parts, "p").count() == 0
    other = splits.partition_ids(spark.range(101).withColumnRenamed("id", "p"), "p", 1)
    assert parts.where("split = 'train'").intersect(other.where("split = 'train'")).count() < 71
    again = splits.partition_ids(spark.range(101).repartition(5).withColumnRenamed("id", "p"), "p", 0)
    assert parts.exceptAll(again).count() == 0


def test_random_negatives(spark):
    pairs = spark.createDataFrame([(p, p % 4) for p in range(50)], "patient_id int, trial_id int")
    trials = spark.createDataFrame([(t,) for t in range(9)], "trial_id int")
    got = splits.random_negative_trials(pairs, trials, 5, 3)
    per = got.groupBy("patient_id").agg(F.countDistinct("negative_trial_id").alias("n"), F.count_if(F.col("negative_trial_id") == F.col("trial_id")).alias("own")).collect()
    assert {(r.n, r.own) for r in per} == {(5, 0)} and len(per) == 50


def test_round_robin_when_nothing_matches(spark):
    crit = spark.createDataFrame([(t, 0, "diagnosis", "ZZZ", "EXISTS", None, None, True, 1.0) for t in (4, 7, 9)],
                                 "trial_id int, criterion_idx int, entity_type string, entity_code string, operator string, value double, max_value double, is_inclusion boolean, severity_weight double")
    codes = spark.createDataFrame([(p, "diagnosis", "A", None) for p in range(5)], "patient_id int, entity_type string, code string, value double")
    patients = codes.select("patient_id")
    got = sorted(tuple(r) for r in labels.weak_pairs(match.score_pairs(crit, codes, "A"), patients).collect())
    assert got == [(0, 4), (1, 7), (2, 9), (3, 4), (4, 7)]


def test_graph_guard_fires(spark):
    edges = spark.createDataFrame([("x", "patient", "1", "trial", "2"), ("y", "patient", "1", "code", "2")],
                                  "relation string, src_type string, src string, dst_type string, dst string")
    assert graph.patient_trial_edges(edges).count() == 1


def test_comorbidity_group_limits(spark):
    dx = spark.createDataFrame([(p, c) for c in ("A", "B") for p in (1, 2, 3)] + [(p, "BIG") for p in range(1, 8)] + [(1, "ONE")], "subject_id int, icd10_code string")
    got = sorted((r.src, r.dst, r.n_shared) for r in graph.comorbidity_edges(dx, max_group=5).collect())
    assert got == [(a, b, 2) for a in (1, 2, 3) for b in (1, 2, 3) if a != b]


def test_wilcoxon_five_seeds(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,), (0.5,)], "d double")
    r = report.wilcoxon(df).first()
    assert (r.statistic, r.p_value, r.min_attainable_p) == (0.0, 0.0625, 0.0625)


def test_features_and_models(spark):
    """Honest features learn an easy rule; every registered model fits and scores."""
    rng = random.Random(4)
    rows = [(p, t, int((p % 5) == (t % 5)), [float(p % 5 == t % 5) + rng.gauss(0, 0.2), rng.random(), rng.random()]) for p in range(40) for t in range(6)]
    from pyspark.ml.functions import array_to_vector

    df = spark.createDataFrame(rows, "patient_id int, trial_id int, y int, f array<double>").withColumn("features", array_to_vector("f")).drop("f")
    df = df.withColumn("quadrant", F.lit("test")).cache()
    for name in models.resolve(["linear", "ranker", "random_forest", "heuristic"]):
        params = {"trees": 5, "depth": 3} if name == "random_forest" else {}
        scored = models.REGISTRY[name].fit(df, None, seed=0, **params).transform(df)
        ap = models.average_precision(scored)
        assert ap > (0.9 if models.REGISTRY[name].group in ("linear", "ranker", "tree") else 0.1)
    result = models.run_benchmark(["logreg_l2", "trial_prior"], {("honest", 0): {"train": df, "val": df, "eval": df}})
    assert result.count() == 2 and result.where("error is not null").count() == 0


def test_sparse_vector_form(spark):
    df = spark.createDataFrame([(1, [(0, 1.5), (4, -2.0)])], "k int, entries array<struct<idx:int,value:double>>")
    v = df.select(features.to_sparse_vector(F.col("entries"), 6).alias("v")).first().v
    assert v.size == 6 and v.indices.tolist() == [0, 4] and v.values.tolist() == [1.5, -2.0]


def test_salted_join_equals_plain(spark):
    from eligra.session import salted_join

    big = spark.range(200).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k int, v string")
    for how in ("inner", "left"):
        assert salted_join(big, small, ["k"], 5, ["id"], how).exceptAll(big.join(small, ["k"], how)).count() == 0


def test_scores_that_lie_very_close(spark):
    """A million scores within 1e-9: bins stay even, and order statistics and prefix sums exact."""
    step = 2.0 ** -50
    df = spark.range(1_000_000, numPartitions=8).select((F.lit(0.5) + F.pmod(F.col("id") * 7919, F.lit(1_000_000)) * step).alias("score"), F.lit(1).alias("n"))
    sizes = [r["count"] for r in df.groupBy(ranking.range_bin(df, "score").alias("bin")).count().collect()]
    assert max(sizes) < 0.02 * 1_000_000 and sum(sizes) == 1_000_000
    got = {r.prob: r.quantile for r in ranking.exact_quantiles(df, "score", [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: 0.5, 0.5: 0.5 + 499_999.5 * step, 1.0: 0.5 + 999_999 * step}
    cum = ranking.running_totals(df, ["n"])
    assert cum.where(F.col("cum_n") != 1_000_000 - (F.col("score") - 0.5) / step).isEmpty()
