"""Exact ranking and calibration metrics from score histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligra.operators.match import PairScores
from eligra.operators.pair_blocks import Measure
from eligra.operators.ranking import exact_quantiles, running_totals, top_k
from eligra.session import default_salt, salted_join

CALIBRATION_BINS = 15
PROBABILITY_CLIP = 1e-7


def histogram(rows: DataFrame, groups: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score."""
    return rows.groupBy(*groups, F.col(score).alias("score")).agg(
        F.sum(F.col(y).cast("bigint")).alias("n_pos"), F.sum(1 - F.col(y).cast("bigint")).alias("n_neg"))


def curve_metrics(hist: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half), step-wise average precision, prevalence and lift per group.

    AUC is null with a single class, AP without a positive.
    """
    cum = running_totals(hist, ["n_pos", "n_neg"], groups=groups)
    # Positives ranked above each negative, ties half: the Mann-Whitney count.
    wins = F.col("n_neg") * (F.col("cum_n_pos") - F.col("n_pos") / 2)
    precision = F.col("cum_n_pos") / (F.col("cum_n_pos") + F.col("cum_n_neg"))
    agg = [F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.sum(wins).alias("_wins"),
           F.sum(F.col("n_pos") * precision).alias("_ap")]
    df = cum.groupBy(*groups).agg(*agg)
    return df.select(
        *groups, "n_pos", "n_neg",
        F.try_divide(F.col("_wins"), F.col("n_pos") * F.col("n_neg")).alias("roc_auc"),
        F.try_divide(F.col("_ap"), F.col("n_pos")).alias("average_precision"),
        (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("prevalence"),
    ).withColumn("lift", F.try_divide(F.col("average_precision"), F.col("prevalence")))


def improvement_pct(base: Column, full: Column) -> Column:
    return 100 * (full - base) / F.greatest(base, F.lit(0.001))


def _discount_sums(k: int) -> list[float]:
    sums = [0.0]
    for i in range(1, k + 1):
        sums.append(sums[-1] + 1.0 / math.log2(i + 1))
    return sums


def _discount_sum(upto: Column, k: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in _discount_sums(k)]), F.least(upto, F.lit(k)).cast("int") + 1)


def group_sizes(rows: DataFrame, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum("y").alias("n_pos"))


def top_k_metrics(rows: DataFrame, group: str, item: str, ks: Sequence[int]) -> DataFrame:
    """precision@k, recall@k, NDCG@k and delta-SFR@k per group that has a positive.

    Ranked by score, ties by ``item``. Only the first max(ks) rows of a group are shuffled.
    """
    best = top_k(rows.select(group, item, "y", "score"), [group], [F.desc("score"), F.asc(item)], max(ks))
    gains = []
    for k in ks:
        hit = (F.col("rank") <= k) & (F.col("y") == 1)
        gains += [F.count_if(hit).alias(f"_hits_{k}"),
                  F.coalesce(F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias(f"_dcg_{k}")]
    df = group_sizes(rows, group).join(best.groupBy(group).agg(*gains), group).where("n_pos > 0")
    out = [group]
    for k in ks:
        precision = F.col(f"_hits_{k}") / F.least(F.lit(k), F.col("n"))
        out += [
            precision.alias(f"precision_at_{k}"), (F.col(f"_hits_{k}") / F.col("n_pos")).alias(f"recall_at_{k}"),
            (F.col(f"_dcg_{k}") / _discount_sum(F.least(F.col("n_pos"), F.lit(k)), k)).alias(f"ndcg_at_{k}"),
            (precision - F.col("n_pos") / F.col("n")).alias(f"delta_sfr_at_{k}"),
        ]
    return df.select(*out)


def tied_ndcg(rows: DataFrame, group: str, k: int) -> DataFrame:
    """NDCG@k that shares the gain evenly inside a block of equal scores."""
    hist = histogram(rows, [group]).withColumn("m", F.col("n_pos") + F.col("n_neg"))
    cum = running_totals(hist, ["m"], groups=[group])
    before = F.col("cum_m") - F.col("m")
    gain = F.col("n_pos") / F.col("m") * (_discount_sum(F.col("cum_m"), k) - _discount_sum(before, k))
    return (
        cum.groupBy(group).agg(F.sum(gain).alias("_dcg"), F.sum("n_pos").alias("n_pos")).where("n_pos > 0")
        .select(group, (F.col("_dcg") / _discount_sum(F.col("n_pos"), k)).alias(f"ndcg_at_{k}"))
    )


def reciprocal_rank(rows: DataFrame, group: str, item: str, salt: int | None = None) -> DataFrame:
    """1 / rank of the first positive per group: find it, then count the rows ahead of it."""
    key = F.struct((-F.col("score")).alias("s"), F.col(item).alias("i"))
    first = rows.where("y = 1").groupBy(group).agg(F.min(key).alias("_first"))
    salt = default_salt(rows.sparkSession) if salt is None else salt
    ahead = salted_join(rows, first, [group], salt, [item])
    return ahead.groupBy(group).agg((1 / (1 + F.count_if(key < F.col("_first")))).alias("mrr"))


def grouped_metrics(rows: DataFrame, group: str, item: str, ks: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """Means over the groups with a positive, and how many groups that is."""
    auc = curve_metrics(histogram(rows, [group]), [group]).where("n_pos > 0").select(group, "roc_auc", "average_precision")
    df = auc.join(top_k_metrics(rows, group, item, ks), group).join(reciprocal_rank(rows, group, item), group)
    means = [F.avg(c).alias(c) for c in df.columns if c != group and not c.startswith("delta_sfr")]
    total = group_sizes(rows, group).agg(F.count("*")).scalar()
    return df.agg(*means, F.count("*").alias("n_groups_used")).withColumn("n_groups_total", total)


def retrieval_metrics(rows: DataFrame, group: str, item: str, ks: Sequence[int] = (10, 20, 50)) -> DataFrame:
    """Mean precision, tie-averaged NDCG and screen-failure reduction at each k over usable groups."""
    top = top_k_metrics(rows, group, item, ks).drop(*[f"ndcg_at_{k}" for k in ks], *[f"recall_at_{k}" for k in ks])
    for k in ks:
        top = top.join(tied_ndcg(rows, group, k), group)
    return top.agg(*[F.avg(c).alias(c) for c in top.columns if c != group], F.count("*").alias("n_trials_used"))


def calibration(rows: DataFrame, groups: Sequence[str] = (), p: str = "score", n_bins: int = CALIBRATION_BINS) -> DataFrame:
    """Brier score, expected calibration error, mean prediction and mean label."""
    clipped = F.greatest(F.least(F.col(p), F.lit(1 - PROBABILITY_CLIP)), F.lit(PROBABILITY_CLIP))
    df = rows.withColumn("_p", clipped).withColumn("_b", F.least(F.floor(F.col("_p") * n_bins), F.lit(n_bins - 1)))
    per_bin = df.groupBy(*groups, "_b").agg(
        F.count("*").alias("_n"), F.sum("_p").alias("_sp"), F.sum("y").alias("_sy"),
        F.sum((F.col("_p") - F.col("y")) ** 2).alias("_sq"))
    n = F.sum("_n")
    return per_bin.groupBy(*groups).agg(
        (F.sum("_sq") / n).alias("brier"), (F.sum(F.abs(F.col("_sy") - F.col("_sp"))) / n).alias("ece"),
        (F.sum("_sp") / n).alias("mean_pred"), (F.sum("_sy") / n).alias("mean_label"))


def strict_accuracy(rows: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Agreement of ``score >= threshold`` with a known 0/1 label; unknown labels do not count."""
    known = rows.where(F.col("y").isNotNull())
    return known.agg(F.avg(((F.col("score") >= threshold).cast("int") == F.col("y")).cast("double")).alias("accuracy"),
                     F.count("*").alias("n_assessable"))


def strict_agreement(scores: PairScores, patients: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``strict_accuracy`` of M_inc against the strict match over all pairs of trials with something to assess; no pair is a row.

    scores: those of ``match.strict_scores``.
    """
    n_patients = patients.agg(F.count("*")).scalar()
    right = (F.col("m_inc") >= threshold) == F.col("matched")
    hit = scores.by_trial([Measure("n_right", f"cast((m_inc >= {threshold}) = matched as int)", lambda have, trial: (have["m_inc"] >= threshold) == have["matched"])])
    known = scores.defaults.where("matched is not null").select("trial_id", right.cast("int").alias("right")).join(hit, "trial_id", "left")
    rest = n_patients - F.coalesce("n", F.lit(0))
    n_pairs = F.count("*") * n_patients
    return known.agg(F.try_divide(F.sum(F.coalesce("n_right", F.lit(0)) + F.col("right") * rest), n_pairs).alias("accuracy"), n_pairs.alias("n_assessable"))


def strict_sweep(rows: DataFrame) -> DataFrame:
    """Accuracy at each whole percentile of the scores (a hindsight diagnostic).

    Rows are first counted by how many thresholds they reach, 100 classes in all.
    """
    known = rows.where(F.col("y").isNotNull())
    cuts = exact_quantiles(known, "score", [i / 100 for i in range(1, 100)])
    edges = cuts.agg(F.array_sort(F.collect_list("quantile"))).scalar()
    reached = (
        known.withColumn("_edges", edges)
        .withColumn("_reach", F.size(F.filter("_edges", lambda e: e <= F.col("score"))))
        .groupBy("_reach").agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"))
    )
    classes = reached.agg(F.collect_list(F.struct("_reach", "n_pos", "n_neg"))).scalar()
    right = F.aggregate("_classes", F.lit(0).cast("bigint"), lambda acc, c: acc + F.when(
        c["_reach"] >= F.col("_at"), c["n_pos"]).otherwise(c["n_neg"]))
    total = F.aggregate("_classes", F.lit(0).cast("bigint"), lambda acc, c: acc + c["n_pos"] + c["n_neg"])
    # A row reaches a threshold when it reaches every equal or lower one.
    at = cuts.withColumn("_edges", edges).withColumn("_classes", classes).withColumn(
        "_at", F.size(F.filter("_edges", lambda e: e <= F.col("quantile"))))
    return at.select("prob", F.col("quantile").alias("threshold"), (right / total).alias("accuracy"))
