"""Eligibility labels and the statistics of the label table, from sparse pair scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eligra.operators.match import TAU_EXC, TAU_INC, Arrays, PairScores
from eligra.operators.pair_blocks import Measure
from eligra.operators.ranking import exact_quantiles, position, range_bin
from eligra.session import materialize

#: Trials whose scores travel together where pairs are spelled out.
TRIAL_BLOCK = 64


def is_eligible(tau_inc: float = TAU_INC, tau_exc: float = TAU_EXC) -> Column:
    return ((F.col("m_inc") >= tau_inc) & (F.col("m_exc") < tau_exc)).cast("int")


def label_pairs(scores: PairScores, tau_inc: float = TAU_INC, tau_exc: float = TAU_EXC) -> PairScores:
    """Add ``y`` to the pairs and to the per-trial default."""
    def arrays(have: Arrays) -> list[np.ndarray]:
        # What is no number counts as more than any, as in Spark.
        return [(~(have["m_inc"] < tau_inc) & (have["m_exc"] < tau_exc)).astype(np.int32)]

    return scores.with_columns({"y": is_eligible(tau_inc, tau_exc)}, ([T.StructField("y", T.IntegerType())], arrays))


#: Eligible pairs, and by how many those of a trial exceed its default, which stands beside the trial as y0.
POSITIVE = Measure("y_hit", "y", lambda have, trial: have["y"])
CHANGE = Measure("change", "y - y0", lambda have, trial: have["y"] - trial["y0"])


def trial_positives(labels: PairScores, patients: DataFrame) -> DataFrame:
    """Eligible patients per trial over the whole population, hit or not."""
    return _with_positives(labels, patients, labels.by_trial([POSITIVE]))


def _with_positives(labels: PairScores, patients: DataFrame, counted: DataFrame) -> DataFrame:
    n_patients = patients.agg(F.count("*")).scalar()
    hit = counted.select("trial_id", F.col("n").alias("n_hit"), "y_hit")
    df = labels.defaults.join(hit, "trial_id", "left").fillna({"n_hit": 0, "y_hit": 0})
    return df.withColumn("n_patients", n_patients).select(
        *labels.defaults.columns, "n_hit", "n_patients",
        (F.col("y_hit") + F.col("y") * (F.col("n_patients") - F.col("n_hit"))).alias("n_pos"))


def keep_informative_trials(labels: PairScores, patients: DataFrame, drop_without_inclusion: bool = True,
                            drop_constant: bool = True) -> PairScores:
    """Drop trials without usable inclusion criteria and trials whose label never varies."""
    kept = informative_trials(labels, patients, drop_without_inclusion, drop_constant).select(*labels.defaults.columns)
    return PairScores(lambda: labels.beside(trials=kept.select("trial_id")), kept)


def informative_trials(labels: PairScores, patients: DataFrame, drop_without_inclusion: bool = True,
                       drop_constant: bool = True) -> DataFrame:
    """``trial_positives`` of the trials that ``keep_informative_trials`` keeps."""
    df = trial_positives(labels, patients)
    if drop_without_inclusion:
        df = df.where("n_inc > 0")
    return df.where("n_pos > 0 and n_pos < n_patients") if drop_constant else df


def _default_labels(labels: PairScores) -> DataFrame:
    return labels.defaults.select("trial_id", F.col("y").alias("y0"))


def patient_positives(labels: PairScores, patients: DataFrame) -> DataFrame:
    """Eligible trials per patient: own hits plus the default-eligible trials not hit."""
    return _with_changes(labels, patients, labels.by_trial_and_patient([CHANGE], _default_labels(labels))[1])


def _with_changes(labels: PairScores, patients: DataFrame, counted: DataFrame) -> DataFrame:
    default_pos = labels.defaults.agg(F.coalesce(F.sum("y"), F.lit(0))).scalar()
    return (
        patients.select("patient_id").join(counted.select("patient_id", "change"), "patient_id", "left")
        .select("patient_id", (F.coalesce("change", F.lit(0)) + default_pos).alias("n_pos"))
    )


def label_stats(labels: PairScores, patients: DataFrame) -> DataFrame:
    """Prevalence and how positives spread over trials and patients."""
    trials, people = labels.by_trial_and_patient([POSITIVE, CHANGE], _default_labels(labels))
    by_trial = materialize(_with_positives(labels, patients, trials))
    median = exact_quantiles(by_trial, "n_pos", [0.5]).select("quantile").scalar()
    n_patients_any = _with_changes(labels, patients, people).agg(F.count_if(F.col("n_pos") > 0)).scalar()
    return by_trial.agg(
        F.count("*").alias("n_trials"), F.max("n_patients").alias("n_patients"), F.sum("n_pos").alias("n_pos"),
        (F.sum("n_pos") / F.sum("n_patients")).alias("prevalence"),
        F.count_if(F.col("n_pos") > 0).alias("trials_with_any"),
        F.count_if(F.col("n_pos") == F.col("n_patients")).alias("trials_with_all"),
        F.max("n_pos").alias("max_pos_per_trial"),
    ).withColumn("median_pos_per_trial", median).withColumn("patients_with_any", n_patients_any)


def score_histogram(labels: PairScores, patients: DataFrame, score: Column) -> DataFrame:
    """(score, n_pos, n_neg) over all patient x trial pairs; pairs without a hit count in bulk."""
    return histogram_of(score_counts(labels, patients), score)


def histogram_of(counts: DataFrame, score: Column) -> DataFrame:
    """(score, n_pos, n_neg) from ``score_counts``."""
    y, n = F.col("y"), F.col("n")
    return counts.groupBy(score.alias("score")).agg(F.sum(y * n).alias("n_pos"), F.sum((1 - y) * n).alias("n_neg"))


def score_counts(labels: PairScores, patients: DataFrame) -> DataFrame:
    """(trial_id, m_inc, m_exc, y, n) over all patient x trial pairs: how many patients a trial scores alike.

    A trial's pairs leave its blocks together, so most are counted before the shuffle; pairs without a hit count in bulk.
    """
    key = ["trial_id", "m_inc", "m_exc", "y"]
    n_patients = patients.agg(F.count("*")).scalar()
    hit = materialize(labels.pairs.groupBy(*key).agg(F.count("*").alias("n")))
    n_hit = hit.groupBy("trial_id").agg(F.sum("n").alias("n_hit"))
    rest = labels.defaults.join(n_hit, "trial_id", "left").select(*key, (n_patients - F.coalesce("n_hit", F.lit(0))).alias("n")).where("n > 0")
    return hit.unionByName(rest)


def complete_pairs(scores: PairScores, patients: DataFrame, trials: DataFrame | None = None,
                   condition: str | None = None) -> DataFrame:
    """Every pair of ``patients`` and ``trials`` with its score, hit or not: as many rows as pairs are asked for.

    Trials are cut into blocks of about ``TRIAL_BLOCK`` by hash. A patient's hits of a block are one map, the defaults of a block
    one array, both bounded by the block; patients meet the blocks in two equi-joins and each pair is spelled out last, in
    place. What is shuffled grows with patients x blocks and with the hits, never with the pairs; scores that can be made block by
    block spell all pairs out there, and shuffle no hits either. ``condition`` picks trials by
    their default score, for callers that want the pairs without a hit of a few trials only.
    """
    chosen = scores.defaults if trials is None else scores.defaults.join(trials.select("trial_id"), "trial_id", "left_semi")
    if condition is not None:
        chosen = chosen.where(condition)
    if scores.tagged:
        return scores.tagged(patients.select("patient_id"), chosen.select("trial_id"), True)
    fields = [c for c in scores.pairs.columns if c not in ("patient_id", "trial_id")]
    n_blocks = scores.defaults.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / TRIAL_BLOCK)).cast("int")).scalar()

    def blocked(df: DataFrame) -> DataFrame:
        return df.withColumn("_nb", n_blocks).withColumn("_block", F.pmod(F.xxhash64("trial_id"), F.col("_nb")).cast("int")).drop("_nb")

    defaults = blocked(chosen).groupBy("_block").agg(F.collect_list(F.struct("trial_id", F.struct(*fields).alias("score"))).alias("_trials"))
    own = blocked(scores.pairs).groupBy("patient_id", "_block").agg(
        F.map_from_entries(F.collect_list(F.struct("trial_id", F.struct(*fields).alias("score")))).alias("_own"))
    grid = patients.select("patient_id").withColumn("_nb", n_blocks).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_nb")
    return (
        grid.join(own, ["patient_id", "_block"], "left").join(defaults, "_block")
        .select("patient_id", "_own", F.explode("_trials").alias("_t"))
        .select("patient_id", F.col("_t.trial_id").alias("trial_id"), F.coalesce(F.col("_own")[F.col("_t.trial_id")], F.col("_t.score")).alias("_s"))
        .select("patient_id", "trial_id", *[F.col(f"_s.{c}").alias(c) for c in fields])
    )


def positive_pairs(labels: PairScores, patients: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """(patient_id, trial_id) of the eligible pairs of ``patients`` and ``trials``, hit or not; scored pairs are picked in their cells."""
    if not labels.blocks:
        return complete_pairs(labels, patients, trials).where("y = 1").select("patient_id", "trial_id")
    ids = patients.select("patient_id").distinct()
    chosen = labels.defaults if trials is None else labels.defaults.join(trials.select("trial_id").distinct(), "trial_id", "left_semi")
    kept = labels.blocks.where(lambda have: have["y"] == 1)
    own = kept.rows(ids, chosen.where("not coalesce(y = 1, false)").select("trial_id"))
    everybody = kept.rows(ids, chosen.where("y = 1").select("trial_id"), True)
    return own.unionByName(everybody).select("patient_id", "trial_id")


def weak_positives(scores: PairScores, patients: DataFrame, tau_inc: float) -> DataFrame:
    """Every pair with enough inclusion score, including all patients of a trial that asks for nothing."""
    vacuous = scores.defaults.where(F.col("m_inc") >= tau_inc)
    if scores.blocks:
        others = scores.defaults.where(f"not coalesce(m_inc >= {tau_inc}, false)").select("trial_id")
        kept = scores.blocks.where(lambda have: ~(have["m_inc"] < tau_inc))
        return kept.rows(trials=others).unionByName(kept.rows(patients.select("patient_id"), vacuous.select("trial_id"), True))
    hit = scores.pairs.join(vacuous.select("trial_id"), "trial_id", "left_anti").where(F.col("m_inc") >= tau_inc)
    return hit.unionByName(complete_pairs(scores, patients, condition=f"m_inc >= {tau_inc}").where(F.col("m_inc") >= tau_inc).select(*hit.columns))


def round_robin_pairs(patients: DataFrame, trials: DataFrame) -> DataFrame:
    """Fallback when no weak positive exists: patient i goes to trial i mod n."""
    indexed = position(trials.select("trial_id"), ["trial_id"], range_bin(trials, "trial_id"))
    n_trials = trials.agg(F.count("*")).scalar()
    return (
        position(patients.select("patient_id"), ["patient_id"], range_bin(patients, "patient_id"))
        .withColumn("pos", F.col("pos") % n_trials).join(indexed, "pos").select("patient_id", "trial_id")
    )


def weak_pairs(scores: PairScores, patients: DataFrame, tau_inc: float = 0.01) -> DataFrame:
    """Weak positives, or the round-robin pairing when there are none."""
    found = weak_positives(scores, patients, tau_inc).select("patient_id", "trial_id")
    return round_robin_pairs(patients, scores.defaults) if found.isEmpty() else found


def hard_negatives(scores: PairScores, positives: DataFrame, tau_inc: float = TAU_INC, tau_exc: float = TAU_EXC) -> DataFrame:
    """Trials that look right on inclusion but meet an exclusion, other than the positive one, hit or not.

    Pairs without a hit are spelled out only for trials whose default score makes all of them hard negatives; each of those is a row of the result.
    """
    wrong = f"m_inc >= {tau_inc} and m_exc >= {tau_exc}"
    by_default = scores.defaults.where(wrong).select("trial_id")
    others = scores.defaults.where(f"not coalesce({wrong}, false)").select("trial_id")
    # Read by several joins; finding the best pairs is as long as all the rest.
    ours = materialize(positives.select("patient_id", F.col("trial_id").alias("_positive")))
    if scores.blocks:
        kept = scores.blocks.where(lambda have: ~(have["m_inc"] < tau_inc) & ~(have["m_exc"] < tau_exc))
        found = kept.rows(ours, others).unionByName(kept.rows(ours, by_default, True))
    elif scores.tagged:
        found = scores.beside(ours, others).unionByName(scores.tagged(ours, by_default, True)).where(wrong)
    else:
        own = scores.pairs.join(others, "trial_id", "left_semi").where(wrong).select("patient_id", "trial_id")
        rest = complete_pairs(scores, positives.select("patient_id").distinct(), condition=wrong).where(wrong).select("patient_id", "trial_id")
        found = ours.join(own.unionByName(rest), "patient_id")
    return found.where("trial_id <> _positive").select("patient_id", F.col("_positive").alias("trial_id"), F.col("trial_id").alias("negative_trial_id"))
