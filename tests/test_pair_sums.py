"""Sums over pairs are made in the cells: same figures as over the pairs as rows, and no pair leaves its cell."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eligra.operators import labels as la
from eligra.operators import match as mt
from eligra.operators import metrics as me
from eligra.operators import pair_blocks as pb
from eligra.operators import splits as sp
from test_pair_blocks import CODES, CRIT, tables  # noqa: F401


def plain(scores):
    """The same scores as hand-made ones, whose pairs are rows."""
    return mt.PairScores(scores.pairs, scores.defaults)


def rows(df):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(pb, "SUM_SIZES", (7, 4))


@pytest.mark.parametrize("name", ["L", "A", "B"])
def test_sums_equal_those_of_rows(spark, tables, small, name):  # noqa: F811
    labels = la.label_pairs(mt.score_pairs(*tables, name))
    again, people = plain(labels), spark.createDataFrame([(f"p{p}",) for p in range(45)], "patient_id string")
    assert rows(la.trial_positives(labels, people)) == rows(la.trial_positives(again, people))
    assert rows(la.patient_positives(labels, people)) == rows(la.patient_positives(again, people))
    assert rows(la.label_stats(labels, people)) == rows(la.label_stats(again, people))
    p, t = sp.partition_ids(people, "patient_id", 0), sp.partition_ids(labels.defaults, "trial_id", 1)
    assert rows(sp.quadrant_sizes(labels, p, t)) == rows(sp.quadrant_sizes(again, p, t))
    top = [pb.Measure("top", "m_inc", lambda have, trial: have["m_inc"], whole=False, top=True)]
    assert rows(labels.by_trial(top)) == rows(again.by_trial(top))


def test_strict_match_agrees_as_over_all_pairs(spark, tables, small):  # noqa: F811
    crit, codes = tables
    crit = crit.unionByName(spark.createDataFrame([(99, 0, "administrative", "X", "EXISTS", None, None, True, 1.0)], CRIT))
    people = spark.createDataFrame([(f"p{p}",) for p in range(45)], "patient_id string")
    strict, scores = mt.strict_pairs(crit, codes), mt.score_pairs(crit, codes, "B")
    y, score = F.col("matched").cast("int").alias("y"), F.round("m_inc", 6).alias("score")
    both = mt.PairScores(strict.pairs.join(scores.pairs, ["patient_id", "trial_id"]).select("patient_id", "trial_id", y, score),
                         strict.defaults.join(scores.defaults, "trial_id").select("trial_id", y, score).where("y is not null"))
    want = me.strict_accuracy(la.complete_pairs(both, people), 0.5)
    assert rows(me.strict_agreement(mt.strict_scores(crit, codes).rounded(6), people, 0.5)) == rows(want)


def test_no_pair_leaves_its_cell(spark, tables):  # noqa: F811
    labels = la.label_pairs(mt.score_pairs(*tables, "L"))
    plan = la.trial_positives(labels, spark.range(3).select(F.col("id").alias("patient_id")))._jdf.queryExecution().optimizedPlan().toString()
    made = plan[plan.index("MapInArrow"):].split("[", 1)[1].split("]")[0]
    assert "m_inc" not in made and "y_hit" in made
    parts = labels.blocks.sums([la.POSITIVE], ["trial_id"])
    assert parts.count() <= 25 * 2 and "CartesianProduct" in parts._jdf.queryExecution().executedPlan().toString()


def test_partitions_share_a_block(spark):
    """Eight partitions with five ids each fill one block, not eight."""
    ids = spark.range(40).repartition(8).select("id", F.array(F.struct(F.lit("d").alias("entity_type"), F.lit("c").alias("code"), F.lit(0.0).alias("value"))).alias("items"))
    assert pb._blocks(ids, 64, ["p_ids", "p_lists"], pb._pack_patients).count() == 1
    placed = pb._blocks(ids, 5, ["p_ids", "p_lists"], pb._pack_patients)
    assert max(placed.rdd.glom().map(len).collect()) == 1


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(3)
    x = [rng.uniform(-3, 3) for _ in range(3000)] + [rng.randrange(-3000000, 3000000) / 2000000 for _ in range(3000)] + [0.0, -0.0, 1e-7, 5e-7, 0.0000005, float("nan")]
    for digits in (6, 9):
        want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", digits)).collect()]
        assert np.array_equal(pb.half_up(np.array(x), digits), np.array(want), equal_nan=True)
