"""Given pairs are scored by looking up what their trials ask for; drawn training pairs need no other pair."""

from pyspark.sql import functions as F

from eligra.operators import labels as la
from eligra.operators import match as mt
from eligra.operators import splits as sp
from test_pair_blocks import CODES, CRIT, tables  # noqa: F401


def test_known_pairs_have_the_scores_of_their_blocks(spark, tables):  # noqa: F811
    labels = la.label_pairs(mt.score_pairs(*tables, "L"))
    asked = spark.range(45).select(F.concat(F.lit("p"), "id").alias("patient_id"), F.explode(F.array(*[F.lit(t).cast("long") for t in (1, 5, 9, 77)])).alias("trial_id"))
    rows = lambda df: sorted((r.patient_id, r.trial_id, round(r.m_inc, 9), round(r.m_exc, 9), r.y) for r in df.collect())
    assert rows(labels.known(asked)) == rows(asked.join(labels.pairs, ["patient_id", "trial_id"]))
    assert "MapInArrow" not in labels.known(asked)._jdf.queryExecution().optimizedPlan().toString()


def test_training_pairs_are_those_of_all_pairs(spark, tables):  # noqa: F811
    labels = la.label_pairs(mt.score_pairs(*tables, "L"))
    people = spark.createDataFrame([(f"p{p}",) for p in range(30)], "patient_id string")
    trials = labels.defaults.select("trial_id").where("trial_id < 18")
    got, want = (sp.sample_training_pairs(x, people, trials, 7, 2, 60, 10) for x in (labels, mt.PairScores(labels.pairs, labels.defaults)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
