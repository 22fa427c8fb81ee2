"""Negative trials are drawn within the row of their pair: the draws of the ring, and no row for each."""

import pytest
from pyspark.sql import functions as F

from eligra.functions.hashing import draw_key
from eligra.operators import splits as sp
from eligra.operators.ranking import top_k


@pytest.mark.parametrize("n_trials", [1, 4, 40])
def test_lists_are_the_draws_of_the_ring(spark, n_trials):
    trials = spark.range(n_trials).select(F.format_string("T%02d", "id").alias("trial_id"))
    pairs = spark.range(60).select(F.col("id").alias("patient_id"), F.format_string("T%02d", F.col("id") % n_trials).alias("trial_id"))
    own = pairs.withColumnRenamed("trial_id", "own")
    drawn = sp.ring_draws(own, ["patient_id", "own"], trials, 6, 4).where("trial_id <> own")
    drawn = drawn.withColumn("_key", draw_key(4, F.col("patient_id"), F.col("own"), F.col("trial_id")))
    want = sorted((r.patient_id, r.own, r.trial_id) for r in top_k(drawn, ["patient_id", "own"], [F.asc("_key"), F.asc("trial_id")], 5).collect())
    assert sorted(map(tuple, sp.random_negative_trials(pairs, trials, 5, 4).collect())) == want
    assert want or n_trials == 1
    plan = sp.negative_trial_lists(pairs, trials, 5, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("scalar-subquery")[0]
