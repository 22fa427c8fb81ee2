"""Pairs scored block by block: same scores as hits that are shuffled, and no shuffle of pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eligra.operators import labels as la
from eligra.operators import match as mt
from eligra.operators import pair_blocks as pb

CRIT = "trial_id long, criterion_idx int, entity_type string, entity_code string, operator string, value double, max_value double, is_inclusion boolean, severity_weight double"
CODES = "patient_id string, entity_type string, code string, value double"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    dx, labs = [f"D{i}" for i in range(9)], ["50912", "51222"]
    crit = []
    for t in range(25):
        for i in range(rng.randint(1, 9)):
            weight, inc = rng.choice([0.5, 1 / 3, 0.5 + 7 / 50, None]), rng.random() < 0.6
            if rng.random() < 0.3:
                op = rng.choice(["GT", "GTE", "LT", "LTE", "EQ", "BETWEEN", "EXISTS"])
                crit.append((t, i, "lab", rng.choice(labs), op, rng.choice([3.0, 80.0]), rng.choice([None, 9.0]), inc, weight))
            else:
                kind, op = rng.choice(["diagnosis", "diagnosis", "procedure"]), rng.choice(["EXISTS", "NOT_EXISTS", "GT"])
                crit.append((t, i, kind, rng.choice([*dx, "UNMATCHED_1"]), op, None, None, inc, weight))
    codes = [(f"p{p}", "diagnosis", c, None) for p in range(40) for c in rng.sample(dx, rng.randint(0, 5))]
    codes += [(f"p{p}", "lab", c, rng.uniform(0, 100)) for p in range(40) for c in labs if rng.random() < 0.5]
    return spark.createDataFrame(crit, CRIT), spark.createDataFrame(codes, CODES)


@pytest.mark.parametrize("name", ["L", "A", "B"])
def test_blocks_equal_shuffled_hits(spark, tables, name, monkeypatch):
    monkeypatch.setattr(pb, "PATIENT_BLOCK", 7)
    monkeypatch.setattr(pb, "TRIAL_BLOCK", 4)
    monkeypatch.setattr(pb, "BATCH_ROWS", 20)
    crit, codes = tables
    rule = mt.RULES[name]
    usable = mt.usable_criteria(crit, rule)
    defaults = mt.trial_defaults(usable, crit.select("trial_id").distinct(), rule)
    want = {(r.patient_id, r.trial_id): (r.m_inc, r.m_exc) for r in mt.aggregate_pairs(mt.criterion_hits(usable, codes, rule), defaults, rule).collect()}
    rows = mt.score_pairs(crit, codes, name).pairs.collect()
    got = {(r.patient_id, r.trial_id): (r.m_inc, r.m_exc) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_counts_of_a_trial_shuffle_no_pairs(spark, tables):
    """One exchange per blocks' side and one of counts: none of hits or of pairs."""
    labels = la.label_pairs(mt.score_pairs(*tables, "L"))
    plan = labels.pairs.groupBy("trial_id").agg(F.sum("y"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan
    after = plan[:plan.index("MapInArrow")]
    assert after.count("Exchange") == 1 and "partial_sum" in after


def test_columns_beside_pairs(spark, tables):
    scores = mt.score_pairs(*tables, "L")
    half = spark.createDataFrame([(f"p{p}", p % 3) for p in range(20)], "patient_id string, third int")
    want = scores.pairs.join(half, "patient_id").select("patient_id", "third", "trial_id", "m_inc", "m_exc")
    got = scores.beside(half).select(*want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_whole_sums_round_once():
    rng = random.Random(1)
    whole = [rng.randrange(1 << 54, 1 << 61) for _ in range(20000)] + [(1 << 54) + 2, 3 * (1 << 53) + 6, 0, -(1 << 60) - 1]
    for divisor in (1, 10 ** 16):
        assert pb.nearest(np.array(whole), divisor).tolist() == [w / divisor for w in whole]


def test_every_pair_is_spelled_out_in_its_block(spark, tables):
    """Patients without codes and trials that ask for nothing included, and no pair goes through an exchange."""
    crit, codes = tables
    crit = crit.unionByName(spark.createDataFrame([(99, 0, "administrative", "UNMATCHED_", "EXISTS", None, None, True, 1.0)], CRIT))
    labels = la.label_pairs(mt.score_pairs(crit, codes, "L"))
    patients = spark.createDataFrame([(f"p{p}",) for p in range(45)], "patient_id string")
    plain = la.complete_pairs(mt.PairScores(labels.pairs, labels.defaults), patients)
    every = la.complete_pairs(labels, patients).select(*plain.columns)
    assert every.count() == 45 * labels.defaults.count()
    key = lambda rows: {(r.patient_id, r.trial_id): (round(r.m_inc, 9), round(r.m_exc, 9), r.y) for r in rows.collect()}
    assert key(every) == key(plain)
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")]


def test_overlap_shuffles_no_pairs(spark, tables):
    from eligra.operators import features as fe

    crit, codes = tables
    plan = fe.overlap_counts(codes, crit)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")]


def test_comorbidity_shuffles_no_pairs(spark):
    from eligra.operators import graph as gr

    dx = spark.range(60).selectExpr("id as subject_id", "explode(array('a', 'b', concat('c', id % 3))) as icd10_code")
    edges = gr.comorbidity_edges(dx)
    assert edges.count() == 60 * 59
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("MapInArrow")]
