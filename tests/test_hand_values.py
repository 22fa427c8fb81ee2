"""Values known by hand for the code, hierarchy, text and matching operators."""

import math

import pytest
from pyspark.sql import functions as F

from eligra.functions import codes as co
from eligra.functions import text as tx
from eligra.operators import cohort, hierarchy, labs, match
from eligra.operators.criteria import criteria_lines, parse_criteria, recover_concepts
from eligra.operators.phrases import _best_window, fuzzy_medications

CRIT = ("trial_id int, criterion_idx int, entity_type string, entity_code string, operator string, value double, "
        "max_value double, is_inclusion boolean, severity_weight double")
CODES = "patient_id string, entity_type string, code string, value double"


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_code_normalisation(spark):
    rows = [("diagnosis", "I50.9"), ("medication", "12345.0"), ("lab", "50912"), ("medication", ""), ("medication", "123456789012")]
    got = values(spark, co.normalize_code(F.col("k"), F.col("c")), rows, "k string, c string")
    assert got == ["I509", "00000012345", "50912", "", "123456789012"]


def test_resolved_codes(spark):
    got = values(spark, co.is_resolved(F.col("t")), [("I509",), ("UNMATCHED_1",), ("UNK_DIA_x",), (" ",), ("NaN",), (None,)])
    assert got == [True, False, False, False, False, False]


def test_crosswalk_keeps_first_and_null_flags(spark):
    raw = spark.createDataFrame([(1, "250.0", "E11.9", None), (2, "2500", "E10", "0"), (3, "401", "I10", "1")],
                                "seq int, icd9cm string, icd10cm string, no_map string")
    assert [tuple(r) for r in cohort.clean_crosswalk(raw).collect()] == [("2500", "E119")]


def test_elapsed_days_not_midnights(spark):
    rows = [(1, 1, "2020-01-01 23:00:00"), (1, 2, "2020-01-31 01:00:00"), (2, 3, "2020-01-01 00:00:00"), (2, 4, "2020-01-31 00:00:00"), (3, 5, "bad"), (3, 6, "2020-02-02 00:00:00")]
    df = spark.createDataFrame(rows, "SUBJECT_ID int, HADM_ID int, ADMITTIME string")
    assert [r[0] for r in cohort.select_cohort(df).collect()] == [2]


EDGES = [(1, "I50", "I509"), (2, "I50", "I501"), (3, "I509", "I5090"), (4, "I509", "I5099")]


def test_hierarchy_scores(spark):
    closure = hierarchy.ancestor_closure(spark.createDataFrame(EDGES, "seq int, parent string, child string"))
    pairs = spark.createDataFrame([("I50", "I509"), ("I509", "I50"), ("I50", "I50"), ("I50", "E119"), ("I50", "I5099")], "code1 string, code2 string")
    got = {(r.code1, r.code2): r.match_score for r in hierarchy.score_code_pairs(pairs, closure).collect()}
    assert got == {("I50", "I509"): 0.8, ("I509", "I50"): 0.6, ("I50", "I50"): 1.0, ("I50", "E119"): 0.0, ("I50", "I5099"): 0.8}


def test_cycle_ends(spark):
    loop = spark.createDataFrame([(1, "a", "b"), (2, "b", "c"), (3, "c", "a")], "seq int, parent string, child string")
    closure = hierarchy.ancestor_closure(loop)
    assert {r[0] for r in hierarchy.cyclic_codes(closure).collect()} == {"a", "b", "c"}


def test_duplicate_parents(spark):
    raw = spark.createDataFrame([(0, "parent", "child"), (1, "I50", "I509"), (2, "I51", "I509"), (3, "I50", "I509"), (4, "", "x")],
                                "seq int, parent string, child string")
    report = hierarchy.edge_report(raw).first()
    assert (report.n_duplicates, report.n_conflicts, report.n_skipped) == (2, 1, 1)
    assert hierarchy.first_parents(hierarchy.clean_edges(raw)).first().parent == "I50"


@pytest.mark.parametrize("prefer, day10", [("carry", math.exp(-1)), ("fresh", 2.0)])
def test_daily_grid(spark, prefer, day10):
    daily = spark.createDataFrame([(1, 7, 0, 1.0), (1, 7, 10, 2.0), (1, 7, 100, 3.0), (2, 7, 5, 4.0)], "subject_id int, itemid int, d int, value double")
    daily = daily.withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))).drop("d")
    grid = labs.expand_daily_grid(daily, prefer=prefer).withColumn("k", F.datediff("charttime", F.lit("2020-01-01"))).collect()
    one = {r.k: r.imputed_value_decayed for r in grid if r.subject_id == 1}
    assert len([r for r in grid if r.subject_id == 1]) == 72 == len(one) and len([r for r in grid if r.subject_id == 2]) == 1
    assert set(one) == set(range(41)) | set(range(100, 131))
    assert one[10] == pytest.approx(day10) and one[11] == pytest.approx(2 * math.exp(-0.1)) and one[40] == pytest.approx(2 * math.exp(-3))


def softmax(scores, t):
    if not scores or not any(scores):
        return 0.0
    w = [math.exp(s / t) for s in scores]
    return sum(a * b for a, b in zip(w, scores)) / sum(w)


def test_softmax_exclusion(spark):
    rows = [(1, i, "diagnosis", f"E{i}", "EXISTS", None, None, False, 1.0) for i in range(4)]
    rows.append((1, 4, "lab", "50912", "GT", 1.0, None, False, 1.0))
    crit = spark.createDataFrame(rows, CRIT)
    x = 1 + math.log(0.9 / 0.1)
    codes = spark.createDataFrame([("p", "lab", "50912", x)], CODES)
    got = []
    for t in (0.05, 0.5, 5.0):
        got.append(match.score_pairs(crit, codes, "B", temperature=t).pairs.first().m_exc)
        assert got[-1] == pytest.approx(softmax([0, 0, 0, 0, 0.9], t))
    assert got == sorted(got, reverse=True) and got[1] < 0.9


def test_end_to_end_patients(spark):
    crit = spark.createDataFrame([
        (1, 0, "diagnosis", "I509", "EXISTS", None, None, True, 1.0), (1, 1, "lab", "LVEF", "LT", 40.0, None, True, 0.8),
        (1, 2, "lab", "50912", "GT", 2.0, None, False, 1.0), (1, 3, "administrative", "NON_CLINICAL", "EXISTS", None, None, True, 1.0)], CRIT)
    people = {"A": ("I509", 30.0, 2.5), "B": ("I50", 35.0, 1.0), "C": ("E119", 55.0, 0.9)}
    codes = spark.createDataFrame([r for p, (dx, ef, cr) in people.items() for r in (
        (p, "diagnosis", dx, None), (p, "lab", "LVEF", ef), (p, "lab", "50912", cr))], CODES)
    closure = hierarchy.ancestor_closure(spark.createDataFrame(EDGES, "seq int, parent string, child string"))
    got = {r.patient_id: r for r in match.score_pairs(crit, codes, "B", closure).pairs.collect()}
    assert got["A"].m_inc > 0.5 and got["A"].m_exc > 0.5
    assert 0 < got["B"].m_inc < 1 and got["B"].m_exc < 0.3 and got["C"].m_inc < got["B"].m_inc
    only_admin = crit.where("criterion_idx in (0, 3)")
    assert match.score_pairs(only_admin, codes, "B").pairs.where("patient_id = 'A'").first().m_inc == 1.0


@pytest.mark.parametrize("rule", ["A", "L"])
@pytest.mark.parametrize("exclusion", ["max", "mean"])
def test_sparse_scores_equal_dense_loop(spark, rule, exclusion):
    """Random criteria with absence on both sides, salted and not, against a plain loop over all pairs."""
    import dataclasses
    import random

    rng = random.Random(5)
    names = [f"D{i}" for i in range(8)]
    crit = [(t, i, "diagnosis", rng.choice(names), rng.choice(["EXISTS", "NOT_EXISTS"]), None, None, rng.random() < 0.5, rng.choice([0.5, 1.0, 1.5]))
            for t in range(6) for i in range(7)]
    people = {f"p{i}": set(rng.sample(names, rng.randint(0, 5))) | {"D0"} for i in range(20)}
    spec = dataclasses.replace(match.RULES[rule], exclusion=exclusion)
    codes = spark.createDataFrame([(p, "diagnosis", c, None) for p, cs in people.items() for c in cs], CODES)
    for salt in (1, 4):
        scores = match.score_pairs(spark.createDataFrame(crit, CRIT), codes, spec, salt=salt)
        got = {(r.patient_id, r.trial_id): (r.m_inc, r.m_exc) for r in scores.pairs.collect()}
        default = {r.trial_id: (r.m_inc, r.m_exc) for r in scores.defaults.collect()}
        for t in range(6):
            for p, cs in people.items():
                score = lambda c: float((c[3] in cs) == (c[4] == "EXISTS")) * c[8]
                inc = [score(c) for c in crit if c[0] == t and c[7]]
                exc = [score(c) for c in crit if c[0] == t and not c[7]]
                want = (sum(inc) / len(inc) if inc else 1.0, (max(exc) if exclusion == "max" else sum(exc) / len(exc)) if exc else 0.0)
                assert got.get((p, t), default[t]) == pytest.approx(want)


def test_wide_absence_list(spark):
    """More absence exclusions than one mask word holds, all but the lightest hit."""
    crit = spark.createDataFrame([(1, i, "diagnosis", f"D{i}", "NOT_EXISTS", None, None, False, 1.0 + i) for i in range(130)], CRIT)
    codes = spark.createDataFrame([("p", "diagnosis", f"D{i}", None) for i in range(1, 130)], CODES)
    assert match.score_pairs(crit, codes, "A").pairs.first().m_exc == 1.0


def test_negation_before(spark):
    rows = [("no history of heart failure", 14), ("with heart failure", 5), ("denies chest pain. History of heart failure", 30), ("abnormal LVEF", 9)]
    assert values(spark, tx.is_negated_before(F.col("t"), F.col("s")), rows, "t string, s int") == [True, False, False, False]


def test_bounds(spark):
    rows = [("between 1 and 5 mg",), ("creatinine >= 2.5",), ("no more than 7",), ("above 3",), ("= 4",), ("nothing",), ("at least .",)]
    got = [tuple(r) for r in values(spark, tx.bounds_patterns(F.col("t")), rows)]
    assert got == [("BETWEEN", 1.0, 5.0), ("GTE", 2.5, None), ("LTE", 7.0, None), ("GT", 3.0, None), ("EQ", 4.0, None), ("EXISTS", None, None), ("GTE", None, None)]
    span = values(spark, tx.bounds_with_span(F.col("t")), [("age above 18 years",)])[0]
    assert (span.operator, span.value, span.start, span.end) == ("GTE", 18.0, 4, 12)


TEXT = "Lead line counts\nInclusion Criteria:\n- Congestive heart failure on file\n* short\nExclusion Criteria:\nHistory of heart failure\ncreatinine above 3 mg\ninsulin is taken\n"


def test_sections_and_default_dialect(spark):
    trials = spark.createDataFrame([("T", TEXT, ["Heart failure"])], "trial_id string, eligibility_criteria string, conditions array<string>")
    lines = [(r.line, r.is_inclusion) for r in criteria_lines(trials, "D").collect()]
    assert lines == [("Lead line counts", True), ("Congestive heart failure on file", True), ("History of heart failure", False),
                     ("creatinine above 3 mg", False), ("insulin is taken", False)]
    cohort_codes = spark.createDataFrame([("I509",), ("I501",), ("E119",)], "code string")
    rows = [(r.entity_type, r.entity_code, r.operator, r.value, r.is_inclusion, r.severity_weight)
            for r in parse_criteria(trials, "D", cohort_codes=cohort_codes).orderBy("pos", "entity_code").collect()]
    assert ("diagnosis", "I501", "EXISTS", None, True, 1.0) in rows and ("diagnosis", "I501", "NOT_EXISTS", None, False, 1.0) in rows
    assert ("lab", "50912", "GT", 3.0, False, 1.0) in rows
    assert sorted(r[1] for r in rows if r[5] == 1.5) == ["I501", "I509"]
    assert [r[1][:8] for r in rows if r[0] == "medication"] == ["UNK_MED_"]


def test_short_text_gives_no_rows(spark):
    trials = spark.createDataFrame([("T", "short"), ("U", None)], "trial_id string, eligibility_criteria string")
    assert criteria_lines(trials, "A").count() == 0 and criteria_lines(trials, "D").count() == 0


CONCEPTS = [("metformin hydrochloride", "medication", "111"), ("lisinopril", "medication", "222"), ("atrial fibrillation unspecified", "diagnosis", "I4891")]


def lcs_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = 0
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], previous + 1 if x == y else max(row[j], row[j - 1])
    return 200 * row[-1] / (len(a) + len(b))


def test_partial_ratio_equals_every_window():
    import random

    rng = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(4, 14))) for _ in range(2))
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        m = len(short)
        want = max(lcs_ratio(short, long[max(0, s):s + m]) for s in range(1 - m, len(long)))
        assert _best_window(a, b, 80) == pytest.approx(want if want >= 80 else 0.0)


def test_fuzzy_candidates_lose_nothing(spark):
    """Blocking keeps every pair that reaches the cutoff, on words one edit away from a name."""
    from eligra.operators.phrases import similar_names

    names = ["metoprolol", "digoxin", "warfarin", "xanaxbar", "lisinopril"]
    words = {n[:i] + n[i + 1:] for n in names for i in range(len(n))} | {n[:4] + n[5:7] for n in names} | {"zzzzz", "digox", "anaxb"}
    got = {r.text: r.ratio for r in similar_names(spark.createDataFrame([(w,) for w in words], "text string"),
                                                  spark.createDataFrame([(n,) for n in names], "name string"), 87).collect()}
    want = {w: max(_best_window(w, n, 87) for n in names) for w in words}
    assert got == pytest.approx({w: r for w, r in want.items() if r > 0})


def test_fuzzy_and_recovery(spark):
    lines = spark.createDataFrame([("T", 0, "currently on Lisinoprill daily"), ("T", 1, "history of MI last year"), ("T", 2, "hemoglobin 9 or less"), ("T", 3, "Willing to attend")],
                                  "trial_id string, pos int, line string")
    concepts = spark.createDataFrame(CONCEPTS, "phrase string, entity_type string, entity_code string")
    assert [(r.pos, r.phrase) for r in fuzzy_medications(lines, concepts).collect()] == [(0, "lisinopril")]
    got = {r.pos: (r.matched_type, r.matched_code) for r in recover_concepts(lines, concepts).collect()}
    assert got == {0: ("medication", "222"), 1: ("diagnosis", "I21"), 2: ("lab", "LABHINT_hemoglobin"), 3: (None, None)}
