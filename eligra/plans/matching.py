"""Pair scores, labels, hierarchy and alignment queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligra.operators import hierarchy as hi
from eligra.operators import labels as la
from eligra.operators import match as mt
from eligra.operators import quality as qu
from eligra.operators import report as re_
from eligra.operators import topk as tk
from eligra.operators.metrics import curve_metrics
from eligra.operators.pair_blocks import Measure
from eligra.plans.base import Inputs, Query, rounded, sql

CLOSURE = """
    select child as code, parent as ancestor, 1 as depth from hierarchy_edges
    union all
    select lo.child, up.parent, 2 from hierarchy_edges lo join hierarchy_edges up on lo.parent = up.child"""

# Rule B over the dense grid: presence ignores the operator, lab GTE / LTE / BETWEEN score 0.
GRID_B = """
    select p.patient_id, c.trial_id, c.criterion_idx, c.is_inclusion, c.severity_weight as w, h.code is not null as present,
      case when h.code is null then 0 when c.entity_type <> 'lab' or operator = 'EXISTS' then 1
           when operator = 'GT' then 1 / (1 + exp(c.value - h.value)) when operator = 'LT' then 1 / (1 + exp(h.value - c.value))
           when operator = 'EQ' then 1 / (1 + exp(abs(h.value - c.value) - 1)) else 0 end as s,
      c.entity_type in ('diagnosis', 'medication') or operator in ('EXISTS', 'GT', 'LT', 'EQ', 'GTE', 'LTE', 'BETWEEN') as scorable
    from patients p cross join (select * from criteria where entity_type <> 'administrative' and not starts_with(entity_code, 'UNMATCHED_')) c
    left join pcodes h on h.patient_id = p.patient_id and h.entity_type = c.entity_type and h.code = c.entity_code"""
DENSE_B = """
    select patient_id, trial_id, bool_or(present and scorable) as any_hit,
      coalesce((coalesce(cast(sum(cast(w as decimal(18,6))) filter (where is_inclusion and s = 1) as double), 0e0) + coalesce(sum(w * s) filter (where is_inclusion and s <> 1), 0e0)) / nullif(cast(sum(cast(w as decimal(18,6))) filter (where is_inclusion) as double), 0), 1e0) as m_inc,
      coalesce(case when max(s) filter (where not is_inclusion) > 0 then
        sum(s * exp(s / 0.5e0)) filter (where not is_inclusion) / sum(exp(s / 0.5e0)) filter (where not is_inclusion) end, 0e0) as m_exc,
      count(*) filter (where is_inclusion) as n_inc, count(*) filter (where not is_inclusion) as n_exc
    from {grid} group by patient_id, trial_id"""
# Hierarchy: best of exact 1, ancestor of the criterion 0.8, descendant 0.6.
GRID_BH = """
    select g.patient_id, g.trial_id, g.criterion_idx, g.is_inclusion, g.w,
      g.present or b.best is not null as present, g.scorable,
      greatest(g.s, coalesce(b.best, 0e0)) as s
    from grid_b g left join (
      select h.patient_id, c.trial_id, c.criterion_idx, max(case when a.code = c.entity_code then 0.8e0 else 0.6e0 end) as best
      from criteria c join closure a on c.entity_type = 'diagnosis' and (a.code = c.entity_code or a.ancestor = c.entity_code)
      join pcodes h on h.entity_type = 'diagnosis' and h.code = case when a.code = c.entity_code then a.ancestor else a.code end
      group by all) b on b.patient_id = g.patient_id and b.trial_id = g.trial_id and b.criterion_idx = g.criterion_idx"""
# Rule A over the dense grid: no normalisation, placeholders and administrative rows are scored.
GRID_A = """
    select p.patient_id, c.trial_id, c.criterion_idx, c.is_inclusion, c.severity_weight as w, h.code is not null as present,
      case when operator = 'EXISTS' then cast(h.code is not null as int)
           when operator = 'NOT_EXISTS' then cast(h.code is null as int)
           when h.code is null or c.entity_type <> 'lab' or c.value is null then 0
           when operator = 'GT' then 1 / (1 + exp(c.value - h.value)) when operator = 'GTE' then 1 / (1 + exp(c.value - h.value - 1e-6))
           when operator = 'LT' then 1 / (1 + exp(h.value - c.value)) when operator = 'LTE' then 1 / (1 + exp(h.value - c.value - 1e-6))
           when operator = 'EQ' then exp(-abs(h.value - c.value))
           when c.max_value is null then 0
           else 1 / (1 + exp(c.value - h.value)) / (1 + exp(h.value - c.max_value)) end as s
    from patients p cross join criteria c
    left join pcodes h on h.patient_id = p.patient_id and h.entity_type = c.entity_type and h.code = c.entity_code"""
EXTRA = {
    "closure": CLOSURE, "grid_b": GRID_B, "dense_b": DENSE_B.format(grid="grid_b"), "grid_bh": GRID_BH,
    "dense_bh": DENSE_B.format(grid="grid_bh"), "grid_a": GRID_A,
    "dense_a": """
    select patient_id, trial_id, bool_or(present) as any_hit,
      coalesce((coalesce(cast(sum(cast(w as decimal(18,6))) filter (where is_inclusion and s = 1) as double), 0e0) + coalesce(sum(w * s) filter (where is_inclusion and s <> 1), 0e0)) / nullif(count(*) filter (where is_inclusion), 0), 1e0) as m_inc,
      coalesce(max(w * s) filter (where not is_inclusion), 0e0) as m_exc
    from grid_a group by patient_id, trial_id""",
    "strict_b": """
    select patient_id, trial_id, bool_or(present and scorable) as any_hit,
      bool_and(case when is_inclusion then s >= 0.5e0 else s < 0.5e0 end) as matched
    from grid_b group by patient_id, trial_id""",
    "criteria_vocab": """
    select c.*, v.code is not null and not ph as in_vocab, near.cat is not null as near from (
      select *, starts_with(entity_code, 'UNMATCHED_') or trim(entity_code) = '' or lower(entity_code) = 'none' as ph from criteria) c
    left join (select distinct entity_type, code from pcodes) v on v.entity_type = c.entity_type and v.code = c.entity_code
    left join (select distinct substr(code, 1, 3) as cat from pcodes where entity_type = 'diagnosis') near
      on c.entity_type = 'diagnosis' and near.cat = substr(c.entity_code, 1, 3)""",
    "criteria_status": """
    select *, case when ph then 'UNMATCHED_PLACEHOLDER' when in_vocab then 'RESOLVED' else 'OOV' end as status,
      case when ph then 'UNMATCHED_PLACEHOLDER' when in_vocab then 'RESOLVED' when near then 'RESOLVED_VIA_ALIGNMENT' else 'OOV' end as aligned
    from criteria_vocab""",
}


def _q(body: str) -> str:
    return sql(body, EXTRA)


def _shown(scores: mt.PairScores) -> mt.PairScores:
    return scores.rounded(6)


def _pairs(rule: str, hierarchy: bool = False):
    def run(s, d):
        i = Inputs(s, d)
        closure = hi.ancestor_closure(i.view("hierarchy_edges")) if hierarchy else None
        return _shown(la.label_pairs(mt.score_pairs(i.criteria(), i.codes(), rule, closure))).pairs
    return run


def _pairs_sql(dense: str) -> str:
    return _q(f"""select patient_id, trial_id, round(m_inc, 6) as m_inc, round(m_exc, 6) as m_exc,
        cast(m_inc >= 0.15e0 and m_exc < 0.8e0 as int) as y from {dense} where any_hit""")


def _labels(s, d, often: bool = False):
    i = Inputs(s, d)
    return i, la.label_pairs(i.scores("L", often))


def _defaults(s, d):
    i, labels = _labels(s, d)
    return rounded(labels.defaults, "m_inc", "m_exc")


def _strict(s, d):
    i = Inputs(s, d)
    return mt.strict_pairs(i.criteria(), i.codes()).pairs


def _closure(s, d):
    return hi.ancestor_closure(Inputs(s, d).view("hierarchy_edges"))


def _hierarchy_match(s, d):
    i = Inputs(s, d)
    closure = hi.ancestor_closure(i.view("hierarchy_edges"))
    # Every criterion code against the first code and the category of the codes that share its category.
    dx = i.criteria().where("entity_type = 'diagnosis' and entity_code not like 'UNMATCHED%'").select(F.col("entity_code").alias("code2")).distinct()
    cats = i.codes().where("entity_type = 'diagnosis'").groupBy(F.substring("code", 1, 3).alias("cat")).agg(F.min("code").alias("first"))
    pairs = dx.withColumn("cat", F.substring("code2", 1, 3)).join(cats, "cat").select(
        "code2", F.explode(F.array("first", "cat", F.substring("cat", 1, 1))).alias("code1")).distinct()
    both = pairs.unionByName(pairs.select(F.col("code1").alias("code2"), F.col("code2").alias("code1"))).distinct()
    return hi.score_code_pairs(both, closure)


def _align(s, d):
    i = Inputs(s, d)
    dx = i.criteria().where("entity_type = 'diagnosis'").select(F.col("entity_code").alias("code"))
    return hi.align_diagnoses(dx, i.codes().where("entity_type = 'diagnosis'").select("code"))


def _align_meds(s, d):
    i = Inputs(s, d)
    part = i.table("part")
    crosswalk = part.select((10000 + F.col("p_partkey") % 300).cast("string").alias("ndc"), F.col("p_brand").alias("ingredient"))
    # Half of the cohort's NDCs (by last digit) stand for a narrower formulary, so alignment has work to do.
    cohort = i.codes().where("entity_type = 'medication'").select(F.col("code").alias("ndc")).where(F.substring("ndc", -1, 1) < "5")
    meds = i.criteria().where("entity_type = 'medication'").select(F.col("entity_code").alias("code")).distinct()
    return hi.align_medications(meds, cohort, crosswalk)


def _informative(s, d):
    i, labels = _labels(s, d)
    return la.informative_trials(labels, i.patients()).select("trial_id", "n_pos")


def _label_stats(s, d):
    i, labels = _labels(s, d)
    return rounded(la.label_stats(labels, i.patients()), "prevalence")


# Distinct scores are rounded on both sides of the audit, as sums in another order differ in the last bit.
def _audit_rounded(s, d):
    i, labels = _labels(s, d)
    return labels.rounded(9), i


def _leakage(s, d):
    cut, i = _audit_rounded(s, d)
    # The pairs are counted once for both scores.
    counts = la.score_counts(cut, i.patients())
    diff = curve_metrics(la.histogram_of(counts, F.round(F.col("m_inc") - F.col("m_exc"), 9)))
    inc = curve_metrics(la.histogram_of(counts, F.col("m_inc")))
    a = diff.select(F.lit("m_inc - m_exc").alias("score"), "roc_auc", "average_precision", "prevalence")
    b = inc.select(F.lit("m_inc").alias("score"), "roc_auc", "average_precision", "prevalence")
    return rounded(a.unionByName(b), "roc_auc", "average_precision", "prevalence")


AUC_SQL = """
    select score, round(auc, 6) as roc_auc, round(ap, 6) as average_precision, round(prev, 6) as prevalence from (
      select score, sum(n_neg * (cum_pos - n_pos / 2e0)) / (sum(n_pos) * sum(n_neg)) as auc,
        sum(n_pos * cum_pos / (cum_pos + cum_neg)) / sum(n_pos) as ap, sum(n_pos) / (sum(n_pos) + sum(n_neg)) as prev
      from (select *, sum(n_pos) over w as cum_pos, sum(n_neg) over w as cum_neg from (
          select score, v, cast(sum(y) as double) as n_pos, cast(sum(1 - y) as double) as n_neg from (
            select 'm_inc - m_exc' as score, round(round(m_inc, 9) - round(m_exc, 9), 9) as v, y from labels_l
            union all select 'm_inc', round(m_inc, 9), y from labels_l) a group by score, v) h
        window w as (partition by score order by v desc)) c
      group by score) m"""


def _weak(s, d):
    i = Inputs(s, d)
    return la.weak_pairs(i.scores("A", often=True), i.patients(), 0.3)


def _hard_negatives(s, d):
    i, labels = _labels(s, d, often=True)
    best = tk.best_pairs(labels, i.patients(), "patient_id", 1, condition="y = 1")
    return la.hard_negatives(labels, best.select("patient_id", "trial_id"))


def _top_patients(s, d):
    i = Inputs(s, d)
    return rounded(tk.best_pairs(i.scores("L"), i.patients(), "trial_id", 10).select("trial_id", "patient_id", "rank", "m_inc"), "m_inc")


def _pair_sanity(s, d):
    i, labels = _labels(s, d)
    n_patients = i.patients().agg(F.count("*")).scalar()
    # One pass over the pairs; those without a hit have the default score of their trial.
    inc, exc = F.col("m_inc") > 0, F.col("m_exc") > 0
    hit = labels.by_trial([
        Measure("n_inc", "cast(m_inc > 0 as int)", lambda have, trial: have["m_inc"] > 0), Measure("n_exc", "cast(m_exc > 0 as int)", lambda have, trial: have["m_exc"] > 0),
        Measure("n_both", "cast(m_inc > 0 and m_exc > 0 as int)", lambda have, trial: (have["m_inc"] > 0) & (have["m_exc"] > 0)),
        Measure("total", "m_inc", lambda have, trial: have["m_inc"], whole=False),
        Measure("top_inc", "m_inc", lambda have, trial: have["m_inc"], whole=False, top=True),
        Measure("top_exc", "m_exc", lambda have, trial: have["m_exc"], whole=False, top=True)])
    rest = n_patients - F.coalesce("n", F.lit(0))
    whole = labels.defaults.select("trial_id", "m_inc", "m_exc").join(hit, "trial_id", "left").withColumn("rest", rest)

    def both(counted: str, where: Column) -> Column:
        return F.sum(F.coalesce(counted, F.lit(0)) + F.when(where, F.col("rest")).otherwise(0))

    def top(hits: str, default: str) -> Column:
        return F.max(F.greatest(hits, F.when(F.col("rest") > 0, F.col(default))))

    n_pairs = F.count("*") * n_patients
    out = whole.agg(
        n_pairs.alias("n_pairs"), (both("n_inc", inc) / n_pairs).alias("share_inc"), (both("n_exc", exc) / n_pairs).alias("share_exc"),
        (both("n_both", inc & exc) / n_pairs).alias("share_both"),
        (F.sum(F.coalesce("total", F.lit(0.0)) + F.col("m_inc") * F.col("rest")) / n_pairs).alias("mean_inc"),
        top("top_inc", "m_inc").alias("max_inc"), top("top_exc", "m_exc").alias("max_exc"))
    return rounded(out, "share_inc", "share_exc", "share_both", "mean_inc", "max_inc", "max_exc")


def _coverage(s, d):
    i = Inputs(s, d)
    df = qu.coverage_report(i.criteria(), i.codes())
    return rounded(df.withColumn("missed_examples", F.array_join("missed_examples", ",")), "matched_pct")


def _with(fn):
    return lambda s, d: fn(Inputs(s, d).criteria(), Inputs(s, d).codes())


def _oov(s, d):
    i = Inputs(s, d)
    return qu.oov_examples(i.criteria(), i.codes()).withColumn("examples", F.array_join("examples", ","))


def _raw_criteria(i: Inputs):
    return i.criteria().withColumn("raw_entity", F.concat(F.col("entity_type"), F.lit(" ("), F.col("entity_code"), F.lit(")")))


RAW_SQL = "(select *, entity_type || ' (' || entity_code || ')' as raw_entity from criteria) r"

QUERIES = {
    "match_rule_label": Query(_pairs("L"), _pairs_sql("dense_l")),
    "match_rule_graph": Query(_pairs("A"), _pairs_sql("dense_a")),
    "match_rule_engine": Query(_pairs("B"), _pairs_sql("dense_b")),
    "match_rule_engine_hierarchy": Query(_pairs("B", True), _pairs_sql("dense_bh")),
    "trial_default_scores": Query(_defaults, _q("""
        select t.trial_id, coalesce(max(n_inc), 0) as n_inc, coalesce(max(n_exc), 0) as n_exc, coalesce(round(max(i), 6), 1e0) as m_inc, coalesce(round(max(e), 6), 0e0) as m_exc,
          cast(coalesce(max(i), 1e0) >= 0.15e0 and coalesce(max(e), 0e0) < 0.8e0 as int) as y
        from (select distinct trial_id from criteria) t left join (
          select trial_id, count(*) filter (where is_inclusion) as n_inc, count(*) filter (where not is_inclusion) as n_exc,
            coalesce(sum(case when operator = 'NOT_EXISTS' then severity_weight else 0 end) filter (where is_inclusion) / count(*) filter (where is_inclusion), 1e0) as i,
            coalesce(max(case when operator = 'NOT_EXISTS' then severity_weight else 0 end) filter (where not is_inclusion), 0e0) as e
          from crit_l group by trial_id) c on t.trial_id = c.trial_id group by t.trial_id""")),
    "match_strict": Query(_strict, _q("select patient_id, trial_id, matched from strict_b where any_hit")),
    "code_closure": Query(_closure, _q("select code, ancestor, cast(min(depth) as int) as depth from closure group by code, ancestor")),
    "hierarchy_match": Query(_hierarchy_match, _q("""
        with dx as (select distinct entity_code as code2 from criteria where entity_type = 'diagnosis' and not starts_with(entity_code, 'UNMATCHED')),
        cats as (select substr(code, 1, 3) as cat, min(code) as first from pcodes where entity_type = 'diagnosis' group by 1),
        half as (select distinct code2, unnest([first, cat, substr(cat, 1, 1)]) as code1 from dx join cats on substr(code2, 1, 3) = cat),
        pairs as (select code1, code2 from half union select code2, code1 from half)
        select p.code1, p.code2, case when p.code1 = p.code2 then 1e0
          when exists (select 1 from closure a where a.code = p.code2 and a.ancestor = p.code1) then 0.8e0
          when exists (select 1 from closure a where a.code = p.code1 and a.ancestor = p.code2) then 0.6e0 else 0e0 end as match_score
        from pairs p""")),
    "category_align": Query(_align, _q("""
        with v as (select distinct code from pcodes where entity_type = 'diagnosis')
        select c.code, coalesce(e.code, n.code) as aligned_code,
          case when e.code is not null then 'exact' when n.code is not null then 'category' else 'none' end as how
        from (select distinct entity_code as code from criteria where entity_type = 'diagnosis') c
        left join v e on e.code = c.code
        left join (select code, substr(code, 1, 3) as cat, row_number() over (partition by substr(code, 1, 3) order by length(code), code) as r from v) n
          on n.r = 1 and n.cat = substr(c.code, 1, 3)""")),
    "ingredient_align": Query(_align_meds, _q("""
        with cw as (select lpad(cast(10000 + p_partkey % 300 as varchar), 11, '0') as ndc, min(lower(p_brand)) as ing from part group by 1),
        co as (select distinct code as ndc from pcodes where entity_type = 'medication' and substr(code, -1, 1) < '5'),
        rep as (select ing, min(co.ndc) as ndc from co join cw on co.ndc = cw.ndc group by ing)
        select c.code, coalesce(co.ndc, rep.ndc) as aligned_code
        from (select distinct entity_code as code from criteria where entity_type = 'medication') c
        left join co on co.ndc = c.code left join cw on cw.ndc = c.code left join rep on rep.ing = cw.ing""")),
    "eligibility_label": Query(
        lambda s, d: la.trial_positives(_labels(s, d)[1], Inputs(s, d).patients()).select("trial_id", "n_hit", "n_pos"),
        _q("select trial_id, count(*) filter (where any_hit) as n_hit, cast(sum(y) as bigint) as n_pos from labels_l group by trial_id")),
    "informative_trials": Query(_informative, _q("""
        select trial_id, cast(sum(y) as bigint) as n_pos from labels_l group by trial_id
        having max(n_inc) > 0 and sum(y) > 0 and sum(y) < count(*)""")),
    "label_stats": Query(_label_stats, _q("""
        with t as (select trial_id, sum(y) as n_pos, count(*) as n from labels_l group by trial_id),
        p as (select patient_id, sum(y) as n_pos from labels_l group by patient_id)
        select count(*) as n_trials, max(n) as n_patients, cast(sum(n_pos) as bigint) as n_pos, round(sum(n_pos) / sum(n), 6) as prevalence,
          count(*) filter (where n_pos > 0) as trials_with_any, count(*) filter (where n_pos = n) as trials_with_all,
          quantile_cont(n_pos, 0.5) as median_pos_per_trial, cast(max(n_pos) as bigint) as max_pos_per_trial,
          (select count(*) from p where n_pos > 0) as patients_with_any from t""")),
    "leakage_audit": Query(_leakage, _q(AUC_SQL)),
    "weak_pairs": Query(_weak, _q("select patient_id, trial_id from dense_a where m_inc >= 0.3e0")),
    "hard_negatives": Query(_hard_negatives, _q("""
        with scored as materialized (select patient_id, trial_id, m_inc, m_exc, y from labels_l),
        best as (select patient_id, trial_id from (
          select *, row_number() over (partition by patient_id order by round(m_inc, 9) desc, trial_id) as r from scored where y = 1) t where r = 1)
        select b.patient_id, b.trial_id, l.trial_id as negative_trial_id from best b join scored l on l.patient_id = b.patient_id
        where l.m_inc >= 0.15e0 and l.m_exc >= 0.8e0 and l.trial_id <> b.trial_id""")),
    "topk_patients_per_trial": Query(_top_patients, _q("""
        select trial_id, patient_id, cast(r as int) as rank, round(m, 6) as m_inc from (
          select *, round(m_inc, 9) as m, row_number() over (partition by trial_id order by round(m_inc, 9) desc, patient_id) as r
          from dense_l) t where r <= 10""")),
    "pair_sanity": Query(_pair_sanity, _q("""
        select count(*) as n_pairs, round(avg(cast(m_inc > 0 as int)), 6) as share_inc, round(avg(cast(m_exc > 0 as int)), 6) as share_exc,
          round(avg(cast(m_inc > 0 and m_exc > 0 as int)), 6) as share_both, round(avg(m_inc), 6) as mean_inc,
          round(max(m_inc), 6) as max_inc, round(max(m_exc), 6) as max_exc from dense_l""")),
    "trial_sanity": Query(
        lambda s, d: rounded(re_.trial_sanity(Inputs(s, d).scores("L"), Inputs(s, d).patients().agg(F.count("*")).scalar()), "share_inc", "share_exc"),
        _q("""select trial_id, round(count(*) filter (where m_inc > 0) / count(*), 6) as share_inc,
            round(count(*) filter (where m_exc > 0) / count(*), 6) as share_exc from dense_l group by trial_id""")),
    "coverage_rollup": Query(_coverage, _q("""
        with k as (select * from criteria_vocab where entity_type in ('diagnosis', 'medication', 'lab')),
        g as (select entity_type, count(*) filter (where in_vocab) as n_matched, count(*) filter (where not ph) as n_attempted,
            count(*) filter (where ph) as n_placeholder, count(*) as n_total from k group by rollup (entity_type)),
        m as (select distinct entity_type, entity_code from k where not in_vocab and not ph
              union select distinct 'TOTAL', entity_code from k where not in_vocab and not ph),
        x as (select entity_type, string_agg(entity_code, ',' order by entity_code) as missed from (
            select *, row_number() over (partition by entity_type order by entity_code) as r from m) t where r <= 10 group by entity_type)
        select g.*, coalesce(x.missed, '') as missed_examples, coalesce(round(100e0 * n_matched / nullif(n_attempted, 0), 6), 0e0) as matched_pct
        from g left join x on x.entity_type = coalesce(g.entity_type, 'TOTAL')""")),
    "resolution_pivot": Query(
        lambda s, d: rounded(qu.resolution_pivot(Inputs(s, d).criteria(), Inputs(s, d).codes()), "resolved_pct"), _q("""
        select entity_type, side, count(*) filter (where aligned = 'RESOLVED') as n_resolved, count(*) filter (where aligned = 'OOV') as n_oov,
          count(*) filter (where aligned = 'UNMATCHED_PLACEHOLDER') as n_unmatched, count(*) filter (where aligned = 'RESOLVED_VIA_ALIGNMENT') as n_via_alignment,
          count(*) as n_total, round(100e0 * count(*) filter (where aligned = 'RESOLVED') / count(*), 6) as resolved_pct
        from (select *, case when is_inclusion then 'inclusion' else 'exclusion' end as side from criteria_status) t
        group by grouping sets ((entity_type, side), ())""")),
    "oov_examples": Query(_oov, _q("""
        select entity_type, string_agg(e, ',' order by e) as examples from (
          select entity_type, e, row_number() over (partition by entity_type order by e) as r from (
            select distinct entity_type, entity_code || ' -> normalized: ' || entity_code as e from criteria_status where status = 'OOV') u) t
        where r <= 15 group by entity_type""")),
    "zero_resolved_trials": Query(_with(qu.unresolved_trials), _q("""
        select count(*) as n_trials, count(*) filter (where i0 = 0) as zero_inc, count(*) filter (where e0 = 0) as zero_exc,
          count(*) filter (where i0 = 0 and e0 = 0) as zero_both, count(*) filter (where i1 = 0) as zero_inc_aligned,
          count(*) filter (where e1 = 0) as zero_exc_aligned, count(*) filter (where i1 = 0 and e1 = 0) as zero_both_aligned
        from (select trial_id, count(*) filter (where is_inclusion and status = 'RESOLVED') as i0, count(*) filter (where not is_inclusion and status = 'RESOLVED') as e0,
            count(*) filter (where is_inclusion and aligned like 'RESOLVED%') as i1, count(*) filter (where not is_inclusion and aligned like 'RESOLVED%') as e1
          from criteria_status group by trial_id) t""")),
    "missing_codes": Query(_with(qu.missing_codes), _q("""
        select entity_code as code, count(*) as n from criteria where entity_code not in (select code from pcodes)
        group by 1 order by n desc, 1 limit 10""")),
    "matching_trials": Query(_with(qu.matching_trials), _q("select distinct trial_id from criteria where entity_code in (select code from pcodes)")),
    "code_magnets": Query(
        lambda s, d: qu.code_magnets(Inputs(s, d).criteria().withColumn("raw_entity", F.concat_ws(" ", "trial_id", "criterion_idx"))),
        _q("""select entity_code, count(distinct cast(trial_id as varchar) || ' ' || cast(criterion_idx as varchar)) as n_texts
            from criteria group by 1 having count(distinct cast(trial_id as varchar) || ' ' || cast(criterion_idx as varchar)) > 15""")),
    "conflicting_bounds": Query(
        lambda s, d: qu.conflicting_bounds(Inputs(s, d).criteria(), "entity_code"),
        _q("""select trial_id, lower(entity_code) as entity, count(distinct operator || '|' || cast(value as varchar)) as n_bounds
            from criteria where operator <> 'EXISTS' and value is not null group by 1, 2
            having count(distinct operator || '|' || cast(value as varchar)) > 1""")),
    "criteria_validation": Query(
        lambda s, d: qu.validate_criteria(_raw_criteria(Inputs(s, d))), _q(f"""
        select count(distinct trial_id) as n_trials, count(*) as n_criteria, count(*) filter (where entity_code <> 'UNKNOWN_CODE') as n_mapped,
          count(*) filter (where operator in ('LTE', 'GTE', 'LT', 'GT', 'EQ') and value is not null) as n_numeric,
          count(*) filter (where operator in ('LTE', 'GTE', 'LT', 'GT', 'EQ') and value is null) as n_missing_value,
          count(*) filter (where is_inclusion) as n_inclusion, count(*) filter (where not is_inclusion) as n_exclusion,
          cast(0 as bigint) as n_stop_words, count(*) filter (where contains(raw_entity, '(') or contains(raw_entity, ')')) as n_unsanitized,
          count(*) as n_true_mapped,
          (select count(*) from (select trial_id, entity_type, entity_code from criteria where operator <> 'EXISTS' and value is not null
             group by 1, 2, 3 having count(distinct operator || '|' || cast(value as varchar)) > 1) c) as n_conflicts
        from {RAW_SQL}""")),
    "criteria_violations": Query(
        lambda s, d: qu.violations(_raw_criteria(Inputs(s, d))).groupBy("problem").agg(F.count("*").alias("n")),
        _q(f"select 'unsanitized' as problem, count(*) as n from {RAW_SQL} where contains(raw_entity, '(')")),
    "inc_exc_balance": Query(
        lambda s, d: qu.inclusion_balance(Inputs(s, d).criteria()), _q("""
        select count(*) as n_trials, cast(sum(i) as bigint) as n_inclusion, cast(sum(e) as bigint) as n_exclusion,
          count(*) filter (where i = 0) as trials_without_inclusion, count(*) filter (where e = 0) as trials_without_exclusion, cast(0 as bigint) as n_suspicious
        from (select trial_id, count(*) filter (where is_inclusion) as i, count(*) filter (where not is_inclusion) as e from criteria group by 1) t""")),
    "icd9_share": Query(
        lambda s, d: rounded(qu.icd9_share(Inputs(s, d).criteria().withColumn("entity_code", F.coalesce(F.nullif(F.regexp_replace("entity_code", "^UNMATCHED_", ""), F.lit("")), F.col("entity_code")))), "icd9_share"),
        _q("""select count(*) as n_diagnosis, count(*) filter (where starts_with(entity_code, 'UNMATCHED_')) as n_icd9,
            round(count(*) filter (where starts_with(entity_code, 'UNMATCHED_')) / count(*), 6) as icd9_share from criteria where entity_type = 'diagnosis'""")),
    "dataset_summary": Query(
        lambda s, d: rounded(qu.dataset_summary(Inputs(s, d).criteria(), Inputs(s, d).codes()), "mean_inc", "mean_exc", "mean_dx_per_patient"), _q("""
        select count(*) as n_trials, round(avg(i), 6) as mean_inc, round(avg(e), 6) as mean_exc,
          (select count(distinct patient_id) from pcodes) as n_patients,
          (select round(count(*) filter (where entity_type = 'diagnosis') / count(distinct patient_id), 6) from pcodes) as mean_dx_per_patient
        from (select trial_id, count(*) filter (where is_inclusion) as i, count(*) filter (where not is_inclusion) as e from criteria group by 1) t""")),
}
