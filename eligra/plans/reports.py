"""Priors, corrections, report tables, split checks and registry texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligra.functions import text as tx
from eligra.operators import labels as la
from eligra.operators import metrics as me
from eligra.operators import models as mo
from eligra.operators import report as rp
from eligra.operators import splits as sp
from eligra.plans.base import Inputs, Query, rounded, sql
from eligra.plans.evaluation import RUNS, SPLIT_SQL, _runs, _two_scores
from eligra.sources import trials as tr


def _patient_prior(s, d):
    """Pairs with a hit: those of four trials in five are the training, the others are scored by their patient's share of positives."""
    i = Inputs(s, d)
    labels = la.label_pairs(i.scores("L"))
    trials = labels.defaults.select("trial_id")
    # One score a patient, which the patient's blocks carry to the pairs.
    own = mo.trial_prior(labels.beside(trials=trials.where("trial_id % 5 <> 0")), i.patients(), "patient_id").select("patient_id", "score")
    return rounded(labels.beside(own, trials.where("trial_id % 5 = 0")).select("patient_id", "trial_id", "score"), "score")


PATIENT_PRIOR_SQL = """
    with h as materialized (select patient_id, trial_id, y from labels_l where any_hit), t as (select * from h where trial_id % 5 <> 0),
    o as (select patient_id, avg(y) as own from t group by 1)
    select h.patient_id, h.trial_id, round(coalesce(own, (select avg(y) from t)), 6) as score from h left join o on o.patient_id = h.patient_id where h.trial_id % 5 = 0"""


def _lift(s, d):
    """Lift of both scores in each group, and how far the second one's average precision improves on the first's, in per cent."""
    rows = _two_scores(s, d)
    a, b = (me.curve_metrics(me.histogram(rows, ["group_id"], score=c), ["group_id"]).select(
        "group_id", F.col("lift").alias(f"lift_{n}"), F.col("average_precision").alias(f"ap_{n}")) for n, c in (("a", "score_a"), ("b", "score_b")))
    out = a.join(b, "group_id").select("group_id", "lift_a", "lift_b", me.improvement_pct(F.col("ap_a"), F.col("ap_b")).alias("improvement_pct"))
    return rounded(out, "lift_a", "lift_b", "improvement_pct", digits=4)


LIFT_SQL = """
    with s as (select p.group_id, p.y, unnest(['a', 'b']) as name, unnest([p.score, d.n_chars % 57 / 56e0]) as score from scored_pairs p join documents d on d.doc_id = p.pair_id),
    h as (select group_id, name, score, cast(sum(y) as double) as n_pos, cast(sum(1 - y) as double) as n_neg from s group by 1, 2, 3),
    u as (select *, sum(n_pos) over x as cp, sum(n_neg) over x as cn from h window x as (partition by group_id, name order by score desc)),
    m as (select group_id, name, sum(n_pos * cp / (cp + cn)) / sum(n_pos) as ap, sum(n_pos) / (sum(n_pos) + sum(n_neg)) as prev from u group by 1, 2)
    select a.group_id, round(a.ap / a.prev, 4) as lift_a, round(b.ap / b.prev, 4) as lift_b, round(100 * (b.ap - a.ap) / greatest(a.ap, 0.001e0), 4) as improvement_pct
    from m a join m b on b.group_id = a.group_id and b.name = 'b' where a.name = 'a'"""


def _corrected(s, d):
    """Weight of each scored pair, and its score without the shift of negatives sampled at one in twenty."""
    rows = mo.class_weight(Inputs(s, d).view("scored_pairs"))
    return rounded(rows.select("pair_id", "weight", mo.prior_corrected(F.col("score"), 0.05).alias("p")), "weight", "p")


CORRECTED_SQL = """
    with r as (select least(count(*) filter (where y = 0) / count(*) filter (where y = 1), 100e0) as ratio from scored_pairs)
    select pair_id, round(case when y = 1 then coalesce(ratio, 1e0) else 1e0 end, 6) as weight, round(score / (score + (1 - score) / 0.05e0), 6) as p from scored_pairs, r"""


def _primary(s, d):
    table = rp.results_report(_runs(s, d), ["pooled_roc_auc", "pooled_pr_auc"], "Brand#11", "pooled_roc_auc")["primary"]
    return rounded(table, "pooled_roc_auc_mean", "pooled_roc_auc_std", "pooled_pr_auc_mean", "pooled_pr_auc_std")


PRIMARY_SQL = f"""
    select regime, model, round(avg(pooled_roc_auc), 6) as pooled_roc_auc_mean, round(stddev_samp(pooled_roc_auc), 6) as pooled_roc_auc_std, count(pooled_roc_auc) as pooled_roc_auc_count,
      round(avg(pooled_pr_auc), 6) as pooled_pr_auc_mean, round(stddev_samp(pooled_pr_auc), 6) as pooled_pr_auc_std, count(pooled_pr_auc) as pooled_pr_auc_count
    from ({RUNS}) runs where split = 'test' and regime <> 'oracle' group by regime, model"""


def _moved(s, d):
    """Patients that two seeds put into different splits: the check that finds leaks finds all of them."""
    ids = Inputs(s, d).patients()
    both = sp.partition_ids(ids, "patient_id", 0).unionByName(sp.partition_ids(ids, "patient_id", 1))
    return sp.overlapping_ids(both, "patient_id")


MOVED_SQL = ("select patient_id, count(distinct split) as n_splits from (" + " union all ".join(
    f"select patient_id, split from ({SPLIT_SQL.format(k='patient_id', seed=seed, t='patients')}) s{seed}" for seed in (0, 1)) +
    ") u group by patient_id having count(distinct split) > 1")


def _registry(s, d):
    """Studies of a registry as JSON texts, made of the documents, some fields missing, two studies in every fourth text, read back into flat rows."""
    docs = Inputs(s, d).table("documents")
    k = F.col("doc_id")

    def study(name):
        return F.struct(F.struct(
            F.struct(name.alias("nctId"), F.when(k % 5 != 0, F.col("source")).alias("briefTitle")).alias("identificationModule"),
            F.struct(F.when(k % 3 != 0, F.array("lang", "source")).alias("conditions")).alias("conditionsModule"),
            F.struct(F.when(k % 7 != 0, F.array(F.concat(F.lit("PHASE"), (k % 4).cast("string")))).alias("phases"),
                     F.struct(F.when(k % 6 != 0, k.cast("int")).alias("count")).alias("enrollmentInfo")).alias("designModule"),
            F.struct(F.lit("COMPLETED").alias("overallStatus")).alias("statusModule"),
            F.struct(F.col("text").alias("eligibilityCriteria")).alias("eligibilityModule")).alias("protocolSection"))

    one, two = study(F.format_string("NCT%08d", k)), study(F.format_string("NCT%08dB", k))
    json = F.when(k % 4 == 0, F.to_json(F.struct(F.array(one, two).alias("studies")))).otherwise(F.to_json(one))
    rows = tr.study_rows(tr.parse_studies(docs.select(k.alias("row"), json.alias("json")), "json", "row"))
    told = tx.trial_text(F.col("title"), F.col("conditions"), F.array("eligibility_criteria"))
    return rows.select("trial_id", "title", F.array_join("conditions", "|").alias("conditions"), "phase", "sample_size", "overall_status",
                       F.md5(told).alias("text_md5"))


REGISTRY_SQL = """
    with s as (select doc_id as k, unnest(case when doc_id % 4 = 0 then ['', 'B'] else [''] end) as tail, text, lang, source from documents),
    f as (select 'NCT' || lpad(cast(k as varchar), 8, '0') || tail as trial_id, case when k % 5 <> 0 then coalesce(source, 'Unknown') else 'Unknown' end as title,
      case when k % 3 <> 0 then [lang, source] else [] end as c, case when k % 7 <> 0 then 'PHASE' || cast(k % 4 as varchar) else 'NA' end as phase,
      cast(case when k % 6 <> 0 then k else 100 end as int) as sample_size, coalesce(text, '') as t from s)
    select trial_id, title, array_to_string(c, '|') as conditions, phase, sample_size, 'COMPLETED' as overall_status,
      md5(array_to_string(list_filter(list_concat([title], c, [t]), lambda x: x is not null and x <> ''), ' ')) as text_md5 from f"""

QUERIES = {
    "patient_prior_scores": Query(_patient_prior, sql(PATIENT_PRIOR_SQL)),
    "lift_improvement": Query(_lift, sql(LIFT_SQL)),
    "corrected_scores": Query(_corrected, sql(CORRECTED_SQL)),
    "report_primary": Query(_primary, PRIMARY_SQL),
    "moved_patients": Query(_moved, sql(MOVED_SQL)),
    "registry_studies": Query(_registry, REGISTRY_SQL),
}
