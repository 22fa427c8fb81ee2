"""Ranking metrics, calibration, bootstrap, splits, sampling and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligra.functions.permutation import permuted_sql
from eligra.operators import labels as la
from eligra.operators import match as mt
from eligra.operators import metrics as me
from eligra.operators import models as mo
from eligra.operators import ranking as ra
from eligra.operators import report as rp
from eligra.operators import resampling as rs
from eligra.operators import splits as sp
from eligra.plans.base import Inputs, Query, rounded, sql
from eligra.plans.matching import EXTRA as MATCHING

# Stage results of runs: one row per supplier nation (seed) and part brand (model), from real columns.
RUNS = """
    select p_brand as model, case when s_nationkey % 4 = 0 then 'oracle' else 'honest' end as regime, 'test' as split,
      cast(s_nationkey as int) as seed, 0.4e0 + avg(l_discount) * 5e0 as pooled_roc_auc,
      0.3e0 + avg(l_tax) * 5e0 as trial_roc_auc, avg(l_discount * l_tax) * 100e0 as pooled_pr_auc
    from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
    group by p_brand, s_nationkey"""
CURVE = """
    select {g} cast(sum(n_pos) as bigint) as n_pos, cast(sum(n_neg) as bigint) as n_neg,
      round(sum(n_neg * (cum_pos - n_pos / 2e0)) / nullif(sum(n_pos) * sum(n_neg), 0), 6) as roc_auc,
      round(sum(n_pos * cum_pos / (cum_pos + cum_neg)) / nullif(sum(n_pos), 0), 6) as average_precision,
      round(sum(n_pos) / (sum(n_pos) + sum(n_neg)), 6) as prevalence
    from (select *, sum(n_pos) over w as cum_pos, sum(n_neg) over w as cum_neg
      from (select {g} score, cast(sum(y) as double) as n_pos, cast(sum(1 - y) as double) as n_neg from {t} group by {g} score) h
      window w as ({p} order by score desc)) c {b}"""
RANKED = """
    select *, row_number() over (partition by group_id order by score desc, pair_id) as rank,
      count(*) over (partition by group_id) as n, sum(y) over (partition by group_id) as n_pos from scored_pairs"""
IDCG = "list_sum(list_transform(range(1, cast(least(n_pos, {k}) as bigint) + 1), lambda i: 1 / log2(i + 1)))"


def _curve_sql(table: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    return CURVE.format(g=g, t=table, p=f"partition by {group}" if group else "", b=f"group by {group}" if group else "")


EXTRA = {**MATCHING, "ranked": RANKED, "runs": RUNS}


def _q(body: str) -> str:
    return sql(body, EXTRA)


def _scored(s, d):
    return Inputs(s, d).view("scored_pairs")


def _runs(s, d):
    i = Inputs(s, d)
    for t in ("lineitem", "part", "supplier"):
        i.table(t).createOrReplaceTempView(t)
    return s.sql(RUNS)


CURVE_COLUMNS = ("roc_auc", "average_precision", "prevalence")


def _curve(group: str | None):
    def run(s, d):
        groups = [group] if group else []
        return rounded(me.curve_metrics(me.histogram(_scored(s, d), groups), groups).drop("lift"), *CURVE_COLUMNS)
    return run


def _top(s, d):
    out = me.top_k_metrics(_scored(s, d), "group_id", "pair_id", (5, 10))
    return rounded(out, *[c for c in out.columns if c != "group_id"])


def _top_sql() -> str:
    cols = []
    for k in (5, 10):
        hits = f"count(*) filter (where rank <= {k} and y = 1)"
        dcg = f"coalesce(sum(1 / log2(rank + 1)) filter (where rank <= {k} and y = 1), 0)"
        cols += [
            f"round({hits} / least({k}, max(n)), 6) as precision_at_{k}", f"round({hits} / max(n_pos), 6) as recall_at_{k}",
            f"round({dcg} / {IDCG.format(k=k).replace('n_pos', 'max(n_pos)')}, 6) as ndcg_at_{k}",
            f"round({hits} / least({k}, max(n)) - max(n_pos) / max(n), 6) as delta_sfr_at_{k}"]
    return _q(f"select group_id, {', '.join(cols)} from ranked group by group_id having max(n_pos) > 0")


def _tied(s, d):
    return rounded(me.tied_ndcg(_scored(s, d), "group_id", 10), "ndcg_at_10")


TIED_SQL = """
    select group_id, round(sum(g * disc) / """ + IDCG.format(k=10).replace("n_pos", "max(n_pos)") + """, 6) as ndcg_at_10
    from (select group_id, n_pos, avg(y) over (partition by group_id, score) as g, case when rank <= 10 then 1 / log2(rank + 1) else 0 end as disc from ranked) t
    group by group_id having max(n_pos) > 0"""


def _mrr(s, d):
    return rounded(me.reciprocal_rank(_scored(s, d), "group_id", "pair_id"), "mrr")


def _grouped(s, d):
    out = me.grouped_metrics(_scored(s, d), "group_id", "pair_id", (5, 10))
    return rounded(out, *[c for c in out.columns if not c.startswith("n_")])


def _grouped_sql() -> str:
    cols = ["avg(auc) as roc_auc", "avg(ap) as average_precision", "avg(1 / first) as mrr"]
    inner = ["min(rank) filter (where y = 1) as first", "max(n) as n", "max(n_pos) as n_pos"]
    for k in (5, 10):
        inner += [f"count(*) filter (where rank <= {k} and y = 1) as h{k}", f"coalesce(sum(1 / log2(rank + 1)) filter (where rank <= {k} and y = 1), 0) as d{k}"]
        cols += [f"avg(h{k} / least({k}, n)) as precision_at_{k}", f"avg(h{k} / n_pos) as recall_at_{k}", f"avg(d{k} / {IDCG.format(k=k)}) as ndcg_at_{k}"]
    rounded_cols = [f"round({c.rsplit(' as ', 1)[0]}, 6) as {c.rsplit(' as ', 1)[1]}" for c in cols]
    return _q(f"""
        with a as (select group_id, roc_auc as auc, average_precision as ap from ({_curve_sql('scored_pairs', 'group_id')}) x),
        r as (select group_id, {', '.join(inner)} from ranked group by group_id having max(n_pos) > 0)
        select {', '.join(rounded_cols)}, count(*) as n_groups_used, (select count(distinct group_id) from scored_pairs) as n_groups_total
        from r join a on a.group_id = r.group_id""")


def _retrieval(s, d):
    out = me.retrieval_metrics(_scored(s, d), "group_id", "pair_id", (5, 10))
    return rounded(out, *[c for c in out.columns if c != "n_trials_used"])


def _retrieval_sql() -> str:
    parts = []
    for k in (5, 10):
        parts += [f"round(avg(h{k} / least({k}, n)), 6) as precision_at_{k}", f"round(avg(h{k} / least({k}, n) - n_pos / n), 6) as delta_sfr_at_{k}",
                  f"round(avg(t{k} / {IDCG.format(k=k)}), 6) as ndcg_at_{k}"]
    inner = ", ".join(f"count(*) filter (where rank <= {k} and y = 1) as h{k}, sum(case when rank <= {k} then g / log2(rank + 1) else 0 end) as t{k}" for k in (5, 10))
    return _q(f"""select {', '.join(parts)}, count(*) as n_trials_used from (
        select group_id, max(n) as n, max(n_pos) as n_pos, {inner} from (
          select *, avg(y) over (partition by group_id, score) as g from ranked) t group by group_id having max(n_pos) > 0) r""")


def _calibration(s, d):
    return rounded(me.calibration(_scored(s, d)), "brier", "ece", "mean_pred", "mean_label")


CAL_SQL = """
    with p as (select y, least(greatest(score, 1e-7), 1 - 1e-7) as p from scored_pairs),
    b as (select least(floor(p * 15), 14) as b, sum(p) as sp, sum(y) as sy, sum((p - y) * (p - y)) as sq, count(*) as n from p group by 1)
    select round(sum(sq) / sum(n), 6) as brier, round(sum(abs(sy - sp)) / sum(n), 6) as ece, round(sum(sp) / sum(n), 6) as mean_pred,
      round(sum(sy) / sum(n), 6) as mean_label from b"""


def _strict_accuracy(s, d):
    """Strict match as label, M_inc as score, over all pairs of trials with something to assess."""
    i = Inputs(s, d)
    return rounded(me.strict_agreement(mt.strict_scores(i.criteria(), i.codes()).rounded(6), i.patients(), 0.5), "accuracy")


def _strict_sweep(s, d):
    return rounded(me.strict_sweep(_scored(s, d)), "prob", "threshold", "accuracy")


PERCENTS = "[" + ", ".join(f"{p / 100}e0" for p in range(1, 100)) + "]"
SWEEP_SQL = f"""
    with t as (select unnest({PERCENTS}) as prob, unnest(quantile_cont(score, {PERCENTS})) as threshold from scored_pairs)
    select round(prob, 6) as prob, round(threshold, 6) as threshold, round(avg(cast((score >= threshold) = (y = 1) as int)), 6) as accuracy
    from t cross join scored_pairs group by prob, threshold"""


def _quantiles(s, d):
    df = Inputs(s, d).table("lineitem")
    return rounded(ra.exact_quantiles(df, "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99]), "quantile", digits=4)


def _priors(s, d):
    rows = _scored(s, d).withColumnRenamed("score", "old")
    train = rows.where(F.col("pair_id") < 0.7 * Inputs(s, d).table("documents").agg(F.max("doc_id")).scalar())
    return rounded(mo.trial_prior(train.where("group_id <> 3"), rows, "group_id").select("pair_id", "score"), "score")


PRIOR_SQL = """
    with train as (select * from scored_pairs where pair_id < 0.7e0 * (select max(doc_id) from documents) and group_id <> 3)
    select p.pair_id, round(coalesce(o.m, (select avg(y) from train)), 6) as score
    from scored_pairs p left join (select group_id, avg(y) as m from train group by 1) o on o.group_id = p.group_id"""

# The seeded shuffle in SQL: order by md5 of seed|id.
SPLIT_SQL = """
    select {k}, case when pos < round_even(0.7e0 * n, 0) then 'train' when pos < round_even(0.7e0 * n, 0) + round_even(0.15e0 * n, 0) then 'val' else 'test' end as split
    from (select {k}, row_number() over (order by md5('{seed}|' || cast({k} as varchar)), {k}) - 1 as pos, count(*) over () as n from {t}) x"""


def _patient_split(s, d):
    return sp.partition_ids(Inputs(s, d).patients(), "patient_id", 0)


def _floor_split(s, d):
    return sp.partition_ids(Inputs(s, d).patients(), "patient_id", 3, rounding="floor")


def _prevalence(i: Inputs, labels):
    return la.trial_positives(labels, i.patients()).select("trial_id", (F.col("n_pos") / F.col("n_patients")).alias("prevalence"))


def _trial_split(s, d):
    i = Inputs(s, d)
    prevalence = _prevalence(i, la.label_pairs(i.scores("L")))
    return sp.partition_ids(sp.prevalence_bins(prevalence), "trial_id", 1, bins="bin")


TRIAL_SPLIT_SQL = """
    with prev as (select trial_id, avg(y) as p from labels_l group by trial_id),
    e as (select quantile_cont(p, [0.25, 0.5, 0.75]) as edges, count(*) as n from prev),
    b as (select trial_id, len(list_filter(edges, lambda x: x <= p)) as bin from prev, e),
    r as (select *, row_number() over (partition by bin order by md5('1|' || cast(trial_id as varchar)), trial_id) - 1 as pos, count(*) over (partition by bin) as n from b)
    select trial_id, cast(bin as int) as bin, case when pos < round_even(0.7e0 * n, 0) then 'train' when pos < round_even(0.7e0 * n, 0) + round_even(0.15e0 * n, 0) then 'val' else 'test' end as split
    from r"""


def _splits(s, d, often: bool = False):
    i = Inputs(s, d)
    labels = la.label_pairs(i.scores("L", often))
    trials = labels.defaults.select("trial_id")
    return i, labels, sp.partition_ids(i.patients(), "patient_id", 0), sp.partition_ids(trials, "trial_id", 1)


def _quadrants(s, d):
    i, labels, p, t = _splits(s, d)
    return sp.quadrant_sizes(labels, p, t)


QUAD = """
    with p as (""" + SPLIT_SQL.format(k="patient_id", seed=0, t="patients") + """),
    t as (""" + SPLIT_SQL.format(k="trial_id", seed=1, t="(select distinct trial_id from criteria) u") + """),
    q as (select l.*, case when p.split = t.split then p.split when p.split = 'test' and t.split = 'train' then 'cold_patient_only'
        when p.split = 'train' and t.split = 'test' then 'cold_trial_only' end as quadrant
      from labels_l l join p on p.patient_id = l.patient_id join t on t.trial_id = l.trial_id)"""


def _dense_test(s, d):
    i, labels, p, t = _splits(s, d)
    grid = sp.dense_pairs(labels, p.where("split = 'test'"), t.where("split = 'test'"))
    return rounded(grid.select("patient_id", "trial_id", "m_inc", "m_exc", "y"), "m_inc", "m_exc")


def _subsample(s, d):
    _, labels, p, t = _splits(s, d, often=True)
    return sp.sample_training_pairs(labels, p.where("split = 'train'"), t.where("split = 'train'"), 7, neg_per_pos=2, max_pairs=20_000, min_negatives=1000)


# The pairs of the training quadrant by number, and where the permutation puts each draw.
SUBSAMPLE_SQL = QUAD + """,
    tr as materialized (select patient_id, trial_id, y, dense_rank() over (order by patient_id) - 1 as pp, dense_rank() over (order by trial_id) - 1 as tt from q where quadrant = 'train'),
    size as (select count(*) as n, count(distinct trial_id) as nt, cast(ceil(sqrt(count(*))) as bigint) as fa from tr),
    dim as (select *, (n + fa - 1) // fa as fb from size),
    draws as (select draw, """ + permuted_sql("draw", "n", "fa", "fb", 7) + """ as pair, nt from dim, range((select n from size)) r(draw)),
    neg as (select patient_id, trial_id, y, row_number() over (order by draw) as r from draws join tr on pp = pair // nt and tt = pair % nt where y = 0),
    kept as (select patient_id, trial_id, y from tr where y = 1
      union all select patient_id, trial_id, y from neg where r <= greatest(2 * greatest((select sum(y) from tr), 1), 1000))
    select patient_id, trial_id, y from (select *, row_number() over (order by md5('8|' || patient_id || '|' || trial_id), patient_id, trial_id) as r from kept) k where r <= 20000"""


def _capped(s, d):
    pairs = _scored(s, d).select("pair_id", "y")
    return sp.stratified_cap(pairs, 200, 5, ids=["pair_id"])


CAP_SQL = """
    with n as (select sum(y) as np, count(*) as n from scored_pairs),
    k as (select *, case when n <= 200 then np else least(np, 100) end as kp from n),
    r as (select pair_id, y, row_number() over (partition by y order by md5('5|' || cast(pair_id as varchar)), pair_id) as r from scored_pairs)
    select pair_id, y from r, k where r <= case when y = 1 then kp when n <= 200 then n else 200 - kp end"""


def _folds(s, d):
    return sp.k_folds(Inputs(s, d).criteria(), 5, 2)


def _prefix(s, d):
    trials = Inputs(s, d).table("supplier").select(F.col("s_suppkey").alias("trial_id"), F.col("s_suppkey").alias("seq"))
    return sp.prefix_split(trials).select("trial_id", "split")


def _random_scores(s, d):
    df = sp.random_scores(_scored(s, d).select("pair_id"), 11, ["pair_id"])
    return rounded(df, "score")


# 52 bits of the md5 key, two halves because hex text converts piecewise.
UNIFORM_SQL = "(cast(('0x' || substr({h}, 1, 6)) as bigint) * 268435456e0 + cast(('0x' || substr({h}, 7, 7)) as bigint)) / 4503599627370496e0"


def _negatives(s, d):
    i = Inputs(s, d)
    pairs = la.positive_pairs(la.label_pairs(i.scores("L", often=True)), i.patients())
    drawn = sp.negative_trial_lists(pairs, i.criteria(), 5, 4).where(F.size("negatives") > 0)
    size = lambda c: F.size(c).cast("bigint")
    return drawn.select(
        "patient_id", "trial_id", size("negatives").alias("n"), size(F.array_distinct("negatives")).alias("n_distinct"),
        size(F.filter("negatives", lambda t: t == F.col("trial_id"))).alias("n_own"))


#: Draws of the bootstrap queries.
N_BOOT = 1000


def _bootstrap(s, d):
    return rounded(rs.cluster_bootstrap_ci(_scored(s, d), "group_id", n_boot=N_BOOT), "roc_auc_lo", "roc_auc_hi", "average_precision_lo", "average_precision_hi")


def _draws_sql(scores: str) -> str:
    """CTEs up to m (b, name, auc, ap): both metrics of every draw; ``scores`` gives group_id, y, name, score."""
    return """
    with c as (select group_id, row_number() over (order by md5(cast(group_id as varchar))) - 1 as pos, count(*) over () as n from (select distinct group_id from scored_pairs) g),
    dr as (select b, cast(floor(""" + UNIFORM_SQL.format(h="md5('0|' || b || '|' || k)") + f""" * n) as bigint) as pos
      from range({N_BOOT}) r(b), range((select count(*) from c)) s(k), (select max(n) as n from c) m),
    w as (select b, group_id, count(*) as times from dr join c on c.pos = dr.pos group by 1, 2),
    sc as materialized ({scores}),
    h as (select b, name, score, cast(sum(times * y) as double) as n_pos, cast(sum(times * (1 - y)) as double) as n_neg from w join sc p on p.group_id = w.group_id group by 1, 2, 3),
    u as (select *, sum(n_pos) over x as cp, sum(n_neg) over x as cn from h window x as (partition by b, name order by score desc)),
    m as materialized (select b, name, sum(n_neg * (cp - n_pos / 2)) / (sum(n_pos) * sum(n_neg)) as auc, sum(n_pos * cp / (cp + cn)) / sum(n_pos) as ap from u group by b, name having sum(n_pos) > 0 and sum(n_neg) > 0)"""


TWO_SQL = """select p.group_id, p.y, unnest(['score_a', 'score_b', 'score_c']) as name,
        unnest([p.score, d.n_chars % 57 / 56e0, (p.score + d.n_chars % 57 / 56e0) / 2]) as score from scored_pairs p join documents d on d.doc_id = p.pair_id"""
BOOT_SQL = _draws_sql("select group_id, y, 's' as name, score from scored_pairs") + """
    select count(*) as n_valid, round(quantile_cont(auc, 0.025), 6) as roc_auc_lo, round(quantile_cont(auc, 0.975), 6) as roc_auc_hi,
      round(quantile_cont(ap, 0.025), 6) as average_precision_lo, round(quantile_cont(ap, 0.975), 6) as average_precision_hi from m"""
PAIRED_SQL = _draws_sql(TWO_SQL) + """,
    oh as (select name, score, cast(sum(y) as double) as n_pos, cast(sum(1 - y) as double) as n_neg from sc group by 1, 2),
    ou as (select *, sum(n_pos) over x as cp, sum(n_neg) over x as cn from oh window x as (partition by name order by score desc)),
    o as (select name, sum(n_pos * cp / (cp + cn)) / sum(n_pos) as ap from ou group by name),
    seen as (select max(ap) filter (name = 'score_a') - max(ap) filter (name = 'score_b') as diff from o),
    df as (select a.ap - b.ap as x, avg(a.ap - b.ap) over () as mean from m a join m b on b.b = a.b and b.name = 'score_b' where a.name = 'score_a')
    select round(max(diff), 6) as diff, round(avg(cast(abs(x - mean) >= abs(diff) as int)), 6) as p_value, round(quantile_cont(x, 0.025), 6) as ci_lo,
      round(quantile_cont(x, 0.975), 6) as ci_hi, count(*) as n_boot_used from df, seen"""
SIGN_SQL = _draws_sql(TWO_SQL) + """,
    df as (select a.auc - b.auc as x, avg(a.auc - b.auc) over () as mean from m a join m b on b.b = a.b and b.name = 'score_b' where a.name = 'score_a')
    select round(quantile_cont(x, 0.025), 6) as diff_lo, round(quantile_cont(x, 0.975), 6) as diff_hi,
      case when max(sign(mean)) = 0 then 1e0 else round(least(1e0, 2 * avg(cast(x * sign(mean) <= 0 as int))), 6) end as p_value, count(*) as n_valid from df"""
THREE_SQL = _draws_sql(TWO_SQL) + """
    select name, round(quantile_cont(auc, 0.025), 6) as lo, round(quantile_cont(auc, 0.975), 6) as hi, round(avg(auc), 6) as mean, count(*) as n_valid from m group by name"""


def _two_scores(s, d):
    i = Inputs(s, d)
    docs = i.table("documents").select(F.col("doc_id").alias("pair_id"), (F.col("n_chars") % 57 / 56.0).alias("score_b"))
    return i.view("scored_pairs").withColumnRenamed("score", "score_a").join(docs, "pair_id")


def _paired(s, d):
    return rounded(rs.paired_bootstrap_test(_two_scores(s, d), "group_id", "score_a", "score_b", n_boot=N_BOOT), "diff", "p_value", "ci_lo", "ci_hi")


def _sign(s, d):
    return rounded(rs.sign_bootstrap(_two_scores(s, d), "group_id", "score_b", "score_a", n_boot=N_BOOT), "diff_lo", "diff_hi", "p_value")


def _three(s, d):
    df = _two_scores(s, d).withColumn("score_c", (F.col("score_a") + F.col("score_b")) / 2)
    return rounded(rs.three_way_bootstrap(df, "group_id", ["score_a", "score_b", "score_c"], n_boot=N_BOOT), "lo", "hi", "mean")


def _seed_summary(s, d):
    out = rp.aggregate_results(_runs(s, d), ["pooled_roc_auc", "pooled_pr_auc"])
    return rounded(out, *[c for c in out.columns if c.endswith(("mean", "std"))])


def _wilcoxon(s, d):
    runs = _runs(s, d).where("regime = 'oracle'")
    pairs = runs.select("model", "seed", (F.round("pooled_roc_auc", 9) - F.round("trial_roc_auc", 9)).alias("d"))
    out = rp.wilcoxon(pairs, ["model"]).select("model", "n", "mean_diff", "w_plus", "w_minus", "statistic", "p_value", "min_attainable_p")
    return rounded(out, "mean_diff", "p_value", "min_attainable_p")


WILCOXON_SQL = """
    with p as (select model, round(pooled_roc_auc, 9) - round(trial_roc_auc, 9) as d from runs where regime = 'oracle'),
    r as (select *, rank() over (partition by model order by round(abs(d), 12)) + (count(*) over (partition by model, round(abs(d), 12)) - 1) / 2e0 as r from p where d <> 0),
    w as (select model, sum(case when d > 0 then r else 0 end) as w_plus, sum(case when d < 0 then r else 0 end) as w_minus, list(r) as rs, count(*) as k from r group by model),
    c as (select model, count(*) as hits from (
        select w.model, least(w_plus, w_minus) as s, m, list_sum(list_transform(range(1, k + 1), lambda i: case when (m >> cast(i - 1 as bigint)) & 1 = 1 then rs[i] else 0 end)) as tot
        from w, lateral (select unnest(range(cast(pow(2, k) as bigint))) as m) z) q where tot <= s + 1e-9 group by model)
    select a.model, count(*) as n, round(avg(d), 6) as mean_diff, max(w_plus) as w_plus, max(w_minus) as w_minus, max(least(w_plus, w_minus)) as statistic,
      round(max(least(1e0, 2 * hits / pow(2, k))), 6) as p_value, round(2 / pow(2, count(*)), 6) as min_attainable_p
    from p a join w on w.model = a.model join c on c.model = a.model group by a.model"""


def _compare(s, d):
    runs = _runs(s, d).where("regime = 'oracle'")
    out = rp.compare_to_reference(runs, "Brand#11", "pooled_roc_auc", regime="oracle").select(
        "model", "model_mean", "reference_mean", "mean_diff", "n_seeds")
    return rounded(out, "model_mean", "reference_mean", "mean_diff")


def _paired_t(s, d):
    runs = _runs(s, d).where("regime = 'honest'")
    return rounded(rp.paired_t(runs, "Brand#12", "Brand#11", "pooled_roc_auc"), "mean_diff", "std_diff", "t_statistic")


def _flags(s, d):
    return rounded(rp.sanity_flags(_runs(s, d)), "value")


def _sweep(s, d):
    out = rp.sweep_summary(_runs(s, d), ["model"], F.col("trial_roc_auc"), F.col("pooled_roc_auc"))
    return rounded(out, *[c for c in out.columns if c not in ("model", "n_runs", "n_positive")])


def _health(s, d):
    i, labels, p, t = _splits(s, d)
    return sp.split_health(sp.quadrant_sizes(labels, p, t), 10 ** 9).select("quadrant", "n_pos")


QUERIES = {
    "roc_auc_pooled": Query(_curve(None), _q(_curve_sql("scored_pairs"))),
    "roc_auc_per_trial": Query(_curve("group_id"), _q(_curve_sql("scored_pairs", "group_id"))),
    "topk_metrics": Query(_top, _top_sql()),
    "ndcg_tied": Query(_tied, _q(TIED_SQL)),
    "mrr": Query(_mrr, _q("select group_id, round(1 / min(rank) filter (where y = 1), 6) as mrr from ranked group by group_id having max(n_pos) > 0")),
    "grouped_metrics": Query(_grouped, _grouped_sql()),
    "retrieval_metrics": Query(_retrieval, _retrieval_sql()),
    "brier_ece": Query(_calibration, _q(CAL_SQL)),
    "strict_accuracy": Query(_strict_accuracy, _q("""
        select round(avg(cast((round(m_inc, 6) >= 0.5e0) = matched as int)), 6) as accuracy, count(*) as n_assessable
        from strict_b s join dense_b b on s.patient_id = b.patient_id and s.trial_id = b.trial_id""")),
    "strict_sweep": Query(_strict_sweep, _q(SWEEP_SQL)),
    "exact_quantiles": Query(_quantiles, """
        select unnest([0.01e0, 0.25e0, 0.5e0, 0.75e0, 0.99e0]) as prob, round(unnest(quantile_cont(l_extendedprice, [0.01e0, 0.25e0, 0.5e0, 0.75e0, 0.99e0])), 4) as quantile
        from lineitem"""),
    "trial_prior_scores": Query(_priors, _q(PRIOR_SQL)),
    "split_patients": Query(_patient_split, _q(SPLIT_SQL.format(k="patient_id", seed=0, t="patients"))),
    "split_patients_floor": Query(_floor_split, _q(SPLIT_SQL.format(k="patient_id", seed=3, t="patients").replace("round_even(0.7e0 * n, 0)", "floor(0.7e0 * n)").replace("round_even(0.15e0 * n, 0)", "floor(0.15e0 * n)"))),
    "split_trials_stratified": Query(_trial_split, _q(TRIAL_SPLIT_SQL)),
    "split_quadrants": Query(_quadrants, _q(QUAD + " select quadrant, count(*) as n_pairs, cast(sum(y) as bigint) as n_pos from q where quadrant is not null group by quadrant")),
    "split_health": Query(_health, _q(QUAD + " select quadrant, cast(sum(y) as bigint) as n_pos from q where quadrant in ('val', 'test') group by quadrant")),
    "dense_test_quadrant": Query(_dense_test, _q(QUAD + " select patient_id, trial_id, round(m_inc, 6) as m_inc, round(m_exc, 6) as m_exc, y from q where quadrant = 'test'")),
    "negative_subsample": Query(_subsample, _q(SUBSAMPLE_SQL)),
    "stratified_cap": Query(_capped, _q(CAP_SQL)),
    "kfold_assign": Query(_folds, _q("""
        select trial_id, (row_number() over (order by md5('2|' || cast(trial_id as varchar)), trial_id) - 1) % 5 as fold from (select distinct trial_id from criteria) t""")),
    "prefix_split": Query(_prefix, """
        select s_suppkey as trial_id, case when row_number() over (order by s_suppkey) - 1 < floor(0.8e0 * count(*) over ()) then 'train' else 'eval' end as split from supplier"""),
    "random_scores": Query(_random_scores, _q("select pair_id, round(" + UNIFORM_SQL.format(h="md5('11|' || pair_id)") + ", 6) as score from scored_pairs")),
    "random_negative_trials": Query(_negatives, _q("""
        select patient_id, trial_id, least(5, (select count(distinct trial_id) - 1 from criteria)) as n,
          least(5, (select count(distinct trial_id) - 1 from criteria)) as n_distinct, cast(0 as bigint) as n_own from labels_l where y = 1""")),
    "bootstrap_ci": Query(_bootstrap, _q(BOOT_SQL)),
    "paired_bootstrap": Query(_paired, _q(PAIRED_SQL)),
    "sign_bootstrap": Query(_sign, _q(SIGN_SQL)),
    "three_way_bootstrap": Query(_three, _q(THREE_SQL)),
    "seed_summary": Query(_seed_summary, _q("""
        select regime, model, round(avg(pooled_roc_auc), 6) as pooled_roc_auc_mean, round(stddev_samp(pooled_roc_auc), 6) as pooled_roc_auc_std, count(pooled_roc_auc) as pooled_roc_auc_count,
          round(avg(pooled_pr_auc), 6) as pooled_pr_auc_mean, round(stddev_samp(pooled_pr_auc), 6) as pooled_pr_auc_std, count(pooled_pr_auc) as pooled_pr_auc_count
        from runs where split = 'test' group by regime, model""")),
    "wilcoxon_w": Query(_wilcoxon, _q(WILCOXON_SQL)),
    "compare_to_reference": Query(_compare, _q("""
        select m.model, round(avg(m.pooled_roc_auc), 6) as model_mean, round(avg(r.pooled_roc_auc), 6) as reference_mean,
          round(avg(m.pooled_roc_auc - r.pooled_roc_auc), 6) as mean_diff, count(*) as n_seeds
        from runs m join runs r on r.seed = m.seed and r.regime = m.regime and r.model = 'Brand#11'
        where m.regime = 'oracle' and m.model <> 'Brand#11' group by m.model having count(*) >= 2""")),
    "paired_t": Query(_paired_t, _q("""
        select count(*) as n, round(avg(d), 6) as mean_diff, round(stddev_samp(d), 6) as std_diff, count(*) filter (where d > 0) as n_positive,
          round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) as t_statistic
        from (select a.pooled_roc_auc - b.pooled_roc_auc as d from runs a join runs b on a.seed = b.seed
          where a.model = 'Brand#12' and b.model = 'Brand#11' and a.regime = 'honest' and b.regime = 'honest') t""")),
    "sanity_flags": Query(_flags, _q("""
        select 'too_good' as kind, model, regime, seed, round(pooled_roc_auc, 6) as value from runs where regime <> 'oracle' and pooled_roc_auc > 0.98e0
        union all select 'pooled_gap', model, regime, seed, round(pooled_roc_auc - trial_roc_auc, 6) from runs where pooled_roc_auc - trial_roc_auc > 0.15e0
        union all select 'unstable', model, null, null, round(stddev_samp(pooled_pr_auc), 6) from runs where regime <> 'oracle' group by model
          having count(*) >= 3 and avg(pooled_pr_auc) > 0 and stddev_samp(pooled_pr_auc) > 0.5e0 * avg(pooled_pr_auc)""")),
    "sweep_summary": Query(_sweep, _q("""
        select model, count(*) as n_runs, round(avg(trial_roc_auc), 6) as base_mean, round(stddev_pop(trial_roc_auc), 6) as base_std,
          round(avg(pooled_roc_auc), 6) as full_mean, round(stddev_pop(pooled_roc_auc), 6) as full_std,
          round(avg(pooled_roc_auc - trial_roc_auc), 6) as diff_mean, round(stddev_pop(pooled_roc_auc - trial_roc_auc), 6) as diff_std,
          count(*) filter (where pooled_roc_auc > trial_roc_auc) as n_positive from runs group by model""")),
}
