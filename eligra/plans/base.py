"""Shared inputs of the registered queries and the SQL that states the same independently."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligra.operators import cohort as co
from eligra.operators import labs as lb
from eligra.operators import match as mt
from eligra.plans.views import table, view, with_views
from eligra.session import materialize


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round doubles so that summation order does not show."""
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


class Inputs:
    """The hospital and trial inputs of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.dir, name)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def cohort(self) -> DataFrame:
        return co.select_cohort(self.view("admissions_raw"))

    def diagnoses(self) -> DataFrame:
        return co.diagnoses_clean(self.view("diagnoses_raw"), self.view("crosswalk_raw"), self.cohort())

    def prescriptions(self) -> DataFrame:
        return co.prescriptions_clean(self.view("prescriptions_raw"), self.cohort())

    def labs(self) -> DataFrame:
        return lb.clean_labs(self.view("labevents_raw"), self.cohort())

    def lab_grid(self) -> DataFrame:
        return lb.labs_clean(self.view("labevents_raw"), self.cohort())

    def patients(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("patient_id"))

    def codes(self) -> DataFrame:
        """Codes of every customer: all diagnoses and prescriptions, last measured lab values."""
        everyone = self.table("customer").select(F.col("c_custkey").alias("subject_id"))
        dx = co.diagnoses_clean(self.view("diagnoses_raw"), self.view("crosswalk_raw"), everyone)
        rx = co.prescriptions_clean(self.view("prescriptions_raw"), everyone)
        labs = lb.last_measured(lb.clean_labs(self.view("labevents_raw"), everyone))
        return mt.patient_codes(dx, rx, labs)

    def criteria(self) -> DataFrame:
        return self.view("criteria")

    def scores(self, rule: str = "L", often: bool = False) -> mt.PairScores:
        """``often``: codes and criteria are written once, for queries that score some pairs more than once."""
        criteria, codes = self.criteria(), self.codes()
        return mt.score_pairs(materialize(criteria), materialize(codes), rule) if often else mt.score_pairs(criteria, codes, rule)


# Independent statements of the shared stages, for DuckDB.
CTES = {
    "cohort": """
        select subject_id from admissions_raw where subject_id is not null and hadm_id is not null and admittime is not null
        group by subject_id
        having count(distinct hadm_id) >= 2 and date_sub('day', min(admittime), max(admittime)) >= 30""",
    "crosswalk": """
        select icd9_code, icd10_code from (
          select upper(replace(trim(icd9cm), '.', '')) as icd9_code, upper(replace(trim(icd10cm), '.', '')) as icd10_code,
            row_number() over (partition by upper(replace(trim(icd9cm), '.', '')) order by seq) as r
          from crosswalk_raw where no_map is distinct from '1') t where r = 1""",
    "dx_everyone": """
        select d.subject_id, d.hadm_id, d.seq_num, coalesce(x.icd10_code, upper(replace(trim(d.icd9_code), '.', ''))) as icd10_code
        from diagnoses_raw d left join crosswalk x on upper(replace(trim(d.icd9_code), '.', '')) = x.icd9_code""",
    "dx_clean": "select * from dx_everyone where subject_id in (select subject_id from cohort)",
    "rx_everyone": """
        select subject_id, hadm_id, drug, regexp_replace(ndc, '[.]0$', '') as ndc from prescriptions_raw
        where drug is not null and regexp_replace(ndc, '[.]0$', '') <> '0'""",
    "rx_clean": "select * from rx_everyone where subject_id in (select subject_id from cohort)",
    "labs_cohort": """
        select event_id, subject_id, itemid, charttime, cast(charttime as date) as day, valuenum from labevents_raw
        where valuenum is not null and charttime is not null and subject_id in (select subject_id from cohort)""",
    "lab_stats": """
        select itemid, count(distinct subject_id) as n_patients, avg(valuenum) as mean, stddev_samp(valuenum) as std
        from labs_cohort group by itemid
        having count(distinct subject_id) >= 0.05e0 * (select count(*) from cohort) and stddev_samp(valuenum) > 0""",
    "labs_norm": """
        select l.*, (least(greatest(valuenum, mean - 4 * std), mean + 4 * std) - mean) / std as value_norm
        from labs_cohort l join lab_stats s on l.itemid = s.itemid""",
    "lab_days": """
        select subject_id, itemid, day, value_norm as value from (
          select *, row_number() over (partition by subject_id, itemid, day order by charttime, event_id) as r from labs_norm) t
        where r = 1""",
    "lab_segments": """
        select *, lead(day) over w as next_day, count(*) over (partition by subject_id, itemid) as n_days
        from lab_days window w as (partition by subject_id, itemid order by day)""",
    "lab_grid": """
        select charttime, subject_id, itemid, value * exp(-0.1e0 * k) as imputed_value_decayed, k as days_since_measured from (
          select subject_id, itemid, value, k, cast(day + cast(k as integer) as date) as charttime,
            row_number() over (partition by subject_id, itemid, day + cast(k as integer) order by day) as r
          from (select *, unnest(range(0, case when n_days = 1 then 1
                  when next_day is null then 31 else least(date_diff('day', day, next_day), 30) + 1 end)) as k
                from lab_segments) e) t
        where r = 1""",
    "lab_last": """
        select subject_id, itemid, valuenum as value from (
          select *, row_number() over (partition by subject_id, itemid order by charttime desc, event_id desc) as r
          from labevents_raw where valuenum is not null and charttime is not null
            and subject_id in (select c_custkey from customer)) t where r = 1""",
    "pcodes": """
        select distinct subject_id as patient_id, 'diagnosis' as entity_type, icd10_code as code, cast(null as double) as value from dx_everyone
        union all
        select distinct subject_id, 'medication', lpad(ndc, 11, '0'), cast(null as double) from rx_everyone
        union all
        select subject_id, 'lab', cast(itemid as varchar), value from lab_last""",
    "patients": "select c_custkey as patient_id from customer",
    "crit_l": """
        select *, case when entity_type in ('diagnosis', 'medication', 'lab') then entity_type else 'diagnosis' end as lookup_type
        from criteria where not (trim(entity_code) = '' or lower(entity_code) in ('none', 'nan', 'unknown_code')
          or starts_with(entity_code, 'UNMATCHED_') or starts_with(entity_code, 'UNK_'))""",
    "grid_l": """
        select p.patient_id, c.trial_id, c.criterion_idx, c.is_inclusion, c.severity_weight as w, h.code is not null as present,
          case when operator = 'EXISTS' then cast(h.code is not null as int)
               when operator = 'NOT_EXISTS' then cast(h.code is null as int)
               when h.code is null or c.entity_type <> 'lab' or c.value is null then 0
               when operator in ('GT', 'GTE') then 1 / (1 + exp(-least(greatest(h.value - c.value, -60), 60)))
               when operator in ('LT', 'LTE') then 1 / (1 + exp(-least(greatest(c.value - h.value, -60), 60)))
               when operator = 'EQ' then exp(-abs(h.value - c.value))
               else 1 / (1 + exp(-least(greatest(h.value - c.value, -60), 60)))
                    / (1 + exp(-least(greatest(coalesce(c.max_value, c.value) - h.value, -60), 60))) end as s
        from patients p cross join crit_l c
        left join pcodes h on h.patient_id = p.patient_id and h.entity_type = c.lookup_type and h.code = c.entity_code""",
    "dense_l": """
        select patient_id, trial_id, bool_or(present) as any_hit,
          coalesce((coalesce(cast(sum(cast(w as decimal(18,6))) filter (where is_inclusion and s = 1) as double), 0e0) + coalesce(sum(w * s) filter (where is_inclusion and s <> 1), 0e0)) / nullif(count(*) filter (where is_inclusion), 0), 1e0) as m_inc,
          coalesce(max(w * s) filter (where not is_inclusion), 0e0) as m_exc,
          count(*) filter (where is_inclusion) as n_inc, count(*) filter (where not is_inclusion) as n_exc
        from grid_l group by patient_id, trial_id""",
    "labels_l": "select *, cast(m_inc >= 0.15e0 and m_exc < 0.8e0 as int) as y from dense_l",
}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """An oracle query with every view and stage it names in front."""
    return with_views(body, {**CTES, **(extra or {})})


def count(c: str = "*") -> Column:
    return F.count(c)
