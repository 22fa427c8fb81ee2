"""Cohort, code and lab cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eligra.functions.codes import finite_double, normalize_code, operator_code
from eligra.operators import cohort as co
from eligra.operators import labs as lb
from eligra.operators import match as mt
from eligra.plans.base import Inputs, Query, rounded, sql


def _cohort_stats(spark, d):
    return co.encounter_stats(co.clean_admissions(Inputs(spark, d).view("admissions_raw")))


def _lab_zscore(spark, d):
    i = Inputs(spark, d)
    df = lb.zscore_labs(i.labs(), i.cohort())
    return rounded(df.select(F.col("seq").alias("event_id"), "subject_id", "itemid", "value_norm"), "value_norm")


def _lab_stats(spark, d):
    i = Inputs(spark, d)
    return rounded(lb.active_items(i.labs(), i.cohort()), "mean", "std")


def _lab_tail(spark, d):
    i = Inputs(spark, d)
    return rounded(lb.grid_tail(lb.daily_values(lb.zscore_labs(i.labs(), i.cohort()))), "value")


def _patient_state(spark, d):
    states = mt.patient_states(Inputs(spark, d).codes())
    labs = F.array_join(F.transform(F.map_entries("lab_values"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"], 4).cast("decimal(20,4)"))), ",")
    return states.select("patient_id", F.array_join("diagnosis_codes", ",").alias("dx"),
                         F.array_join("medication_codes", ",").alias("rx"), labs.alias("labs"))


def _normalized(spark, d):
    df = Inputs(spark, d).criteria()
    # Foreign files carry dotted diagnosis codes and float NDCs: put both damages on, then repair.
    raw = (F.when(F.col("entity_type") == "diagnosis", F.concat(F.substring("entity_code", 1, 3), F.lit("."), F.lower(F.substring("entity_code", 4, 20))))
           .when(F.col("entity_type") == "medication", F.concat(F.regexp_replace("entity_code", "^0+", ""), F.lit(".0")))
           .otherwise(F.concat(F.lit(" "), F.col("entity_code"))))
    return df.withColumn("raw", raw).select(
        "trial_id", "criterion_idx", "raw", normalize_code(F.col("entity_type"), F.col("raw")).alias("code"),
        operator_code(F.col("operator")).alias("op_code"))


def _props_value(spark, d):
    df = Inputs(spark, d).table("events")
    return df.select("event_id", finite_double(F.col("value").cast("string")).alias("v"), finite_double(F.col("event_type")).alias("bad"))


QUERIES = {
    "cohort_select": Query(lambda s, d: Inputs(s, d).cohort(), sql("select subject_id from cohort")),
    "cohort_stats": Query(_cohort_stats, sql("""
        select subject_id, count(distinct hadm_id) as encounter_count, min(admittime) as first_admit, max(admittime) as last_admit,
          date_sub('day', min(admittime), max(admittime)) as observation_span from admissions_raw group by subject_id""")),
    "cohort_admissions": Query(
        lambda s, d: co.cohort_admissions(Inputs(s, d).view("admissions_raw"), Inputs(s, d).cohort()),
        sql("select * from admissions_raw where subject_id in (select subject_id from cohort)")),
    "crosswalk_lookup": Query(lambda s, d: co.clean_crosswalk(Inputs(s, d).view("crosswalk_raw")), sql("select * from crosswalk")),
    "dx_clean_crosswalk": Query(lambda s, d: Inputs(s, d).diagnoses(), sql("select subject_id, hadm_id, icd10_code from dx_clean")),
    "crosswalk_coverage": Query(
        lambda s, d: rounded(co.crosswalk_coverage(Inputs(s, d).view("diagnoses_raw"), Inputs(s, d).view("crosswalk_raw"), Inputs(s, d).cohort()), "mapped_pct"),
        sql("""select n_rows, n_unmapped, n_rows - n_unmapped as n_mapped, round(100e0 * (n_rows - n_unmapped) / n_rows, 6) as mapped_pct from (
          select count(*) as n_rows, count(*) filter (where coalesce(x.icd10_code, c) = c) as n_unmapped
          from (select upper(replace(trim(icd9_code), '.', '')) as c from diagnoses_raw where subject_id in (select subject_id from cohort)) q
          left join crosswalk x on q.c = x.icd9_code) t""")),
    "rx_clean": Query(lambda s, d: Inputs(s, d).prescriptions(), sql("select subject_id, hadm_id, drug, ndc from rx_clean")),
    "lab_active_items": Query(_lab_stats, sql("select itemid, n_patients, round(mean, 6) as mean, round(std, 6) as std from lab_stats")),
    "lab_zscore": Query(_lab_zscore, sql("select event_id, subject_id, itemid, round(value_norm, 6) as value_norm from labs_norm")),
    "lab_daily_grid": Query(
        lambda s, d: rounded(Inputs(s, d).lab_grid(), "imputed_value_decayed"),
        sql("select charttime, subject_id, itemid, round(imputed_value_decayed, 6) as imputed_value_decayed, cast(days_since_measured as int) as days_since_measured from lab_grid")),
    "lab_grid_tail": Query(_lab_tail, sql("""
        select subject_id, itemid, round(imputed_value_decayed, 6) as value from (
          select *, row_number() over (partition by subject_id, itemid order by charttime desc) as r from lab_grid) t where r = 1""")),
    "lab_last_value": Query(
        lambda s, d: lb.last_measured(lb.clean_labs(Inputs(s, d).view("labevents_raw"), Inputs(s, d).table("customer").select(F.col("c_custkey").alias("subject_id")))),
        sql("select * from lab_last")),
    "patient_state": Query(_patient_state, sql("""
        select patient_id, coalesce(string_agg(code, ',' order by code) filter (where entity_type = 'diagnosis'), '') as dx,
          coalesce(string_agg(code, ',' order by code) filter (where entity_type = 'medication'), '') as rx,
          coalesce(string_agg(code || '=' || cast(cast(round(value, 4) as decimal(20,4)) as varchar), ',' order by code) filter (where entity_type = 'lab'), '') as labs
        from pcodes group by patient_id""")),
    "code_normalization": Query(_normalized, sql("""
        select trial_id, criterion_idx, raw,
          case entity_type when 'diagnosis' then upper(replace(trim(raw), '.', ''))
            when 'medication' then lpad(regexp_replace(regexp_replace(raw, '[.]0+$', ''), '[^0-9]', '', 'g'), 11, '0') else trim(raw) end as code,
          case operator when 'EXISTS' then 0 when 'NOT_EXISTS' then 1 when 'GT' then 2 when 'GTE' then 3 when 'LT' then 4
            when 'LTE' then 5 when 'EQ' then 6 when 'BETWEEN' then 7 else 0 end as op_code
        from (select *, case entity_type when 'diagnosis' then substr(entity_code, 1, 3) || '.' || lower(substr(entity_code, 4))
            when 'medication' then regexp_replace(entity_code, '^0+', '') || '.0' else ' ' || entity_code end as raw from criteria) t""")),
    "finite_values": Query(_props_value, sql("select event_id, value as v, try_cast(event_type as double) as bad from events")),
}
