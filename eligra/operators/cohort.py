"""Cohort selection and cleaning of the hospital event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligra.functions.codes import clean_dx, strip_float_suffix

MIN_ENCOUNTERS = 2
MIN_SPAN_DAYS = 30


def upper_to_lower(df: DataFrame) -> DataFrame:
    """One header case for every input table."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def clean_admissions(admissions: DataFrame) -> DataFrame:
    """Typed admissions; rows with a missing key or an unreadable time are dropped."""
    df = upper_to_lower(admissions)
    return df.select(
        F.col("subject_id").try_cast("bigint").alias("subject_id"),
        F.col("hadm_id").try_cast("bigint").alias("hadm_id"),
        F.col("admittime").try_cast("timestamp_ntz").alias("admittime"),
    ).dropna()


def encounter_stats(admissions: DataFrame) -> DataFrame:
    """Encounters and observed span per patient; the span counts whole elapsed days."""
    stats = (
        admissions.groupBy("subject_id", "hadm_id")
        .agg(F.min("admittime").alias("first"), F.max("admittime").alias("last"))
        .groupBy("subject_id")
        .agg(F.count("*").alias("encounter_count"), F.min("first").alias("first_admit"),
             F.max("last").alias("last_admit"))
    )
    return stats.withColumn("observation_span", F.expr("timestampdiff(DAY, first_admit, last_admit)"))


def select_cohort(admissions: DataFrame, min_encounters: int = MIN_ENCOUNTERS,
                  min_span_days: int = MIN_SPAN_DAYS) -> DataFrame:
    """Patients with enough encounters spread over enough days."""
    return (
        encounter_stats(clean_admissions(admissions))
        .where((F.col("encounter_count") >= min_encounters) & (F.col("observation_span") >= min_span_days))
        .select("subject_id")
    )


def cohort_admissions(admissions: DataFrame, cohort: DataFrame) -> DataFrame:
    return clean_admissions(admissions).join(cohort, "subject_id", "left_semi")


def clean_crosswalk(raw: DataFrame) -> DataFrame:
    """ICD-9 to ICD-10 lookup: unmappable rows go, the first row (by ``seq``) of a code stays.

    A missing ``no_map`` flag counts as mappable.
    """
    df = upper_to_lower(raw)
    if "no_map" in df.columns:
        df = df.where(~F.col("no_map").eqNullSafe("1"))
    return (
        df.select("seq", clean_dx(F.col("icd9cm")).alias("icd9_code"), clean_dx(F.col("icd10cm")).alias("icd10_code"))
        .groupBy("icd9_code").agg(F.min_by("icd10_code", "seq").alias("icd10_code"))
    )


def clean_diagnoses(diagnoses: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    df = upper_to_lower(diagnoses)
    df = df.select(
        F.col("subject_id").try_cast("bigint").alias("subject_id"),
        F.col("hadm_id").try_cast("bigint").alias("hadm_id"),
        clean_dx(F.col("icd9_code").cast("string")).alias("icd9_code"),
    ).dropna(subset=["subject_id", "hadm_id"]).where(F.coalesce(F.col("icd9_code"), F.lit("NAN")) != "NAN")
    return df if cohort is None else df.join(cohort, "subject_id", "left_semi")


def to_icd10(diagnoses: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Attach the ICD-10 code, keeping the raw code where the crosswalk has none.

    The lookup is unique per ICD-9 code, so this adds no rows; a hot code is split by the
    adaptive skew join or disappears in a broadcast join when the lookup measures small.
    """
    return diagnoses.join(crosswalk, "icd9_code", "left").withColumn(
        "icd10_code", F.coalesce("icd10_code", "icd9_code"))


def diagnoses_clean(diagnoses: DataFrame, crosswalk_raw: DataFrame, cohort: DataFrame) -> DataFrame:
    return to_icd10(clean_diagnoses(diagnoses, cohort), clean_crosswalk(crosswalk_raw)).select(
        "subject_id", "hadm_id", "icd10_code")


def crosswalk_coverage(diagnoses: DataFrame, crosswalk_raw: DataFrame, cohort: DataFrame) -> DataFrame:
    """Share of diagnosis rows whose code changed through the crosswalk.

    Counts per distinct code come first, so the join sees the vocabulary and not the events.
    """
    per_code = clean_diagnoses(diagnoses, cohort).groupBy("icd9_code").agg(F.count("*").alias("n"))
    same = F.col("icd10_code") == F.col("icd9_code")
    return (
        to_icd10(per_code, clean_crosswalk(crosswalk_raw))
        .agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("n_unmapped"))
        .withColumn("n_mapped", F.col("n_rows") - F.col("n_unmapped"))
        .withColumn("mapped_pct", 100.0 * F.col("n_mapped") / F.col("n_rows"))
    )


def prescriptions_clean(prescriptions: DataFrame, cohort: DataFrame) -> DataFrame:
    df = upper_to_lower(prescriptions)
    return (
        df.select(
            F.col("subject_id").try_cast("bigint").alias("subject_id"),
            F.col("hadm_id").try_cast("bigint").alias("hadm_id"),
            "drug", strip_float_suffix(F.col("ndc").cast("string")).alias("ndc"),
        )
        .dropna().where(F.col("ndc") != "0")
        .join(cohort, "subject_id", "left_semi")
    )
