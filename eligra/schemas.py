"""Declared schemas of the inputs; codes are read as text so nothing is guessed."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


EHR = {
    "ADMISSIONS": "SUBJECT_ID STRING, HADM_ID STRING, ADMITTIME STRING",
    "DIAGNOSES_ICD": "SUBJECT_ID STRING, HADM_ID STRING, ICD9_CODE STRING",
    "PRESCRIPTIONS": "SUBJECT_ID STRING, HADM_ID STRING, DRUG STRING, NDC STRING",
    "LABEVENTS": "SUBJECT_ID STRING, ITEMID STRING, CHARTTIME STRING, VALUENUM STRING",
}

CRITERION = ("raw_entity STRING, entity_type STRING, entity_code STRING, operator STRING, value DOUBLE, "
             "max_value DOUBLE, is_inclusion BOOLEAN, severity_weight DOUBLE")

# Aliases a structured trial file may use for the same field.
TRIAL_RECORD = (
    "trial_id STRING, nct_id STRING, title STRING, conditions ARRAY<STRING>, phase STRING, sample_size STRING, "
    "overall_status STRING, "
    + ", ".join(f"{name} ARRAY<STRUCT<raw_entity: STRING, entity_type: STRING, concept_type: STRING, entity_code: STRING, "
                "concept_code: STRING, operator: STRING, value: STRING, max_value: STRING, is_inclusion: BOOLEAN, "
                "severity_weight: DOUBLE, weight: DOUBLE>>" for name in ("criteria", "eligibility_criteria"))
)

STUDY_BODY = (
    "identificationModule: STRUCT<nctId: STRING, briefTitle: STRING>, statusModule: STRUCT<overallStatus: STRING>, "
    "designModule: STRUCT<phases: ARRAY<STRING>, enrollmentInfo: STRUCT<count: INT>>, "
    "conditionsModule: STRUCT<conditions: ARRAY<STRING>>, eligibilityModule: STRUCT<eligibilityCriteria: STRING>"
)
STUDY = f"protocolSection STRUCT<{STUDY_BODY}>"
STUDIES = f"{STUDY}, studies ARRAY<STRUCT<protocolSection: STRUCT<{STUDY_BODY}>>>"

FIELD_LISTS = ", ".join(f"{c} ARRAY<STRING>" for c in (
    "NCTId", "BriefTitle", "Conditions", "Phase", "EnrollmentCount", "OverallStatus", "StudyType", "EligibilityCriteria",
    "Interventions", "StartDate", "CompletionDate"))


def schema(ddl: str) -> T.StructType:
    return _struct(ddl)
