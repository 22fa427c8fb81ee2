"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from eligra.operators import hierarchy
from eligra.sources import ehr, trials


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


STUDY = {"protocolSection": {"identificationModule": {"nctId": "N1", "briefTitle": "A"}, "designModule": {"phases": ["PHASE2"]},
                             "conditionsModule": {"conditions": ["x"]}, "eligibilityModule": {"eligibilityCriteria": "Inclusion Criteria:\nlong enough"}}}


def test_ehr_and_clean_sinks(spark, tmp_path):
    for name, body in {"ADMISSIONS": "subject_id,HADM_ID,AdmitTime\n1,2,2020-01-01\n", "DIAGNOSES_ICD": "SUBJECT_ID,HADM_ID,ICD9_CODE\n1,2,0250\n",
                       "PRESCRIPTIONS": "SUBJECT_ID,HADM_ID,DRUG,NDC\n1,2,a,00012\n", "LABEVENTS": "SUBJECT_ID,ITEMID,CHARTTIME,VALUENUM\n1,5,2020-01-01,x\n"}.items():
        write(tmp_path / f"{name}.csv", body)
    tables = ehr.read_ehr(spark, str(tmp_path))
    assert tables["prescriptions"].first().ndc == "00012" and tables["admissions"].columns == ["subject_id", "hadm_id", "admittime"]
    ehr.write_clean({"rx": tables["prescriptions"]}, str(tmp_path / "out"))
    assert ehr.read_table(spark, str(tmp_path / "out" / "rx.parquet")).count() == 1
    write(tmp_path / "only.csv", "A,b\n1,2\n")
    assert ehr.read_table(spark, str(tmp_path / "only.parquet")).columns == ["a", "b"]
    assert ehr.first_present(tables["admissions"], ["nope", "HADM_ID"]) == "hadm_id"


def test_lookup_files(spark, tmp_path):
    cross = ehr.read_crosswalk(spark, write(tmp_path / "x.csv", "ICD9CM,icd10cm,no_map\n25.0,E1.1,0\n250,E9,0\n9,Z,1\n"))
    assert [tuple(r) for r in cross.collect()] == [("250", "E11")]
    edges = hierarchy.clean_edges(ehr.read_hierarchy(spark, write(tmp_path / "h.csv", "parent,child\nI50,I509\n,x\nonly\n")))
    assert [(r.parent, r.child) for r in edges.collect()] == [("I50", "I509")]


def test_registry_shapes(spark, tmp_path):
    shapes = {"array": [STUDY, STUDY], "one": STUDY, "wrapped": {"studies": [STUDY]}}
    for (name, body), n in zip(shapes.items(), (2, 1, 1)):
        rows = trials.study_rows(trials.read_studies(spark, write(tmp_path / f"{name}.json", json.dumps(body)))).collect()
        assert len(rows) == n and (rows[0].trial_id, rows[0].phase, rows[0].sample_size, rows[0].overall_status) == ("N1", "PHASE2", 100, "Unknown")
    lists = trials.read_field_lists(spark, write(tmp_path / "f.json", json.dumps({"NCTId": ["N2"], "EnrollmentCount": ["7"]}))).first()
    assert (lists.trial_id, lists.sample_size, lists.phase, lists.title) == ("N2", 7, "PHASE2", "")
    export = write(tmp_path / "e.csv", "NCTId,BriefTitle,Phase,OverallStatus\nN3,t,Phase 2,Completed\nN4,t,Phase 1,Completed\nN5,t,Phase 3,Recruiting\n")
    assert [r.trial_id for r in trials.read_registry_csv(spark, export).collect()] == ["N3"]


def test_structured_aliases_and_duplicates(spark, tmp_path):
    a = [{"nct_id": "T1", "title": "first", "criteria": [{"concept_type": "odd", "concept_code": "i50.9", "operator": ">=", "value": "2.5", "weight": 0.5}]},
         {"title": "no id"}, {"trial_id": "T1", "title": "second", "eligibility_criteria": [{"entity_type": "medication", "entity_code": "12.0"}]}]
    path = write(tmp_path / "s.json", json.dumps(a))
    first = trials.explode_criteria(trials.read_structured(spark, path)).collect()
    assert [(r.entity_type, r.entity_code, r.operator, r.value, r.is_inclusion, r.severity_weight) for r in first] == [("diagnosis", "i50.9", "GTE", 2.5, True, 0.5)]
    last = trials.read_structured(spark, path, keep="last").first()
    assert last.title == "second" and last.criteria[0].entity_code == "00000000012"


def test_trial_sink_splits_in_order(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("trial_id"), F.col("id").alias("seq"), F.lit("t").alias("title"))
    trials.write_trials(rows, str(tmp_path / "t"))
    back = spark.read.json(str(tmp_path / "t"))
    assert {r.trial_id for r in back.where("split = 'eval'").collect()} == {8, 9} and back.count() == 10


def test_auto_picks_what_exists(spark):
    def missing():
        raise FileNotFoundError

    assert trials.load_dataset("auto", {"real": missing, "real_ctg": lambda: {"x": 1}}) == {"x": 1}


def test_row_numbers_follow_the_files_however_they_are_cut(spark, tmp_path):
    """Files of unlike size, cut into many splits that are dealt by size: numbers go by path and place, so the first row of a code wins."""
    rows, folder = [], tmp_path / "edges"
    folder.mkdir()
    for name, n in (("a.csv", 40), ("b.csv", 3_000), ("c.csv", 500)):
        mine = [(f"{name}-{i}", f"child{i % 700}") for i in range(n)]
        write(folder / name, "\n".join(",".join(r) for r in mine) + "\n")
        rows += mine
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        edges = ehr.read_hierarchy(spark, str(folder))
        assert [(r.seq, r.parent, r.child) for r in edges.orderBy("seq").collect()] == [(i, *r) for i, r in enumerate(rows)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.seq for r in ehr.read_hierarchy(spark, str(folder)).where("child = 'child20'").orderBy("seq").limit(1).collect()] == [20]
