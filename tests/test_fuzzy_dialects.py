"""The registered queries of dialects B and C look for inexact medication names too."""

import pytest

from eligra.plans import all_queries


@pytest.mark.parametrize("name", ["parse_operator_words", "parse_triplets"])
def test_misspelt_medication_is_found(spark, tmp_path, monkeypatch, name):
    from eligra.plans import texts

    drug = spark.createDataFrame([("simvastatin", "medication", "77")], "phrase string, entity_type string, entity_code string")
    monkeypatch.setattr(texts, "_concepts", lambda s, d: drug)
    rows = [(1, "Inclusion Criteria:\nstable dose of simvastatine daily\ngoes by car to the clinic")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.entity_type: r.n for r in all_queries()[name].run(spark, str(tmp_path)).groupBy("entity_type").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    # The text stands under both headers of the view.
    assert found.get("medication") == 2
