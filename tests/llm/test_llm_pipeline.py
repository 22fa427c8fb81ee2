"""Pipeline stages: columns, decisions on their own input, run() against the operators' digests."""

import corpus_pipeline as cp
from eligra.llm import decontamination, quality, secret_scan
from test_llm_near_copies import plain_kept

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_filter", "near_dedup", "decontaminate", "redact_secrets", "mix_sources"]
    stage = {n: (lambda d, f=f: f(spark, d, SF)) for n, f in cp.STAGES}

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())

    good = stage["quality_filter"](docs).cache()
    assert good.columns == docs.columns and ids(good) == ids(quality.classify(docs, labels).where("predicted = 1"))
    single = stage["near_dedup"](good).cache()
    assert single.columns == docs.columns and ids(single) == plain_kept([(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()])
    clean = stage["decontaminate"](single).cache()
    assert clean.columns == docs.columns
    assert ids(clean) == sorted(set(ids(single)) - set(ids(decontamination.leaks(single, items))))
    masked = stage["redact_secrets"](clean).cache()
    assert masked.columns == docs.columns and ids(masked) == ids(clean)
    assert secret_scan.scan(masked).selectExpr("sum(n_live)").first()[0] in (0, None)
    mixed = stage["mix_sources"](masked)
    assert mixed.columns == [*docs.columns, "copies", "target"]
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, mixed.collect()))


def test_empty_table(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, f in cp.STAGES:
        none = f(spark, none, SF)
        assert none.count() == 0


def test_odd_rows_pass_all_stages(spark):
    """Nulls in any column, empty and very long texts, repeated rows, rows of one id, other columns with names that operators use themselves."""
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").collect()
    rows = [(*r, "x", 1) for r in some]
    long = " ".join(r.text or "" for r in some) * 8
    rows += [(None, None, None, None, None, None, None), (None, rows[3][1], None, None, None, "y", 2), (1000, "", "en", None, 0, None, None), (1001, None, None, "web", 0, "z", 3),
             rows[5], rows[5], (1002, long, "en", "web", len(long), "x", 1), (7, "another text under a known id " * 9, "en", "web", 1, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_hash string, rid int").repartition(3)
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        now = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "text_hash", "rid"]
        if name in ("quality_filter", "near_dedup", "decontaminate"):
            assert set(now) <= kept
        if name == "near_dedup":
            assert len(now) == len(set(now))
        kept = set(now)
    assert {"copies", "target"} <= set(docs.columns)
