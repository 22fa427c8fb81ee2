"""Substring tests before patterns change no result."""

import re

from pyspark.sql import functions as F

from eligra.functions import lexicon as lex
from eligra.functions import text as tx

LINES = ["glucose >= 7.5", "BETWEEN 3 and 4", "not exceeding 5", "no more than 5 mg", "x  y\tz", " aged 18 years old ", "a (b) [c] / d <= 3", "prior MI", "premium",
         "exceeds 4", "exactly 2", "above .", "FEMALE only", "bun under 30", "≥ 5", "", "at LEAST 3", "12 to 5", "12-5 units", "greater\nthan 3", "nothing"]


def test_gates_keep_results(spark):
    line = F.col("line")
    df = spark.createDataFrame([(x,) for x in LINES], "line string").select(
        line, tx.bounds_patterns(line)["operator"].alias("op"), tx.is_demographic(line).alias("demographic"), tx.sanitize_entity(line).alias("clean"),
        tx.bounds_with_span(line)["operator"].alias("span"))
    for r in df.collect():
        low = r.line.lower()
        assert r.op == next((op for p, op in lex.BOUND_PATTERNS if re.search(p, low)), "EXISTS"), r
        assert r.demographic == bool(re.search(r"\b(age|years old|male|female|sex|gender)\b", low)), r
        spaced = re.sub(r"^[\s\-*•.]+", "", re.sub(r"[<>=]+", " ", re.sub(r"[\\()\[\]/]", " ", r.line)))
        assert r.clean == re.sub(r"\s+", " ", spaced).strip(), r
    spans = {r.line: r.span for r in df.collect()}
    assert spans["12-5 units"] == "BETWEEN" and spans["at LEAST 3"] == "GTE" and spans["bun under 30"] == "LTE" and spans["nothing"] == "EXISTS"


def test_word_lists_are_no_alternations(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    for column in (tx.is_administrative(F.col("line")), tx.sounds_like_exclusion(F.col("line")), tx.guess_type(F.col("line"))):
        assert "RLIKE" not in df.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
