"""Terms of interest are looked for once in each list of conditions."""

from eligra.operators import criteria as cr
from eligra.operators import quality as qu


def test_histogram_of_counted_lists(spark):
    rows = [(i, ["Type 2 Diabetes"] if i % 3 else ["Staff safety", "Pneumonia"]) for i in range(30)] + [(99, None), (100, [])]
    trials = spark.createDataFrame(rows, "trial_id long, conditions array<string>")
    one_by_one = qu.term_histogram(cr.filter_by_condition(trials)).collect()
    lists = trials.groupBy("conditions").count()
    assert qu.term_histogram(cr.filter_by_condition(lists), times="count").collect() == one_by_one
    assert sum(r.n for r in one_by_one) == 30
