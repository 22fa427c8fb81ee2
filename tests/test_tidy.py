"""Steps leave no shuffle files behind, and the session's own setting stays."""

import time

from pyspark.sql import functions as F

from eligra.llm.common import components, written
from eligra.session import TIDY, materialize


def shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}


def left_by(spark, step) -> set[str]:
    before = shuffle_files(spark)
    step()
    for _ in range(50):  # files go a little after the step has ended
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return left


def test_steps_leave_no_shuffle_files(spark):
    grouped = spark.range(5000, numPartitions=5).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
    before, kept = spark.conf.get(TIDY, "false"), []
    for step in (lambda: kept.append(materialize(grouped)), lambda: kept.append(written(grouped)),
                 lambda: kept.append(components(spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 20")))):
        assert not left_by(spark, step)
    assert spark.conf.get(TIDY, "false") == before
    assert [sorted(x.n for x in d.collect()) for d in kept[:2]] == [[50] * 100] * 2
    assert {r.root for r in kept[2].collect()} == {0, 21} and kept[2].count() == 41
