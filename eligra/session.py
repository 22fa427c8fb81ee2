"""Session settings, lineage cutting and salt sizing shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "eligra", cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one the session names in ``spark.checkpoint.dir``.

    A session that names none gets a folder of its own if all its tasks run in this process (tests, a laptop); on a
    cluster that is an error, as executors share no disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


#: Spark's setting (from 4.1 on) by which a query's shuffle files go when it ends; a query takes it up when its DataFrame is made.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries made and run within leave no shuffle files. Else these stay until the driver collects its garbage: a small step over
    many partitions leaves little data but three files a task, and an operator of a hundred steps fills the disk with them.
    """
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.set(TIDY, before)


#: Digits of an estimated size beyond which the estimate is of no use.
ESTIMATE_DIGITS = 40


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy.

    A checkpoint inherits the planner's size estimate of its plan, and a join multiplies those of its sides: after some ten joins of checkpoints
    they have thousands of digits and planning takes longer than the work. Such a plan is written as Parquet instead, whose size is known.
    """
    folder = shared_folder(df.sparkSession)
    with tidy(df.sparkSession):
        df = df.select("*")  # made anew, so that it takes the setting up
    if len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > ESTIMATE_DIGITS:
        path = f"{folder}/table-{uuid.uuid4().hex}"
        with tidy(df.sparkSession):
            df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows with much work each (long texts) over all cores, when the input comes in fewer pieces than that.

    A large input has more pieces than cores and is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def default_salt(spark: SparkSession) -> int:
    """How many ways keys are split by hand: ``eligra.salt`` of the session, else 1, the same at every size.

    Without salt, adaptive execution splits the partitions that it measures as skewed.
    """
    return int(spark.conf.get("eligra.salt", "1"))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt: int, spread_by: list[str],
                how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys are split ``salt`` ways.

    Rows of ``big`` with one key go to ``salt`` partitions picked by ``spread_by``; each row of
    ``small`` is repeated for every one of them. ``how`` may be inner or left (big side kept).
    Spark still turns this into a broadcast join when the measured size of ``small`` allows it.
    """
    if salt <= 1:
        return big.join(small, keys, how)
    big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salt)).cast("int"))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return big.join(small, keys + ["_salt"], how).drop("_salt")
