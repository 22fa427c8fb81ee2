"""Hospital tables: CSV and Parquet readers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eligra import schemas
from eligra.operators.cohort import clean_crosswalk, upper_to_lower


def read_csv(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """CSV with a header in any case, every column as text; only ``columns`` (DDL names) when given."""
    df = upper_to_lower(spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path))
    if columns is None:
        return df
    wanted = [f.name.lower() for f in schemas.schema(columns)]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])


def read_ehr(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    """The four event tables of a directory, lower-case names."""
    return {name.lower(): read_csv(spark, f"{data_dir}/{name}.csv", ddl) for name, ddl in schemas.EHR.items()}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet at ``path``, or the CSV of the same stem when there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        stem = path[: -len(".parquet")] if path.endswith(".parquet") else path
        return read_csv(spark, stem + ".csv")


def with_row_order(df: DataFrame, column: str = "seq") -> DataFrame:
    """Rows of a file scan with a number that follows file path and place in the file, from 0, however the files are cut and dealt.

    ``df`` is a scan with nothing but projections on it. Rows of each split are counted once; the splits before give its first number.
    """
    spot = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start")]
    marked = df.select("*", *spot).withColumn("_id", F.monotonically_increasing_id())
    splits = marked.groupBy("_path", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_path", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return marked.join(offsets, ["_path", "_start"]).select(*[marked[c] for c in df.columns], (F.col("_id") + F.col("_shift")).alias(column))


def read_crosswalk(spark: SparkSession, path: str) -> DataFrame:
    """ICD-9 to ICD-10 lookup, first row of a code wins."""
    return clean_crosswalk(with_row_order(read_csv(spark, path)))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """Raw edges (seq, parent, child); header lines are recognised later, so none is assumed here."""
    raw = spark.read.option("header", False).schema("parent STRING, child STRING").csv(path)
    return with_row_order(raw)


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    present = {c.lower(): c for c in df.columns}
    return next((present[c.lower()] for c in candidates if c.lower() in present), None)


def write_clean(tables: dict[str, DataFrame], out_dir: str, mode: str = "overwrite") -> None:
    """The clean tables as Parquet, one folder each."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{out_dir}/{name}.parquet")


def write_graph(nodes: DataFrame, edges: DataFrame, out_dir: str, mode: str = "overwrite") -> None:
    edges.write.mode(mode).partitionBy("relation").parquet(f"{out_dir}/edges")
    nodes.write.mode(mode).partitionBy("node_type").parquet(f"{out_dir}/nodes")


def write_scores(scores: DataFrame, path: str, model: str, seed: int, mode: str = "append") -> None:
    """Pair scores keyed by patient, trial, model and seed."""
    scores.withColumn("model", F.lit(model)).withColumn("seed", F.lit(seed)).write.mode(mode).partitionBy("model", "seed").parquet(path)


def write_metrics(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Result rows as Parquet, JSON or CSV."""
    writer = results.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
