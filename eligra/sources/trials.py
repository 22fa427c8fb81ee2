"""Trial registries: raw studies, exports and structured criteria files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eligra import schemas
from eligra.functions.codes import ENTITY_TYPES, finite_double, normalize_code, operator_name
from eligra.operators.splits import prefix_split
from eligra.sources.ehr import with_row_order


def read_studies(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Registry studies with a ``seq``: an array, one object, or {"studies": [...]}.

    A multi-line file is read by one task, so large registries should come as JSON lines
    (``multi_line=False``) or as many files.
    """
    df = spark.read.schema(schemas.schema(schemas.STUDIES)).option("multiLine", multi_line).json(path)
    return _studies_of(with_row_order(df, "_row"))


def parse_studies(rows: DataFrame, text: str, row: str) -> DataFrame:
    """``read_studies`` of JSON texts in a column, one document a row, in the order of ``row``. A text that is no JSON gives no study."""
    parsed = F.from_json(text, schemas.schema(schemas.STUDIES))
    return _studies_of(rows.select(F.col(row).alias("_row"), parsed.alias("_doc")).select("_row", "_doc.*"))


def _studies_of(documents: DataFrame) -> DataFrame:
    one = F.array(F.struct(F.col("protocolSection").alias("protocolSection")))
    return documents.select("_row", F.posexplode(F.coalesce("studies", one)).alias("_i", "study")).select(
        F.struct("_row", "_i").alias("seq"), F.col("study.protocolSection").alias("p")).where(F.col("p").isNotNull())


def study_rows(studies: DataFrame, unknown_size: int = 100) -> DataFrame:
    """Flat trial rows with the eligibility text; missing fields get their defaults."""
    return studies.select(
        "seq",
        F.coalesce("p.identificationModule.nctId", F.lit("Unknown")).alias("trial_id"),
        F.coalesce("p.identificationModule.briefTitle", F.lit("Unknown")).alias("title"),
        F.coalesce("p.conditionsModule.conditions", F.array().cast("array<string>")).alias("conditions"),
        F.coalesce(F.try_element_at("p.designModule.phases", F.lit(1)), F.lit("NA")).alias("phase"),
        F.coalesce("p.designModule.enrollmentInfo.count", F.lit(unknown_size)).alias("sample_size"),
        F.coalesce("p.statusModule.overallStatus", F.lit("Unknown")).alias("overall_status"),
        F.coalesce("p.eligibilityModule.eligibilityCriteria", F.lit("")).alias("eligibility_criteria"),
    )


def read_field_lists(spark: SparkSession, path: str) -> DataFrame:
    """Records whose fields are lists: the first element of each counts."""
    df = spark.read.schema(schemas.schema(schemas.FIELD_LISTS)).option("multiLine", True).json(path)

    def first(name: str, default: str = "") -> Column:
        return F.coalesce(F.try_element_at(name, F.lit(1)), F.lit(default))

    none = F.array().cast("array<string>")
    return df.select(
        first("NCTId").alias("trial_id"), first("BriefTitle").alias("title"), F.coalesce("Conditions", none).alias("conditions"),
        F.when(F.col("Phase").isNull(), "PHASE2").otherwise(first("Phase")).alias("phase"),
        F.coalesce(first("EnrollmentCount", "0").try_cast("int"), F.lit(0)).alias("sample_size"),
        first("OverallStatus").alias("overall_status"), first("StudyType").alias("study_type"),
        first("EligibilityCriteria").alias("eligibility_criteria"), F.coalesce("Interventions", none).alias("interventions"),
        first("StartDate").alias("start_date"), first("CompletionDate").alias("completion_date"))


def read_registry_csv(spark: SparkSession, path: str, only_completed: bool = True) -> DataFrame:
    """Registry CSV export; by default the completed phase 2 and phase 3 trials."""
    df = spark.read.option("header", True).csv(path)

    def col(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)

    rows = df.select(
        col("NCTId", "NCT_UNKNOWN").alias("trial_id"), col("BriefTitle", "Unknown").alias("title"), col("Conditions", "").alias("conditions"),
        col("Phase", "PHASE2").alias("phase"), col("EnrollmentCount", "100").try_cast("int").alias("sample_size"),
        col("OverallStatus", "").alias("overall_status"))
    return rows.where(F.col("overall_status").contains("Completed") & F.col("phase").rlike("Phase 2|Phase 3")) if only_completed else rows


def _alias(row: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(row[n], F.lit("")) for n in names])


def structured_trials(records: DataFrame, keep: str = "first", coerce_types: bool = True) -> DataFrame:
    """One row per trial id from structured records with field aliases; records without an id are skipped.

    ``keep`` says which of several records of one id counts: the first or the last by ``seq``.
    With ``coerce_types`` unknown entity types become diagnosis and codes are normalised.
    """
    trial_id = F.coalesce(F.nullif("trial_id", F.lit("")), F.nullif("nct_id", F.lit("")))
    pick = F.min_by if keep == "first" else F.max_by
    body = F.struct("title", "conditions", "phase", F.coalesce(F.col("sample_size").try_cast("int"), F.lit(0)).alias("sample_size"),
                    "overall_status", F.when(F.size("criteria") > 0, F.col("criteria")).otherwise(F.col("eligibility_criteria")).alias("criteria"))
    one = records.withColumn("trial_id", trial_id).where(F.col("trial_id").isNotNull()).groupBy("trial_id").agg(pick(body, "seq").alias("b"))
    raw_type = lambda c: F.coalesce(_alias(c, "entity_type", "concept_type"), F.lit("diagnosis"))
    raw_code = lambda c: F.coalesce(_alias(c, "entity_code", "concept_code"), F.lit(""))

    def criterion(c: Column) -> Column:
        kind, code = raw_type(c), raw_code(c)
        if coerce_types:
            code = normalize_code(kind, code)
            kind = F.when(kind.isin(*ENTITY_TYPES), kind).otherwise("diagnosis")
        return F.struct(
            F.coalesce(c["raw_entity"], F.lit("")).alias("raw_entity"), kind.alias("entity_type"),
            code.alias("entity_code"), operator_name(c["operator"]).alias("operator"), finite_double(c["value"]).alias("value"),
            finite_double(c["max_value"]).alias("max_value"), F.coalesce(c["is_inclusion"], F.lit(True)).alias("is_inclusion"),
            F.coalesce(c["severity_weight"], c["weight"], F.lit(1.0)).alias("severity_weight"))

    none = F.array().cast("array<string>")
    return one.select(
        "trial_id", F.coalesce("b.title", F.lit("")).alias("title"), F.coalesce("b.conditions", none).alias("conditions"),
        F.coalesce("b.phase", F.lit("")).alias("phase"), F.col("b.sample_size").alias("sample_size"),
        F.coalesce("b.overall_status", F.lit("")).alias("overall_status"), F.transform("b.criteria", criterion).alias("criteria"))


def read_structured(spark: SparkSession, paths: list[str] | str, keep: str = "first", coerce_types: bool = True,
                    multi_line: bool = True) -> DataFrame:
    """Structured trial files; with several paths, earlier files come first."""
    union: DataFrame | None = None
    for i, path in enumerate([paths] if isinstance(paths, str) else paths):
        df = spark.read.schema(schemas.schema(schemas.TRIAL_RECORD)).option("multiLine", multi_line).json(path)
        df = with_row_order(df, "_row").withColumn("seq", F.struct(F.lit(i).alias("_file"), "_row")).drop("_row")
        union = df if union is None else union.unionByName(df)
    return structured_trials(union, keep, coerce_types)


def explode_criteria(trials: DataFrame) -> DataFrame:
    """One row per criterion with its position in the trial."""
    return trials.select("trial_id", F.posexplode("criteria").alias("criterion_idx", "c")).select("trial_id", "criterion_idx", "c.*")


def nest_criteria(trials: DataFrame, criteria: DataFrame) -> DataFrame:
    """Trials with their criteria as an array again, for the JSON sink."""
    fields = ["raw_entity", "entity_type", "entity_code", "operator", "value", "max_value", "is_inclusion", "severity_weight"]
    nested = criteria.groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("c")))).alias("_c"))
    return trials.join(nested, "trial_id", "left").withColumn("criteria", F.transform(
        F.coalesce("_c", F.array()), lambda e: e["c"])).drop("_c")


def write_trials(trials: DataFrame, out_dir: str, fraction: float = 0.8, fmt: str = "json", mode: str = "overwrite") -> None:
    """Trials split in file order into train and eval, one partition folder each, as JSON or Parquet."""
    bins = F.floor(F.col("seq._row") / 4096) if "struct" in dict(trials.dtypes)["seq"] else None
    prefix_split(trials, "seq", fraction, bins).write.mode(mode).partitionBy("split").format(fmt).save(out_dir)


def load_dataset(mode: str, readers: dict[str, callable]) -> dict[str, DataFrame]:
    """Run the reader of ``mode``; ``auto`` takes the first one whose input is there.

    readers: ordered name -> zero-argument callable, such as ``real`` and ``real_ctg``.
    """
    from pyspark.errors import AnalysisException

    if mode != "auto":
        return readers[mode]()
    for read in readers.values():
        try:
            return read()
        except (AnalysisException, FileNotFoundError):
            continue
    raise FileNotFoundError("no input for any of " + ", ".join(readers))
