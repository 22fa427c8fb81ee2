"""Coverage, resolution and consistency reports over structured criteria."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligra.functions import lexicon as lex
from eligra.functions import text as tx
from eligra.functions.codes import looks_icd9, normalize_code
from eligra.operators.hierarchy import vocabulary_lookup
from eligra.operators.ranking import top_k

VOCABULARY_TYPES = ("diagnosis", "medication", "lab")
MAGNET_TEXTS = 15
REQUIRED_FIELDS = ("raw_entity", "entity_type", "entity_code", "operator", "value", "is_inclusion", "severity_weight")


def coverage_report(criteria: DataFrame, codes: DataFrame, n_examples: int = 10) -> DataFrame:
    """Matched, attempted and placeholder criteria per entity type with a grand total.

    entity_type is null on the total row. Examples are the first missed codes in code order.
    """
    known = vocabulary_lookup(criteria.where(F.col("entity_type").isin(*VOCABULARY_TYPES)), codes)
    missed = ~F.col("in_vocab") & ~F.col("is_placeholder")
    counts = known.rollup("entity_type").agg(
        F.count_if("in_vocab").alias("n_matched"), F.count_if(~F.col("is_placeholder")).alias("n_attempted"),
        F.count_if("is_placeholder").alias("n_placeholder"), F.count("*").alias("n_total"))
    missed_codes = known.where(missed).select("entity_type", "entity_code").distinct()
    total = missed_codes.select(F.lit("TOTAL").alias("entity_type"), "entity_code").distinct()
    examples = _first_examples(missed_codes.unionByName(total), "entity_code", n_examples, "missed_examples")
    pct = F.coalesce(F.try_divide(100.0 * F.col("n_matched"), F.col("n_attempted")), F.lit(0.0))
    return (
        counts.withColumn("_t", F.coalesce("entity_type", F.lit("TOTAL")))
        .join(examples.withColumnRenamed("entity_type", "_t"), "_t", "left").drop("_t").withColumn("matched_pct", pct)
        .withColumn("missed_examples", F.coalesce("missed_examples", F.array().cast("array<string>")))
    )


def _first_examples(rows: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """The first ``n`` distinct values per entity type, cut before they are collected."""
    return top_k(rows.select("entity_type", value).distinct(), ["entity_type"], [F.asc(value)], n).groupBy("entity_type").agg(
        F.array_sort(F.collect_list(value)).alias(name))


def resolution_status(criteria: DataFrame, codes: DataFrame) -> DataFrame:
    """Criteria with ``status`` (RESOLVED, OOV, UNMATCHED_PLACEHOLDER) and ``aligned_status``,
    where a diagnosis whose category occurs in the cohort turns RESOLVED_VIA_ALIGNMENT."""
    categories = codes.where("entity_type = 'diagnosis'").select(
        F.substring("code", 1, 3).alias("_category")).distinct().withColumn("_near", F.lit(True))
    df = vocabulary_lookup(criteria, codes).withColumn(
        "_category", F.substring(F.upper(F.regexp_replace("entity_code", r"[. ]", "")), 1, 3)).join(categories, "_category", "left")
    status = F.when(F.col("is_placeholder"), "UNMATCHED_PLACEHOLDER").when(F.col("in_vocab"), "RESOLVED").otherwise("OOV")
    near = (F.col("status") == "OOV") & (F.col("entity_type") == "diagnosis") & F.col("_near").isNotNull()
    return df.withColumn("status", status).withColumn(
        "aligned_status", F.when(near, "RESOLVED_VIA_ALIGNMENT").otherwise(F.col("status"))).drop("_category", "_near")


def resolution_pivot(criteria: DataFrame, codes: DataFrame) -> DataFrame:
    """Criteria per entity type and side by status, plus the overall row (nulls)."""
    side = F.when(F.col("is_inclusion"), "inclusion").otherwise("exclusion")
    df = resolution_status(criteria, codes).withColumn("side", side)
    status = F.col("aligned_status")
    counts = [F.count_if(status == s).alias(a) for s, a in (
        ("RESOLVED", "n_resolved"), ("OOV", "n_oov"), ("UNMATCHED_PLACEHOLDER", "n_unmatched"),
        ("RESOLVED_VIA_ALIGNMENT", "n_via_alignment"))]
    per_side = df.groupBy("entity_type", "side").agg(*counts, F.count("*").alias("n_total"))
    total = df.agg(*counts, F.count("*").alias("n_total")).select(
        F.lit(None).cast("string").alias("entity_type"), F.lit(None).cast("string").alias("side"),
        "n_resolved", "n_oov", "n_unmatched", "n_via_alignment", "n_total")
    return per_side.unionByName(total).withColumn("resolved_pct", F.try_divide(100.0 * F.col("n_resolved"), F.col("n_total")))


def oov_examples(criteria: DataFrame, codes: DataFrame, n: int = 15) -> DataFrame:
    missed = resolution_status(criteria, codes).where("status = 'OOV'").select("entity_type", "entity_code", "norm_code").distinct()
    text = F.concat(F.col("entity_code"), F.lit(" -> normalized: "), F.col("norm_code"))
    return _first_examples(missed.select("entity_type", text.alias("example")), "example", n, "examples")


def unresolved_trials(criteria: DataFrame, codes: DataFrame) -> DataFrame:
    """Trials without a resolved inclusion, exclusion or either, before and after alignment."""
    df = resolution_status(criteria, codes)
    inc = F.col("is_inclusion")
    before, after = F.col("status") == "RESOLVED", F.col("aligned_status").isin("RESOLVED", "RESOLVED_VIA_ALIGNMENT")
    per = df.groupBy("trial_id").agg(
        F.count_if(inc & before).alias("i0"), F.count_if(~inc & before).alias("e0"),
        F.count_if(inc & after).alias("i1"), F.count_if(~inc & after).alias("e1"))
    zero = lambda *cs: F.count_if(tx.all_true(*[F.col(c) == 0 for c in cs]))
    return per.agg(
        F.count("*").alias("n_trials"), zero("i0").alias("zero_inc"), zero("e0").alias("zero_exc"), zero("i0", "e0").alias("zero_both"),
        zero("i1").alias("zero_inc_aligned"), zero("e1").alias("zero_exc_aligned"), zero("i1", "e1").alias("zero_both_aligned"))


def conflicting_bounds(criteria: DataFrame, entity: str = "raw_entity") -> DataFrame:
    """Entities of a trial with more than one distinct (operator, value)."""
    bounded = criteria.where((F.col("operator") != "EXISTS") & F.col("value").isNotNull())
    pairs = bounded.select("trial_id", F.lower(F.trim(F.col(entity).cast("string"))).alias("entity"), "operator", "value").distinct()
    return pairs.groupBy("trial_id", "entity").agg(F.count("*").alias("n_bounds")).where("n_bounds > 1")


def validate_criteria(criteria: DataFrame) -> DataFrame:
    """One row of counts: totals, mapped codes, numeric bounds, sides and signs of a dirty extraction."""
    raw = F.coalesce("raw_entity", F.lit(""))
    stop = F.lower(F.trim(raw)).isin(*lex.STOP_ENTITIES)
    numeric = F.col("operator").isin("LTE", "GTE", "LT", "GT", "EQ")
    mapped = F.coalesce(F.col("entity_code") != "UNKNOWN_CODE", F.lit(True))
    conflicts = conflicting_bounds(criteria).agg(F.count("*")).scalar()
    return criteria.agg(
        F.countDistinct("trial_id").alias("n_trials"), F.count("*").alias("n_criteria"), F.count_if(mapped).alias("n_mapped"),
        F.count_if(numeric & F.col("value").isNotNull()).alias("n_numeric"),
        F.count_if(numeric & F.col("value").isNull()).alias("n_missing_value"),
        F.count_if("is_inclusion").alias("n_inclusion"),
        F.count_if(~F.coalesce("is_inclusion", F.lit(False))).alias("n_exclusion"),
        F.count_if(stop).alias("n_stop_words"), F.count_if(raw.rlike(r"[()\[\]\\]")).alias("n_unsanitized"),
        F.greatest(F.count_if(mapped) - F.count_if(stop), F.lit(0)).alias("n_true_mapped"),
    ).withColumn("n_conflicts", conflicts)


def violations(criteria: DataFrame) -> DataFrame:
    """One row per criterion and problem found by the validator, missing fields included."""
    raw = F.coalesce("raw_entity", F.lit(""))
    numeric = F.col("operator").isin("LTE", "GTE", "LT", "GT", "EQ")
    required = [c for c in REQUIRED_FIELDS if c not in ("value", "raw_entity")]
    problems = F.array_compact(F.array(
        F.when(F.lower(F.trim(raw)).isin(*lex.STOP_ENTITIES), F.lit("stop word")),
        F.when(raw.rlike(r"[()\[\]\\]"), F.lit("unsanitized")),
        F.when(numeric & F.col("value").isNull(), F.lit("missing value")),
        *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]))
    return criteria.select("trial_id", "criterion_idx", F.explode(problems).alias("problem"))


def missing_fields(columns: list[str]) -> list[str]:
    return [c for c in REQUIRED_FIELDS if c not in columns]


def inclusion_balance(criteria: DataFrame, text: Column | None = None) -> DataFrame:
    """Inclusion and exclusion criteria, trials without either, and mistagged-looking lines."""
    inc = F.col("is_inclusion")
    suspicious = F.lit(False) if text is None else inc & tx.sounds_like_exclusion(text)
    per = criteria.groupBy("trial_id").agg(
        F.count_if(inc).alias("i"), F.count_if(~inc).alias("e"), F.count_if(suspicious).alias("s"))
    return per.agg(
        F.count("*").alias("n_trials"), F.sum("i").alias("n_inclusion"), F.sum("e").alias("n_exclusion"),
        F.count_if(F.col("i") == 0).alias("trials_without_inclusion"), F.count_if(F.col("e") == 0).alias("trials_without_exclusion"),
        F.sum("s").alias("n_suspicious"))


def code_magnets(criteria: DataFrame, min_texts: int = MAGNET_TEXTS, text: str = "raw_entity", width: int | None = None) -> DataFrame:
    """Codes that gather too many different texts, a sign of a phrase that matches anything."""
    texts = F.col(text) if width is None else F.substring(text, 1, width)
    pairs = criteria.select("entity_code", texts.alias("t")).distinct()
    return pairs.groupBy("entity_code").agg(F.count("t").alias("n_texts")).where(F.col("n_texts") > min_texts)


def icd9_share(criteria: DataFrame) -> DataFrame:
    dx = criteria.where("entity_type = 'diagnosis'")
    return dx.agg(F.count("*").alias("n_diagnosis"), F.count_if(looks_icd9(F.col("entity_code"))).alias("n_icd9")).withColumn(
        "icd9_share", F.try_divide("n_icd9", "n_diagnosis"))


def missing_codes(criteria: DataFrame, codes: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent criterion codes the cohort does not have."""
    norm = normalize_code(F.col("entity_type"), F.col("entity_code"))
    absent = criteria.withColumn("code", norm).join(codes.select("code").distinct(), "code", "left_anti")
    return absent.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(k)


def matching_trials(criteria: DataFrame, codes: DataFrame) -> DataFrame:
    """Trials with at least one code of the cohort, whatever its type."""
    vocab = codes.select(F.col("code").alias("entity_code")).distinct()
    return criteria.select("trial_id", "entity_code").distinct().join(vocab, "entity_code", "left_semi").select("trial_id").distinct()


def extraction_rates(criteria: DataFrame) -> DataFrame:
    """Matched, administrative and unmatched criteria of a dictionary parse."""
    admin = F.col("entity_type") == "administrative"
    lost = F.col("entity_code").startswith("UNMATCHED_")
    return criteria.agg(
        F.count("*").alias("n_criteria"), F.count_if(~F.coalesce(admin, F.lit(False)) & ~lost).alias("n_matched"),
        F.count_if(admin).alias("n_administrative"), F.count_if(lost).alias("n_unmatched"))


def term_histogram(matched: DataFrame, k: int = 10, term: str = "matched_term", times: str | None = None) -> DataFrame:
    """The ``k`` most frequent terms; a row counts as often as its column ``times`` says, if one is given."""
    return matched.groupBy(term).agg((F.sum(times) if times else F.count("*")).alias("n")).orderBy(F.desc("n"), term).limit(k)


def phase_counts(trials: DataFrame) -> DataFrame:
    return trials.groupBy("phase").agg(F.count("*").alias("n"))


def top_conditions(trials: DataFrame, k: int = 10) -> DataFrame:
    return trials.select(F.explode("conditions").alias("condition")).groupBy("condition").agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "condition").limit(k)


def dataset_summary(criteria: DataFrame, codes: DataFrame) -> DataFrame:
    """Trials, patients, mean criteria per side and mean diagnoses per patient."""
    per_trial = criteria.groupBy("trial_id").agg(F.count_if("is_inclusion").alias("i"), F.count_if(~F.col("is_inclusion")).alias("e"))
    per_patient = codes.groupBy("patient_id").agg(F.count_if(F.col("entity_type") == "diagnosis").alias("d"))
    n_patients, mean_dx = per_patient.agg(F.count("*")).scalar(), per_patient.agg(F.avg("d")).scalar()
    return per_trial.agg(F.count("*").alias("n_trials"), F.avg("i").alias("mean_inc"), F.avg("e").alias("mean_exc")).withColumn(
        "n_patients", n_patients).withColumn("mean_dx_per_patient", mean_dx)
