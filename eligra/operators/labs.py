"""Lab events: cleaning, per-item z-scores and the capped daily decay grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eligra.operators.cohort import upper_to_lower

SIGMA_LIMIT = 4.0
MIN_LAB_FREQ = 0.05
GRID_CAP_DAYS = 30
DECAY_RHO = 0.1


def clean_labs(labevents: DataFrame, cohort: DataFrame | None = None) -> DataFrame:
    """Typed lab rows with their day; unreadable values and times are dropped."""
    df = upper_to_lower(labevents)
    seq = F.col("event_id") if "event_id" in df.columns else F.xxhash64("valuenum")
    df = df.select(
        F.col("subject_id").try_cast("bigint").alias("subject_id"),
        F.col("itemid").try_cast("int").alias("itemid"),
        F.col("charttime").try_cast("timestamp_ntz").alias("charttime"),
        F.col("valuenum").try_cast("double").alias("valuenum"),
        seq.alias("seq"),
    ).dropna(subset=["subject_id", "itemid", "charttime", "valuenum"]).where(~F.isnan("valuenum"))
    if cohort is not None:
        df = df.join(cohort, "subject_id", "left_semi")
    return df.withColumn("day", F.to_date("charttime"))


def active_items(labs: DataFrame, cohort: DataFrame, min_frequency: float = MIN_LAB_FREQ) -> DataFrame:
    """Items measured in a large enough share of the cohort, with mean and sample deviation.

    The distinct patient count makes Spark group by (item, patient) first, so one frequent item
    is spread over its patients and the moments ride along in the same shuffle.
    """
    cohort_size = cohort.agg(F.count("*")).scalar()
    return (
        labs.groupBy("itemid")
        .agg(F.countDistinct("subject_id").alias("n_patients"), F.avg("valuenum").alias("mean"),
             F.stddev_samp("valuenum").alias("std"))
        .where((F.col("n_patients") / cohort_size >= F.lit(min_frequency)) & (F.col("std") > 0))
    )


def zscore_labs(labs: DataFrame, cohort: DataFrame, sigma_limit: float = SIGMA_LIMIT,
                min_frequency: float = MIN_LAB_FREQ) -> DataFrame:
    """Clamp to mean +- sigma_limit deviations, then scale by the unclamped moments."""
    low, high = F.col("mean") - sigma_limit * F.col("std"), F.col("mean") + sigma_limit * F.col("std")
    clamped = F.least(F.greatest(F.col("valuenum"), low), high)
    return labs.join(active_items(labs, cohort, min_frequency), "itemid").withColumn(
        "value_norm", (clamped - F.col("mean")) / F.col("std"))


def daily_values(labs: DataFrame, value: str = "value_norm") -> DataFrame:
    """One value per patient, item and day: the earliest of the day, then the lowest event id."""
    return labs.groupBy("subject_id", "itemid", "day").agg(
        F.min_by(value, F.struct("charttime", "seq")).alias("value"))


def expand_daily_grid(daily: DataFrame, cap: int = GRID_CAP_DAYS, rho: float = DECAY_RHO,
                      prefer: str = "carry") -> DataFrame:
    """Carry each value forward day by day, decaying, until the next one or ``cap`` days.

    Segments only ever overlap on a re-measurement day, so which of the two values is kept
    there (``carry``: the old one, ``fresh``: the new one) is decided by the bounds of the day
    sequence instead of a second shuffle to remove duplicates. A lone measurement stays one row.
    The input holds one row per day, so a window group is bounded by the length of the record.
    """
    series = Window.partitionBy("subject_id", "itemid").orderBy("day")
    gap_next = F.datediff(F.lead("day").over(series), F.col("day"))
    gap_prev = F.datediff(F.col("day"), F.lag("day").over(series))
    df = daily.withColumn("gap_next", gap_next).withColumn("gap_prev", gap_prev)
    lone = F.col("gap_next").isNull() & F.col("gap_prev").isNull()
    last = F.when(lone, F.lit(0)).otherwise(F.least(F.coalesce("gap_next", F.lit(cap)), F.lit(cap)))
    first = F.lit(0)
    if prefer == "carry":
        first = F.when(F.col("gap_prev") <= cap, 1).otherwise(0)
    elif prefer == "fresh":
        last = last - F.when(F.col("gap_next") <= cap, 1).otherwise(0)
    else:
        raise ValueError(f"prefer must be carry or fresh, not {prefer}")
    return (
        df.withColumn("days_since_measured", F.explode(F.sequence(first, last)))
        .select(
            F.date_add("day", F.col("days_since_measured")).alias("charttime"), "subject_id", "itemid",
            (F.col("value") * F.exp(F.lit(-rho) * F.col("days_since_measured"))).alias("imputed_value_decayed"),
            "days_since_measured",
        )
    )


def labs_clean(labevents: DataFrame, cohort: DataFrame, **grid) -> DataFrame:
    """Whole lab stage: clean, drop rare items, scale, expand."""
    return expand_daily_grid(daily_values(zscore_labs(clean_labs(labevents, cohort), cohort)), **grid)


def last_measured(labs: DataFrame) -> DataFrame:
    """Most recent raw value per patient and item."""
    return labs.groupBy("subject_id", "itemid").agg(
        F.max_by("valuenum", F.struct("charttime", "seq")).alias("value"))


def grid_tail(daily: DataFrame, cap: int = GRID_CAP_DAYS, rho: float = DECAY_RHO) -> DataFrame:
    """The last grid row per patient and item without building the grid.

    With two or more measurement days the grid ends ``cap`` days after the last one, so the
    value there has decayed by exp(-rho * cap); a lone measurement is left as it is.
    """
    last = daily.groupBy("subject_id", "itemid").agg(
        F.max_by("value", "day").alias("value"), F.count("*").alias("n_days"))
    faded = F.col("value") * F.exp(F.lit(-rho * cap))
    return last.select("subject_id", "itemid", F.when(F.col("n_days") > 1, faded).otherwise(F.col("value")).alias("value"))
