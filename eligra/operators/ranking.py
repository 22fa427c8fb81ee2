"""Positions and running totals over large ordered groups, without one task per group.

Rows of a group are cut into ordered bins by a value-derived key. Bin totals are tiny and are
accumulated in one window; the detail only ever sorts within a bin. The bins depend on row values
alone, so a recomputed task lands on the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from eligra.functions.hashing import draw_key
from eligra.session import materialize


def position(df: DataFrame, order_by: Sequence[str], bins: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Add ``pos``: 0-based position by ``order_by`` within ``groups``.

    ``bins`` must not decrease along ``order_by``.
    """
    groups = list(groups)
    df = df.withColumn("_bin", bins)
    totals = df.groupBy(*groups, "_bin").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*groups, "_bin").orderBy(*order_by)
    return (
        df.join(offsets, groups + ["_bin"])
        .withColumn("pos", F.row_number().over(within) - 1 + F.col("_offset")).drop("_bin", "_offset")
    )


def range_bin(df: DataFrame, key: str, bins: int = 256) -> Column:
    """Ordered bin of ``key`` for ``position``: numbers and texts alike, by edges cut from a sketch of the keys themselves.

    The edges (a fixed number, whatever the table's size) are approximate quantiles for numbers and a range of the
    lowest hashes' keys for other types; only how even the bins are depends on them, not the positions.
    """
    if isinstance(df.schema[key].dataType, NumericType):
        found = df.agg(F.percentile_approx(key, [i / bins for i in range(1, bins)], 1000)).first()[0] or []
    else:
        found = [r[0] for r in df.select(key).distinct().orderBy(F.xxhash64(key)).limit(bins).collect()]
    edges = [F.lit(e) for e in sorted({e for e in found if e is not None})]
    return F.size(F.filter(F.array(*edges), lambda e: e <= F.col(key))) if edges else F.lit(0)


def shuffled_position(df: DataFrame, ids: Sequence[str], seed: int, groups: Sequence[str] = ()) -> DataFrame:
    """``pos`` in a seeded shuffle of the rows; hash bins are even whatever the ids look like."""
    keyed = df.withColumn("_key", draw_key(seed, *[F.col(i) for i in ids]))
    return position(keyed, ["_key", *ids], F.substring("_key", 1, 3), groups).drop("_key")


def running_totals(df: DataFrame, values: Sequence[str], order: str = "score", groups: Sequence[str] = (),
                   descending: bool = True, bins: int = 256) -> DataFrame:
    """Add ``cum_<v>``: inclusive running sum of each value along ``order`` within ``groups``.

    ``order`` is numeric and unique within a group (pre-aggregate ties first). The rows are written once and cut at ``bins`` - 1 splitters
    taken from their own values, so a bin holds about as many rows as any other however close the values lie; the totals
    of the bins before are added to prefix sums within each.
    """
    groups = list(groups)
    direction = F.desc if descending else F.asc
    df = materialize(df)
    df = df.withColumn("_bin", range_bin(df, order, bins))
    totals = df.groupBy(*groups, "_bin").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.partitionBy(*groups).orderBy(direction("_bin")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_bin", *[
        F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    within = Window.partitionBy(*groups, "_bin").orderBy(direction(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    df = df.join(offsets, groups + ["_bin"])
    for v in values:
        df = df.withColumn(f"cum_{v}", F.col(f"_o_{v}") + F.sum(v).over(within))
    return df.drop("_bin", *[f"_o_{v}" for v in values])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """(prob, quantile) with linear interpolation, from a histogram of distinct values.

    The built-in ``percentile`` keeps every distinct value in one buffer; here the two order
    statistics of each probability are picked out of a binned running count.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("score")).agg(F.count("*").alias("n"))
    hist = materialize(hist)
    total = hist.agg(F.sum("n")).scalar()
    cum = running_totals(hist, ["n"], descending=False).withColumn("_total", total)
    low, high = F.col("cum_n") - F.col("n"), F.col("cum_n")
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob")) for p in probs])
    ranks = F.transform(wanted, lambda w: F.struct(
        w["prob"].alias("prob"), F.floor(w["prob"] * (F.col("_total") - 1)).alias("lo"),
        F.ceil(w["prob"] * (F.col("_total") - 1)).alias("hi"), (w["prob"] * (F.col("_total") - 1)).alias("at")))
    inside = F.filter(ranks, lambda r: ((r["lo"] >= low) & (r["lo"] < high)) | ((r["hi"] >= low) & (r["hi"] < high)))
    found = cum.select("score", low.alias("low"), high.alias("high"), F.explode(inside).alias("r"))
    pick = found.groupBy(F.col("r.prob").alias("prob")).agg(
        F.max("r.at").alias("at"), F.max("r.lo").alias("lo"),
        F.max(F.when((F.col("r.lo") >= F.col("low")) & (F.col("r.lo") < F.col("high")), F.col("score"))).alias("a"),
        F.max(F.when((F.col("r.hi") >= F.col("low")) & (F.col("r.hi") < F.col("high")), F.col("score"))).alias("b"))
    return pick.select("prob", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("lo"))).alias("quantile"))


def top_k(df: DataFrame, groups: Sequence[str], order_by: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per group with their ``rank``; Spark keeps k rows per group and task before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order_by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
