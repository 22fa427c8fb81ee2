"""Bootstrap over whole clusters (trials or patients), as joins instead of resampled copies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligra.functions.hashing import uniform
from eligra.operators.metrics import curve_metrics
from eligra.operators.ranking import position
from eligra.session import materialize

MIN_VALID_DRAWS = 20
#: Draws whose weights are added up together.
DRAWS = 128


def bootstrap_draws(clusters: DataFrame, key: str, n_boot: int, seed: int) -> DataFrame:
    """(draw, key, times): how often each cluster is picked in each draw of n out of n."""
    spark = clusters.sparkSession
    ids = clusters.select(key).distinct()
    indexed = position(ids.withColumn("_h", F.md5(F.col(key).cast("string"))), ["_h"], F.substring("_h", 1, 3)).drop("_h")
    n = ids.agg(F.count("*")).scalar()
    slots = spark.range(n_boot).withColumnRenamed("id", "draw").withColumn("_n", n).where("_n > 0")
    picks = slots.select("draw", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("slot")).select(
        "draw", F.floor(uniform(seed, F.col("draw"), F.col("slot")) * F.col("_n")).alias("pos"))
    return picks.groupBy("draw", "pos").agg(F.count("*").alias("times")).join(indexed, "pos").select("draw", key, "times")


def bootstrap_picks(clusters: DataFrame, key: str, n_boot: int, seed: int) -> DataFrame:
    """(key, cluster, draws): the number of each cluster and the draws that pick it, once for every pick; about ``n_boot`` entries each.

    The same draws as ``bootstrap_draws``; picks are gathered by cluster before the shuffle, whose rows do not depend on ``n_boot``.
    """
    ids = clusters.select(key).distinct()
    indexed = position(ids.withColumn("_h", F.md5(F.col(key).cast("string"))), ["_h"], F.substring("_h", 1, 3)).select(key, F.col("pos").alias("cluster"))
    n = ids.count()
    slots = clusters.sparkSession.range(n).select(F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda b: F.floor(uniform(seed, b, F.col("id")) * n))).alias("draw", "cluster"))
    return indexed.join(slots.groupBy("cluster").agg(F.collect_list("draw").alias("draws")), "cluster", "left").withColumn(
        "draws", F.coalesce("draws", F.array().cast("array<int>")))


def _cells(long: DataFrame, names: Sequence[str], rows_per_cell: int) -> DataFrame:
    """``long`` (name, score, ...) with ``cell``: ranges of scores with about as many rows each; equal scores share one."""
    edges = {}
    for name in names:
        part = long.where(F.col("name") == name)
        n = max(1, min(10_000, part.count() // rows_per_cell))
        found = part.agg(F.percentile_approx("score", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else []
        edges[name] = np.array(sorted({e for e in found or []}))
    sent = long.sparkSession.sparkContext.broadcast(edges)

    @F.pandas_udf("int")
    def cell(name: pd.Series, score: pd.Series) -> pd.Series:
        out = np.zeros(len(name), np.int32)
        for k, e in sent.value.items():
            at = (name == k).to_numpy()
            out[at] = np.searchsorted(e, score.to_numpy()[at], side="right")
        return pd.Series(out)

    return long.withColumn("cell", cell("name", "score"))


def _weights(picks: pd.DataFrame, low: int) -> tuple[np.ndarray, np.ndarray]:
    """(clusters in order, how often each of the block's draws picks them)"""
    picks = picks[picks["cluster_"].notna()].sort_values("cluster_")
    table = np.zeros((len(picks), DRAWS))
    for row, draws in enumerate(picks["draws_"]):
        np.add.at(table[row], np.asarray(draws, np.int64) - low, 1)
    return picks["cluster_"].to_numpy(np.int64), table


def _cell_totals(hist: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
    name, cell, block = hist["name"].iloc[0], hist["cell"].iloc[0], hist["block"].iloc[0]
    clusters, table = _weights(picks, int(block) * DRAWS)
    sums = hist.groupby("cluster")[["n_pos", "n_neg"]].sum().reindex(clusters, fill_value=0).to_numpy()
    return pd.DataFrame({"name": [name], "cell": [cell], "block": [block], "pos": [sums[:, 0] @ table], "neg": [sums[:, 1] @ table]})


def _before(totals: pd.DataFrame) -> pd.DataFrame:
    """What lies in the cells of higher scores: vectors, one entry a draw."""
    totals = totals.sort_values("cell", ascending=False)
    for c in ("pos", "neg"):
        own = np.array(totals[c].tolist())
        totals[c] = list(np.cumsum(own, axis=0) - own)
    return totals


def _cell_curves(hist: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A cell's share of the Mann-Whitney count and of average precision, for all draws of a block in one pass over its sorted scores."""
    name, block = hist["name"].iloc[0], hist["block"].iloc[0]
    clusters, table = _weights(right, int(block) * DRAWS)
    start = right[right["cluster_"].isna()].iloc[0]
    hist = hist.sort_values("score", ascending=False)
    ends = np.flatnonzero(np.append(np.diff(hist["score"].to_numpy()) != 0, True)) + 1
    at, n_pos, n_neg = np.searchsorted(clusters, hist["cluster"].to_numpy()), hist["n_pos"].to_numpy(), hist["n_neg"].to_numpy()
    above, below = np.asarray(start["pos_"], float), np.asarray(start["neg_"], float)
    wins, precision = np.zeros(DRAWS), np.zeros(DRAWS)
    first = above.copy(), below.copy()
    begin = 0
    for end in ends.tolist():  # one score: all its rows at once
        weight = table[at[begin:end]]
        pos, neg = n_pos[begin:end] @ weight, n_neg[begin:end] @ weight
        above, below = above + pos, below + neg
        wins += neg * (above - pos / 2)
        precision += np.divide(pos * above, above + below, out=np.zeros(DRAWS), where=above + below > 0)
        begin = end
    return pd.DataFrame({"name": [name], "block": [block], "pos": [above - first[0]], "neg": [below - first[1]], "wins": [wins], "precision": [precision]})


def _curve_of_draws(parts: pd.DataFrame) -> pd.DataFrame:
    pos, neg, wins, precision = (np.sum(parts[c].tolist(), axis=0) for c in ("pos", "neg", "wins", "precision"))
    ok = (pos > 0) & (neg > 0)
    draw = np.flatnonzero(ok)
    return pd.DataFrame({"draw": draw + int(parts["block"].iloc[0]) * DRAWS, "name": parts["name"].iloc[0],
                         "roc_auc": (wins[ok] / (pos[ok] * neg[ok])), "average_precision": precision[ok] / pos[ok]})


def bootstrap_metrics(rows: DataFrame, key: str, score_columns: Sequence[str], n_boot: int = 1000, seed: int = 0,
                      rows_per_cell: int = 20_000) -> DataFrame:
    """(draw, name, roc_auc, average_precision) for several score columns on the same draws.

    Rows are first reduced to positives and negatives per (cluster, score), cut into cells of consecutive scores. Every cluster has
    one array of weights, an entry for each draw, that meets each cell once; a pass over a cell's sorted scores adds up vectors, so all
    draws of a block are done together. Totals of the cells, vectors too, become the starts of the next ones. Shuffled rows
    grow with the histogram and the blocks of ``DRAWS`` draws, not with the draws. Draws with one class give no row.
    """
    long = rows.select(key, "y", F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("score")) for c in score_columns])).alias("s"))
    hist = long.groupBy(key, F.col("s.name").alias("name"), F.col("s.score").alias("score")).agg(
        F.sum(F.col("y").cast("bigint")).alias("n_pos"), F.sum(1 - F.col("y").cast("bigint")).alias("n_neg"))
    picks = materialize(bootstrap_picks(rows, key, n_boot, seed))
    placed = materialize(_cells(materialize(hist.join(picks.select(key, "cluster"), key).drop(key)), score_columns, rows_per_cell))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // DRAWS))).alias("block")
    by_block = picks.select("cluster", "draws", blocks).select(
        "cluster", "block", F.filter("draws", lambda d: F.floor(d / DRAWS) == F.col("block")).alias("draws"))
    met = materialize(placed.select("name", "cell", "cluster").distinct().join(by_block, "cluster").select("name", "cell", "block", "cluster", "draws"))
    left = placed.select("name", "cell", blocks, "cluster", "score", "n_pos", "n_neg")
    keys = ["name", "cell", "block"]

    def side(df: DataFrame) -> DataFrame:  # other column names, as both sides come from one table
        return df.select(*[F.col(c).alias(f"{c}_") for c in df.columns])

    vectors = "name string, cell int, block int, pos array<double>, neg array<double>"
    totals = left.groupBy(*keys).cogroup(side(met).groupBy(*[f"{k}_" for k in keys])).applyInPandas(_cell_totals, vectors)
    starts = totals.groupBy("name", "block").applyInPandas(_before, vectors)
    both = met.unionByName(starts, allowMissingColumns=True)
    curves = left.groupBy(*keys).cogroup(side(both).groupBy(*[f"{k}_" for k in keys])).applyInPandas(
        _cell_curves, "name string, block int, pos array<double>, neg array<double>, wins array<double>, precision array<double>")
    return curves.groupBy("name", "block").applyInPandas(_curve_of_draws, "draw bigint, name string, roc_auc double, average_precision double")


def cluster_bootstrap_ci(rows: DataFrame, key: str, score: str = "score", n_boot: int = 1000, alpha: float = 0.05,
                         seed: int = 0) -> DataFrame:
    """Percentile interval of both metrics; null when fewer than 20 draws are usable."""
    draws = bootstrap_metrics(rows, key, [score], n_boot, seed)
    enough = F.count("*") >= MIN_VALID_DRAWS

    def bound(metric: str, q: float):
        return F.when(enough, F.percentile(metric, F.lit(q)))

    return draws.agg(
        F.count("*").alias("n_valid"),
        *[bound(m, q).alias(f"{m}_{side}") for m in ("roc_auc", "average_precision")
          for side, q in (("lo", alpha / 2), ("hi", 1 - alpha / 2))])


def _differences(rows: DataFrame, key: str, a: str, b: str, metric: str, n_boot: int, seed: int) -> DataFrame:
    draws = materialize(bootstrap_metrics(rows, key, [a, b], n_boot, seed))
    return draws.groupBy("draw").agg(
        (F.max(F.when(F.col("name") == a, F.col(metric))) - F.max(F.when(F.col("name") == b, F.col(metric)))).alias("diff"))


def _observed(rows: DataFrame, score: str, metric: str):
    hist = rows.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col("y").cast("bigint")).alias("n_pos"), F.sum(1 - F.col("y").cast("bigint")).alias("n_neg"))
    return curve_metrics(hist).select(metric).scalar()


def paired_bootstrap_test(rows: DataFrame, key: str, a: str, b: str, metric: str = "average_precision",
                          n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Two-sided test of metric(a) - metric(b): share of centred draws at least as large as observed."""
    diffs = _differences(rows, key, a, b, metric, n_boot, seed)
    mean = diffs.agg(F.avg("diff")).scalar()
    seen = diffs.withColumn("_mean", mean).withColumn("observed", _observed(rows, a, metric) - _observed(rows, b, metric))
    enough = F.count("diff") >= MIN_VALID_DRAWS
    extreme = (F.abs(F.col("diff") - F.col("_mean")) >= F.abs(F.col("observed"))).cast("double")
    return seen.agg(
        F.max("observed").alias("diff"), F.when(enough, F.avg(extreme)).alias("p_value"),
        F.when(enough, F.percentile("diff", F.lit(0.025))).alias("ci_lo"),
        F.when(enough, F.percentile("diff", F.lit(0.975))).alias("ci_hi"), F.count("diff").alias("n_boot_used"))


def sign_bootstrap(rows: DataFrame, key: str, base: str, full: str, metric: str = "roc_auc", n_boot: int = 1000,
                   seed: int = 0) -> DataFrame:
    """Interval of metric(full) - metric(base) and twice the share of draws of the opposite sign."""
    diffs = _differences(rows, key, full, base, metric, n_boot, seed)
    mean = diffs.agg(F.avg("diff")).scalar()
    df = diffs.withColumn("_sign", F.signum(mean))
    share = F.avg((F.col("diff") * F.col("_sign") <= 0).cast("double"))
    return df.agg(
        F.percentile("diff", F.lit(0.025)).alias("diff_lo"), F.percentile("diff", F.lit(0.975)).alias("diff_hi"),
        F.when(F.max("_sign") == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * share)).alias("p_value"),
        F.count("diff").alias("n_valid"))


def three_way_bootstrap(rows: DataFrame, key: str, scores: Sequence[str], metric: str = "roc_auc", n_boot: int = 1000,
                        seed: int = 0) -> DataFrame:
    """Interval per model on shared draws."""
    return bootstrap_metrics(rows, key, scores, n_boot, seed).groupBy("name").agg(
        F.percentile(metric, F.lit(0.025)).alias("lo"), F.percentile(metric, F.lit(0.975)).alias("hi"),
        F.avg(metric).alias("mean"), F.count(metric).alias("n_valid"))
