"""Leak-free patient x trial splits, folds and pair sampling.

Every draw orders rows by a hash of seed and id, so a split is the same whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligra.functions.hashing import draw_key, uniform
from eligra.functions.permutation import permuted
from eligra.operators.labels import POSITIVE, complete_pairs, positive_pairs
from eligra.operators.match import PairScores
from eligra.operators.ranking import exact_quantiles, position, range_bin, shuffled_position, top_k
from eligra.session import materialize

FRACTIONS = (0.70, 0.15, 0.15)
NEG_PER_POS = 20
MIN_NEGATIVES = 1000
MAX_TRAIN_PAIRS = 2_000_000
MIN_POSITIVES = 20
PREVALENCE_BINS = 4


def _split_name(pos: Column, n: Column, fractions: Sequence[float], rounding: str) -> Column:
    rounded = F.bround if rounding == "round" else (lambda c, *_: F.floor(c))
    n_train = rounded(F.lit(fractions[0]) * n, 0).cast("bigint")
    n_val = rounded(F.lit(fractions[1]) * n, 0).cast("bigint")
    return F.when(pos < n_train, "train").when(pos < n_train + n_val, "val").otherwise("test")


def partition_ids(ids: DataFrame, key: str, seed: int, fractions: Sequence[float] = FRACTIONS,
                  rounding: str = "round", bins: str | None = None) -> DataFrame:
    """Assign each id to train, val or test by its place in a seeded shuffle.

    ``rounding``: ``round`` (half-even) or ``floor`` for the split sizes. ``bins`` names a stratum
    column; each stratum is then partitioned on its own.
    """
    groups = [] if bins is None else [bins]
    unique = ids.select(key, *groups).distinct()
    ranked = shuffled_position(unique, [key], seed, groups)
    if bins is None:
        ranked = ranked.withColumn("_size", unique.agg(F.count("*")).scalar())
    else:
        ranked = ranked.join(unique.groupBy(bins).agg(F.count("*").alias("_size")), bins)
    return ranked.select(key, *groups, _split_name(F.col("pos"), F.col("_size"), fractions, rounding).alias("split"))


def prevalence_bins(prevalence: DataFrame, n_bins: int = PREVALENCE_BINS, min_per_bin: int = 0) -> DataFrame:
    """Stratum of each trial by quantile of its share of eligible patients (trial_id, prevalence).

    With ``min_per_bin``, one bin when there are fewer trials per bin than that (0: never).
    """
    prevalence = materialize(prevalence)
    edges = exact_quantiles(prevalence, "prevalence", [i / n_bins for i in range(1, n_bins)]).agg(F.collect_list("quantile")).scalar()
    n = prevalence.agg(F.count("*")).scalar()
    return prevalence.withColumn("_edges", edges).withColumn("_n", n).select(
        "trial_id", F.when(F.col("_n") < min_per_bin * n_bins, 0).otherwise(
            F.size(F.filter("_edges", lambda e: e <= F.col("prevalence")))).alias("bin"))


#: Patient and trial split of each block of pairs in use.
QUADRANTS = {"train": ("train", "train"), "val": ("val", "val"), "test": ("test", "test"),
             "cold_patient_only": ("test", "train"), "cold_trial_only": ("train", "test")}


def quadrant(patient_split: Column, trial_split: Column) -> Column:
    """Name of the block a pair falls in; null for blocks that are never used."""
    return F.coalesce(*[F.when((patient_split == p) & (trial_split == t), name) for name, (p, t) in QUADRANTS.items()])


def split_pairs(labels: PairScores, patient_splits: DataFrame, trial_splits: DataFrame,
                quadrants: Sequence[str] = tuple(QUADRANTS)) -> DataFrame:
    """Every pair of the named quadrants, hit or not, tagged with its quadrant."""
    out = None
    for name in quadrants:
        p_split, t_split = QUADRANTS[name]
        part = complete_pairs(labels, patient_splits.where(F.col("split") == p_split), trial_splits.where(F.col("split") == t_split))
        part = part.withColumn("quadrant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def quadrant_sizes(labels: PairScores, patient_splits: DataFrame, trial_splits: DataFrame) -> DataFrame:
    """Pairs and positives per quadrant, counting pairs without a hit in bulk."""
    n_patients = patient_splits.groupBy(F.col("split").alias("p_split")).agg(F.count("*").alias("n_patients"))
    hits = labels.by_trial([POSITIVE], patient_splits.select("patient_id", F.col("split").alias("p_split"))).withColumnRenamed("n", "n_hit")
    trials = labels.defaults.select("trial_id", "y").join(
        trial_splits.select("trial_id", F.col("split").alias("t_split")), "trial_id")
    # One row per (trial, patient split): three splits at most.
    per_trial = trials.withColumn("p_split", F.explode(F.array(F.lit("train"), F.lit("val"), F.lit("test"))))
    df = (
        per_trial.join(n_patients, "p_split").join(hits, ["trial_id", "p_split"], "left")
        .fillna({"n_hit": 0, "y_hit": 0})
        .withColumn("quadrant", quadrant(F.col("p_split"), F.col("t_split"))).where(F.col("quadrant").isNotNull())
    )
    positives = F.col("y_hit") + F.col("y") * (F.col("n_patients") - F.col("n_hit"))
    return df.groupBy("quadrant").agg(F.sum("n_patients").alias("n_pairs"), F.sum(positives).alias("n_pos"))


def dense_pairs(labels: PairScores, patients: DataFrame, trials: DataFrame) -> DataFrame:
    """Every pair of one quadrant with its label: the evaluation grid of a model that scores all pairs."""
    return complete_pairs(labels, patients, trials)


def take_first(pairs: DataFrame, n: Column | int, seed: int, ids: Sequence[str]) -> DataFrame:
    """``n`` rows chosen by seeded hash order, counted exactly without sorting all rows in one task."""
    return shuffled_position(pairs, ids, seed).where(F.col("pos") < n).drop("pos")


def subsample_negatives(pairs: DataFrame, seed: int, ids: Sequence[str] = ("patient_id", "trial_id"),
                        neg_per_pos: int = NEG_PER_POS, max_pairs: int = MAX_TRAIN_PAIRS,
                        min_negatives: int = MIN_NEGATIVES) -> DataFrame:
    """All positives with a bounded number of negatives, then an overall cap."""
    n_pos = pairs.agg(F.coalesce(F.sum("y"), F.lit(0))).scalar()
    target = F.greatest(F.lit(neg_per_pos) * F.greatest(n_pos, F.lit(1)), F.lit(min_negatives))
    negatives = take_first(pairs.where("y = 0").withColumn("_target", target), F.col("_target"), seed, ids).drop("_target")
    kept = pairs.where("y = 1").unionByName(negatives)
    return take_first(kept, max_pairs, seed + 1, ids)


def draw_negatives(labels: PairScores, patients: DataFrame, trials: DataFrame, n: int, seed: int) -> DataFrame:
    """(patient_id, trial_id, draw): ``n`` different pairs with label 0 of all pairs of the two tables, or all of these if there are fewer.

    Pairs are numbered by the places of their ids, and a keyed permutation of these numbers is the order of draws; the first n
    that turn out negative are taken. Only drawn pairs become rows: as many again as positives are met, counted once and then drawn in one go.
    """
    patients, trials = patients.select("patient_id").distinct(), trials.select("trial_id").distinct()
    n_patients, n_trials = patients.count(), trials.count()
    total = n_patients * n_trials
    by_patient = position(patients, ["patient_id"], range_bin(patients, "patient_id")).withColumnRenamed("pos", "_p")
    by_trial = position(trials, ["trial_id"], range_bin(trials, "trial_id")).withColumnRenamed("pos", "_t")
    y0 = labels.defaults.select("trial_id", F.col("y").alias("_y0"))
    asked = n
    while True:
        asked = min(total, asked + asked // 8 + 64)
        number = permuted(F.col("id"), total, seed) if total else F.lit(0)
        drawn = patients.sparkSession.range(asked).select(F.col("id").alias("draw"), number.alias("_pair")).select(
            "draw", F.floor(F.col("_pair") / max(1, n_trials)).alias("_p"), (F.col("_pair") % max(1, n_trials)).alias("_t"))
        drawn = drawn.join(by_patient, "_p").join(by_trial, "_t").join(y0, "trial_id").select("patient_id", "trial_id", "draw", "_y0")
        drawn = materialize(drawn)
        known = labels.known(drawn).select("patient_id", "trial_id", "y")
        negative = materialize(drawn.join(known, ["patient_id", "trial_id"], "left").where(F.coalesce("y", "_y0") == 0).select("patient_id", "trial_id", "draw"))
        found = negative.count()
        if found >= n or asked == total:
            break
        asked = max(asked, int(n * asked / max(1, found)))
    return position(negative, ["draw"], F.floor(F.col("draw") * 256 / max(1, asked))).where(F.col("pos") < n).drop("pos")


def sample_training_pairs(labels: PairScores, patients: DataFrame, trials: DataFrame, seed: int, neg_per_pos: int = NEG_PER_POS,
                          max_pairs: int = MAX_TRAIN_PAIRS, min_negatives: int = MIN_NEGATIVES) -> DataFrame:
    """``subsample_negatives`` over all pairs of the two tables, hit or not, without spelling them out: (patient_id, trial_id, y).

    All positives are rows: those with a hit, and the pairs of trials that take everybody by default. Negatives are drawn.
    """
    def few(positive: DataFrame, scores: PairScores) -> DataFrame:
        positive = materialize(positive.select("patient_id", "trial_id").withColumn("y", F.lit(1)))
        wanted = max(neg_per_pos * max(positive.count(), 1), min_negatives)
        negative = draw_negatives(scores, patients, trials, wanted, seed).select("patient_id", "trial_id", F.lit(0).alias("y"))
        return take_first(positive.unionByName(negative), max_pairs, seed + 1, ["patient_id", "trial_id"])

    if labels.blocks:
        # Positives are picked in the cells, drawn pairs looked up: no other pair is made.
        chosen = labels.defaults.join(trials.select("trial_id").distinct(), "trial_id", "left_semi")
        return few(positive_pairs(labels, patients, trials), PairScores(labels.source, chosen, given=labels.given))
    ours = PairScores(labels.pairs.join(patients.select("patient_id").distinct(), "patient_id", "left_semi").join(
        trials.select("trial_id").distinct(), "trial_id", "left_semi"), labels.defaults.join(trials.select("trial_id").distinct(), "trial_id", "left_semi"))
    by_default = ours.defaults.where("y = 1").select("trial_id")
    own = ours.pairs.join(by_default, "trial_id", "left_anti").where("y = 1").select("patient_id", "trial_id")
    rest = complete_pairs(ours, patients, condition="y = 1").where("y = 1").select("patient_id", "trial_id")
    return few(own.unionByName(rest), ours)


def stratified_cap(pairs: DataFrame, max_pairs: int, seed: int, ids: Sequence[str] = ("patient_id", "trial_id")) -> DataFrame:
    """At most ``max_pairs`` rows, at most half of them positive; the rest is filled with negatives."""
    n_pos = pairs.agg(F.coalesce(F.sum("y"), F.lit(0))).scalar()
    n_all = pairs.agg(F.count("*")).scalar()
    df = pairs.withColumn("_np", n_pos).withColumn("_n", n_all)
    keep_pos = F.when(F.col("_n") <= max_pairs, F.col("_np")).otherwise(F.least(F.col("_np"), F.lit(max_pairs // 2)))
    keep_neg = F.when(F.col("_n") <= max_pairs, F.col("_n")).otherwise(F.lit(max_pairs) - keep_pos)
    ranked = shuffled_position(df.withColumn("_keep", F.when(F.col("y") == 1, keep_pos).otherwise(keep_neg)), ids, seed, ["y"])
    return ranked.where(F.col("pos") < F.col("_keep")).drop("pos", "_keep", "_np", "_n")


def k_folds(trials: DataFrame, k: int, seed: int, key: str = "trial_id") -> DataFrame:
    """Every k-th trial of a seeded shuffle forms a fold; repeated ids count once."""
    return shuffled_position(trials.select(key).distinct(), [key], seed).select(key, (F.col("pos") % k).alias("fold"))


def prefix_split(trials: DataFrame, seq: str = "seq", fraction: float = 0.8, bins: Column | None = None) -> DataFrame:
    """First ``fraction`` of the rows in file order are train, the others eval.

    ``bins``: coarse, non-decreasing function of ``seq``; by default ranges of its values.
    """
    n = trials.agg(F.count("*")).scalar()
    ranked = position(trials, [seq], range_bin(trials, seq) if bins is None else bins).withColumn("_n", n)
    return ranked.withColumn("split", F.when(F.col("pos") < F.floor(F.col("_n") * fraction), "train").otherwise("eval")).drop("pos", "_n")


def ring_draws(rows: DataFrame, keys: Sequence[str], trials: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` different trials for each distinct row, or all trials if there are fewer: keys and trial_id.

    Trials stand on a ring in an order shuffled by the seed. Draws come from ``n`` arcs of the ring as even as the number of trials allows,
    one place in each by a seeded hash, all turned by a hash of the row: places cannot repeat, so none is drawn twice. Ids may be
    of any type.
    """
    indexed = shuffled_position(trials.select("trial_id").distinct(), ["trial_id"], seed).select("trial_id", F.col("pos").cast("bigint").alias("_pos"))
    n_trials = trials.agg(F.countDistinct("trial_id")).scalar()
    row = [F.col(k) for k in keys]
    low, high = (F.floor(F.col("_n") * k / F.col("_arcs")) for k in (F.col("_arc"), F.col("_arc") + 1))
    return (
        rows.select(*keys).distinct().withColumn("_n", n_trials).withColumn("_arcs", F.least(F.lit(n).cast("bigint"), F.col("_n")))
        .where("_arcs > 0").withColumn("_arc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_arcs") - 1)))
        .withColumn("_turn", F.floor(uniform(seed, *row, F.lit("turn")) * F.col("_n")))
        .withColumn("_pos", (low + F.floor(uniform(seed, *row, F.col("_arc")) * (high - low)) + F.col("_turn")) % F.col("_n"))
        .join(indexed, "_pos").select(*keys, "trial_id")
    )


def random_negative_trials(pairs: DataFrame, trials: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` different trials per pair, drawn from all trials other than its own; all others if there are fewer."""
    drawn = negative_trial_lists(pairs.select("patient_id", "trial_id").distinct(), trials, n, seed)
    return drawn.select("patient_id", "trial_id", F.explode("negatives").alias("negative_trial_id"))


def negative_trial_lists(pairs: DataFrame, trials: DataFrame, n: int, seed: int) -> DataFrame:
    """(patient_id, trial_id, negatives): the draws of ``ring_draws`` for each of the (different) pairs, made within its row.

    The ring of trials is one value of as many ids as there are trials; no draw is a row and none is joined or shuffled.
    """
    indexed = shuffled_position(trials.select("trial_id").distinct(), ["trial_id"], seed)
    ring = indexed.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "trial_id"))), lambda e: e["trial_id"])).scalar()
    own, row = F.col("trial_id"), [F.col("patient_id"), F.col("trial_id")]
    size, arcs = F.col("_n"), F.col("_arcs")
    # Spelled out arc by arc, as functions of array elements are not compiled.
    places = []
    for arc in range(n + 1):
        low, high = F.floor(size * arc / arcs), F.floor(size * (arc + 1) / arcs)
        place = (low + F.floor(uniform(seed, *row, F.lit(arc)) * (high - low)) + F.col("_turn")) % size
        places.append(F.when(arcs > arc, place))
    ids = [F.try_element_at(ring, (F.col(f"_place{a}") + 1).cast("int")) for a in range(n + 1)]
    drawn = [F.when(F.col(f"_id{a}") != own, F.struct(draw_key(seed, *row, F.col(f"_id{a}")).alias("key"), F.col(f"_id{a}").alias("trial_id"))) for a in range(n + 1)]
    return (
        pairs.select("patient_id", "trial_id", F.size(ring).cast("bigint").alias("_n"))
        .withColumn("_arcs", F.least(F.lit(n + 1).cast("bigint"), size)).where("_arcs > 0")
        .withColumn("_turn", F.floor(uniform(seed, *row, F.lit("turn")) * size))
        .withColumns({f"_place{a}": place for a, place in enumerate(places)})
        .withColumns({f"_id{a}": i for a, i in enumerate(ids)})
        .select("patient_id", "trial_id", F.slice(F.sort_array(F.array_compact(F.array(*drawn))), 1, n)["trial_id"].alias("negatives"))
    )


def edge_drop(edges: DataFrame, rate: float, seed: int, ids: Sequence[str] = ("relation", "src", "dst")) -> DataFrame:
    """Bernoulli edge drop: each edge stays with probability 1 - rate."""
    return edges.where(uniform(seed, *[F.col(i) for i in ids]) >= rate)


def random_scores(pairs: DataFrame, seed: int, ids: Sequence[str] = ("patient_id", "trial_id")) -> DataFrame:
    return pairs.withColumn("score", uniform(seed, *[F.col(i) for i in ids]))


def overlapping_ids(splits: DataFrame, key: str) -> DataFrame:
    """Ids found in more than one split; empty for a leak-free split."""
    return splits.groupBy(key).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def overlapping_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("patient_id", "trial_id").agg(F.countDistinct("quadrant").alias("n")).where("n > 1")


def split_health(sizes: DataFrame, min_positives: int = MIN_POSITIVES) -> DataFrame:
    """Warnings for evaluation quadrants with too few positives."""
    return sizes.where(F.col("quadrant").isin("val", "test") & (F.col("n_pos") < min_positives)).withColumn(
        "warning", F.when(F.col("n_pos") == 0, "no positives: metrics are undefined").otherwise("few positives: high variance"))
