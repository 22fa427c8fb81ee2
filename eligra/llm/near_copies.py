"""Near copies by the similarity of their word shingles: close SimHash fingerprints and equal minima find candidates, the whole sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from eligra.llm import simhash
from eligra.llm.common import attach, bitmap, bound_batches, components, hot_join, in_bitmap
from eligra.session import materialize

#: Minima of a set, and how many of them a bucket takes together: pairs of similarity 0.8 share none of the 32 buckets with probability 5e-8.
MINIMA, ROWS = 128, 4
#: Minima equal in their last two bits below which a pair is not compared: fewer come about with probability 1.4e-8 at similarity 0.8.
LEAST_EQUAL = 84
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
COVERED = 0.8
#: Members up to which the sets of a bucket that its hub does not connect are simply compared.
CROWD = 16
#: Members, and elements of their sets, of a part of a hub's members; two parts meet in a cell.
CELL_ROWS, CELL_ELEMENTS = 4096, 1 << 22
_RNG = np.random.default_rng(42)
_FLIP = _RNG.integers(0, 1 << 32, (MINIMA, 1), dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, (MINIMA, 1), dtype=np.uint32) | np.uint32(1)
#: Shingles whose minima are worked out at once: their table stays in a core's cache.
PIECE = 256


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of all word shingles (ASCII case folded); a shorter text is one shingle, an empty one has none."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n, digest = max(1, len(found) - words + 1), xxhash.xxh64_intdigest
    last = ends[words - 1:] if len(found) >= words else ends[-1:]
    return np.unique(np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts[:n].tolist(), last.tolist())), np.uint64, n))


def minima(found: np.ndarray) -> np.ndarray:
    """For each of 128 orders of all shingles, the first one of the set."""
    least, short = np.full(MINIMA, 0xFFFFFFFF, np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), PIECE):
        least = np.minimum(least, ((short[None, k:k + PIECE] ^ _FLIP) * _TIMES).min(axis=1))
    return least


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set of 64-bit values: the bits that over half of them have, as a signed number; of none: 0."""
    ones = np.zeros(simhash.BITS, np.int64)
    for k in range(0, len(found), simhash.PIECE):
        ones += np.unpackbits(found[k:k + simhash.PIECE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(found)).tobytes(), "big", signed=True)


def _last_bits(least: np.ndarray) -> bytes:
    """The last two bits of each, four to a byte."""
    two = (least & 3).astype(np.uint8).reshape(-1, 4)
    return (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


def equal_minima(a: bytes, b: bytes) -> int:
    """Minima of which the last two bits agree."""
    differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    return MINIMA - int(_ONES[(differ | differ >> 1) & 0x55].sum())


def similar_enough(a: np.ndarray, b: np.ndarray, similar: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similar * (len(a) + len(b) - both) - 1e-9


def sketch(text: Column, words: int) -> Column:
    """The set's hash, its size, its SimHash, and its minima, whole and the last two bits of each."""

    @F.pandas_udf("fp long, size int, sim long, low binary, last binary")
    def of(column: pd.Series) -> pd.DataFrame:
        rows = []
        for t in column:
            found = shingles(t, words)
            least = minima(found)
            rows.append((int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)), len(found), fingerprint(found), least.tobytes(), _last_bits(least)))
        return pd.DataFrame(rows, columns=["fp", "size", "sim", "low", "last"])

    return of(text)


@F.pandas_udf(BooleanType())
def _may_be_similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([equal_minima(x, y) >= LEAST_EQUAL for x, y in zip(a, b)], dtype=bool)


def _whole_sets(need: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The sets (text_hash, whole) of the texts that ``need`` (materialized text_hash) names; only their texts are shuffled."""
    spots = bitmap(need, "text_hash")

    @F.pandas_udf("boolean")
    def needed(text_hash: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(spots.value, text_hash.to_numpy(np.int64).view(np.uint64)))

    @F.pandas_udf("binary")
    def whole(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).tobytes() for t in text])

    # Copies of a text are one row of a task before they are shuffled.
    some = texts.where(needed("text_hash")).groupBy("text_hash").agg(F.first("text").alias("text")).join(need, "text_hash", "left_semi")
    return materialize(some.select("text_hash", whole("text").alias("whole")))


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select([F.col(c).alias(name if c == "fp" else f"{c}_{name}") for c in df.columns])


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar. Only texts of nodes with a likely pair are shuffled."""
    slim = nodes.select("fp", "size", "last", "text_hash")
    near = (attach(attach(pairs, "a", _named(slim, "a"), ["b"]), "b", _named(slim, "b"), ["a"])
            .where(F.least("size_a", "size_b") >= similar * F.greatest("size_a", "size_b") - 1e-9)
            .where(_may_be_similar("last_a", "last_b")))
    near = materialize(near.select("a", "b", "text_hash_a", "text_hash_b"))
    need = materialize(near.select(F.col("text_hash_a").alias("text_hash")).unionByName(near.select(F.col("text_hash_b").alias("text_hash"))).distinct())
    sets = _whole_sets(need, texts, words)

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar_enough(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similar) for x, y in zip(a, b)], dtype=bool)

    for side, other in (("a", "b"), ("b", "a")):
        near = attach(near, f"text_hash_{side}", sets.select(F.col("text_hash").alias(f"text_hash_{side}"), F.col("whole").alias(f"whole_{side}")), [other])
    return materialize(near.where(alike("whole_a", "whole_b")).select("a", "b"))


def apart(hub: np.ndarray, own: np.ndarray, near: bool, similar: float) -> tuple[np.ndarray, int]:
    """The elements by which ``own`` differs from its hub that it must be looked up by, and how many of them matter to others far from the hub.

    Let D(x) be the symmetric difference of x and the hub, and a = (1 - similar) / (1 + similar). Two sets are similar if their own
    difference, |D(x)| + |D(y)| - 2 |D(x) & D(y)|, is a (|x| + |y|) or less. If y is not similar to the hub, |D(y)| is over a (|y| + |hub|), so
    D(x) and D(y) share elements, t(x) = (|D(x)| + a (|hub| - |x|)) / 2 at least. In one common order of elements two sets that share t of them
    share one of the first |D| - t + 1 of either. That order has those first which the hub lacks: copies of one text seldom share them by chance.
    ``links`` does not use it: members that do share a change would meet in pairs.
    """
    novel, missing = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
    d, a = len(novel) + len(missing), (1 - similar) / (1 + similar)
    order = np.concatenate([novel, missing])
    if not d:
        return order, 0

    def first(t: float) -> int:
        return max(0, d - max(1, math.ceil(t - 1e-9)) + 1)

    far = (d + a * (len(hub) - len(own))) / 2  # the partner, or this set, is not similar to the hub
    if near:
        return order[:first(far)], 0
    any_partner = d - a * len(own) * (1 + 1 / similar)  # from the sizes of similar sets alone
    return order[:first(any_partner)], first(max(far, any_partner))


def _differing(last: np.ndarray, x: int) -> np.ndarray:
    """Of how many minima the last two bits differ from those of row ``x``; rows of four 64-bit numbers."""
    differ = last ^ last[x]
    return np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1)


def _likely(last: np.ndarray, size: np.ndarray, group: np.ndarray, x: int, partners: np.ndarray, similar: float) -> np.ndarray:
    """The ``partners`` of another group that may be similar to row ``x``."""
    small, large = np.minimum(size, size[x]), np.maximum(size, size[x])
    return np.flatnonzero(partners & (group != group[x]) & (small >= similar * large - 1e-9) & (MINIMA - _differing(last, x) >= LEAST_EQUAL))


class _Shared:
    """How many elements a set shares with others of a cell, by posting lists."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.n = sets, len(sets)
        order = np.argsort(np.concatenate(sets), kind="stable")
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.who = np.repeat(np.arange(self.n), [len(s) for s in sets])[order]
        self.ends = np.concatenate([[0], np.cumsum(counts)])
        self.elements = np.split(inverse, np.cumsum([len(s) for s in sets])[:-1])

    def counts(self, x: int, others: np.ndarray) -> np.ndarray:
        if len(others) <= 4:
            return np.array([len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True)) for y in others.tolist()])
        first, many = self.ends[self.elements[x]], np.diff(self.ends)[self.elements[x]]
        at = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        return np.bincount(self.who[at], minlength=self.n)[others]


def _cells(spokes: DataFrame, extent: DataFrame) -> DataFrame:
    """``spokes`` dealt to cells (hub, lo, hi) in which every two members of a hub meet; ``extent``: hub, parts."""
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    return (spokes.join(extent, "hub").withColumn("part", part)
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .withColumn("lo", F.least("part", "with")).withColumn("hi", F.greatest("part", "with")).drop("with", "parts"))


def _extent(spokes: DataFrame) -> DataFrame:
    members = F.ceil(F.count("*") / CELL_ROWS)
    elements = F.ceil(F.sum(F.col("size").cast("long")) / CELL_ELEMENTS)
    return materialize(spokes.groupBy("hub").agg(F.greatest(members, elements).cast("int").alias("parts")))


def _crowd_links(spokes: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """Similar pairs (a, b) that connect all similar members of a hub; spokes: hub, fp, root. Members of one root are connected.

    Members meet in cells of bounded size, first by their minima; those that may be similar to one of another root then bring their
    whole sets. A cell gives a link only where it connects two groups, so rows stay in proportion to members; comparisons do not.
    """
    slim = nodes.select("fp", "size", "last", "text_hash")
    members = materialize(attach(spokes, "fp", slim, ["hub"]))

    def partners(pdf: pd.DataFrame, x: int) -> np.ndarray:
        part = pdf["part"].to_numpy()
        there = part != part[x] if pdf["lo"].iloc[0] != pdf["hi"].iloc[0] else np.ones(len(part), bool)
        there[:x] = False
        return there

    def sketches(pdf: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(pdf["last"]), np.uint64).reshape(len(pdf), -1)

    def promising(pdf: pd.DataFrame) -> pd.DataFrame:
        last, size, group, hit = sketches(pdf), pdf["size"].to_numpy(), pdf["root"].to_numpy(), np.zeros(len(pdf), bool)
        for x in range(len(pdf)):
            found = _likely(last, size, group, x, partners(pdf, x), similar)
            hit[found] = True
            hit[x] |= len(found) > 0
        return pdf.loc[hit, ["hub", "fp"]]

    def connected(pdf: pd.DataFrame) -> pd.DataFrame:
        last, size, group, out = sketches(pdf), pdf["size"].to_numpy(), pdf["root"].to_numpy().copy(), []
        fp, shared = pdf["fp"].to_numpy(), _Shared([np.frombuffer(w, np.uint64) for w in pdf["whole"]])
        for x in range(len(pdf)):
            near = _likely(last, size, group, x, partners(pdf, x), similar)
            if len(near):
                both = shared.counts(x, near)
                for y in near[both >= similar * (size[x] + size[near] - both) - 1e-9].tolist():
                    if group[x] != group[y]:
                        out.append((min(fp[x], fp[y]), max(fp[x], fp[y])))
                        group[group == group[y]] = group[x]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    keys, columns = ["hub", "lo", "hi"], ["part", "fp", "root", "size", "last"]
    cells = _cells(members, _extent(members)).select(*keys, *columns)
    chosen = materialize(cells.groupBy(*keys).applyInPandas(promising, "hub bigint, fp bigint").distinct())
    members = materialize(members.join(chosen, ["hub", "fp"], "left_semi"))
    sets = _whole_sets(materialize(members.select("text_hash").distinct()), texts, words)
    whole = attach(members, "text_hash", sets, ["hub"])
    cells = _cells(whole, _extent(members)).select(*keys, *columns, "whole")
    return materialize(cells.groupBy(*keys).applyInPandas(connected, "a bigint, b bigint").distinct())


def chained(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs (a, b) of sets with close fingerprints: the least set of each, joined by ``simhash.links``, and the others of a fingerprint with it."""
    prints = materialize(nodes.where("size > 0").groupBy("sim").agg(F.min("fp").alias("least"), F.count("*").alias("n")))
    same = hot_join(nodes.where("size > 0").select("fp", "sim"), prints.where("n > 1"), ["sim"], "n", ["fp"]).where("fp <> least")
    near = materialize(simhash.links(prints.select(F.col("sim").alias("fp")), distance))
    for side, other in (("a", "b"), ("b", "a")):
        near = attach(near, side, prints.select(F.col("sim").alias(side), F.col("least").alias(f"least_{side}")), [other])
    return same.select(F.col("least").alias("a"), F.col("fp").alias("b")).unionByName(near.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))


def links(nodes: DataFrame, texts: DataFrame, words: int = 5, similar: float = 0.8) -> DataFrame:
    """Pairs (a, b) of sets that connect all those whose Jaccard similarity is ``similar`` or more, and no others.

    Fingerprints at 4 or fewer of 64 bits, found by chains of ring segments (``simhash.links``), give the first candidates. Sets just above the
    similarity often lie further apart, so sets that share four minima meet in a bucket as well. There each is first compared with the hub of its bucket, the member that shares most buckets
    with others and so stands amid its copies. In buckets whose members are not all connected by that, those of different
    components are compared with each other: as pairs if there are ``CROWD`` members or fewer, else in cells that give only the links which
    connect two components (``_crowd_links``). So a crowd around one text gives rows in proportion to its members.
    """
    if similar < COVERED:
        raise ValueError(f"buckets are made for a similarity of {COVERED} or more")
    many = MINIMA // ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(low, {4 * ROWS * i + 1}, {4 * ROWS})")) for i in range(many)])
    banded = nodes.where("size > 0").select("fp", F.explode(keys).alias("key"))
    shared = materialize(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    held = materialize(hot_join(banded, shared, ["key"], "n", ["fp"]))
    weight = held.groupBy("fp").agg(F.sum("n").alias("weight"))
    hubs = held.join(weight, "fp").groupBy("key").agg(F.max(F.struct("weight", "fp"))["fp"].alias("hub"))
    placed = materialize(hot_join(held, hubs, ["key"], "n", ["fp"], counts=shared))
    stars = materialize(placed.where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct())
    first = _verified(materialize(stars.unionByName(chained(nodes)).distinct()), nodes, texts, words, similar)

    roots = components(first).withColumnRenamed("node", "fp")
    rooted = materialize(placed.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    mixed = materialize(rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("_n")).where("lo < hi").select("key", "_n"))
    left = materialize(hot_join(rooted, mixed, ["key"], "_n", ["fp"], how="left_semi"))
    few = left.where((F.col("n") <= CROWD) & (F.col("fp") != F.col("hub"))).select("key", "fp", "root")
    rest = (few.join(few.select("key", F.col("fp").alias("other"), F.col("root").alias("other_root")), "key").where("fp < other and root <> other_root")
            .select(F.col("fp").alias("a"), F.col("other").alias("b")))
    linked = first.unionByName(_verified(materialize(rest.distinct()), nodes, texts, words, similar))
    spokes = materialize(left.where((F.col("n") > CROWD) & (F.col("fp") != F.col("hub"))).select("hub", "fp", "root").distinct())
    return linked if spokes.isEmpty() else linked.unionByName(_crowd_links(spokes, nodes, texts, words, similar))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similar: float = 0.8) -> DataFrame:
    """The row with the smallest id of each component of texts whose shingle sets are ``similar``, with all columns of ``docs``.

    Equal sets are one node. Texts without words are one component. Ids and repeated rows are treated as in ``simhash.keep_one``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = bound_batches(docs).select(F.col(id_col).alias("doc_id"), docs[text_col].alias("text"))
    rows = materialize(slim.select("doc_id", F.xxhash64(text).alias("text_hash"), sketch(text, words).alias("s")).select("doc_id", "text_hash", "s.*"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    nodes = materialize(rows.groupBy("fp").agg(best, *[F.min(c).alias(c) for c in ("size", "sim", "low", "last")]).withColumn("text_hash", F.col("best.text_hash")))
    edges = links(nodes, slim.select(F.xxhash64(text).alias("text_hash"), text.alias("text")), words, similar)
    return simhash.least_rows(docs, rows, nodes.select("fp", "best"), edges, id_col, text_col)
