"""Nearest neighbours by inverted lists whose candidates are dropped after a few blocks of rotated dimensions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eligra.session import materialize

#: Dimensions between two tests.
STEP = 16
#: Rows, and queries, that meet in one cell; pairs that are looked at together in it.
LIST_ROWS, LIST_QUERIES, PAIRS = 8_192, 4_096, 1 << 20
#: Pairs of which fewer than this share is left go on one by one, others as a matrix.
SPARSE = 0.03
#: A round looks through at most so many times the rows that were looked through before it.
GROWTH = 16


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same for a dimension at every run."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def lift(x: np.ndarray, bound: float, seed: int = 5) -> np.ndarray:
    """Vectors with one more component that gives all the norm ``bound``, rotated: the nearest of these is the largest inner product."""
    more = np.sqrt(np.maximum(bound * bound - (x * x).sum(1), 0.0))
    return np.concatenate([x, more[:, None]], 1) @ rotation(x.shape[1] + 1, seed)


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k-means of a bounded sample; an empty list takes a sampled vector."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(sample, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], sample[rng.integers(len(sample), size=len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` nearest rows of ``c`` for each of ``x``, nearest first."""
    out = []
    for low in range(0, len(x), 4096):
        d = (c * c).sum(1) - 2 * x[low:low + 4096] @ c.T
        out.append(np.argsort(d, 1, kind="stable")[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), int)


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last: equal vectors get equal sums."""
    out = np.zeros(len(x))
    for j in range(len(q)):
        out += x[:, j] * q[j]
    return out


def foremost(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best (largest score, then smallest id) of each query, by query."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def search(ids: np.ndarray, x: np.ndarray, lifted: np.ndarray, qids: np.ndarray, q: np.ndarray, ql: np.ndarray, best: np.ndarray, k: int,
           slack: float, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``k`` (query, row, score) of each query among the rows of a list. ``best``: for each query a distance that ``k`` candidates keep
    within, or infinity; it is lowered by what is found. A candidate is dropped as soon as its distance over the first d of D dimensions,
    scaled to all, is above that by more than ``slack`` / sqrt(d) allows: the rotation makes that share a fair sample.
    """
    dim, at_q, at_r = lifted.shape[1], None, None
    more = 1e-12 * ((ql * ql).sum(1) + bound * bound)  # rounding of sums and products
    far = np.where(ids[None, :] == qids[:, None], np.inf, 0.0)
    for d in range(0, dim, STEP):
        a, b, seen = ql[:, d:d + STEP], lifted[:, d:d + STEP], min(d + STEP, dim)
        if at_q is not None:
            diff = b[at_r] - a[at_q]
            far = far + (diff * diff).sum(1)
        else:
            far += a @ (-2 * b.T)
            far += (a * a).sum(1)[:, None]
            far += (b * b).sum(1)
            if seen == dim and len(ids) > k and np.isinf(best).any():
                open_ = np.flatnonzero(np.isinf(best))
                best[open_] = np.partition(far[open_], k - 1, axis=1)[:, k - 1]
        limit = (best * (seen / dim) * (1 + slack / np.sqrt(seen)) ** 2 if seen < dim else best * (1 + 1e-9)) + more
        if at_q is not None:
            keep = far <= limit[at_q]
            at_q, at_r, far = at_q[keep], at_r[keep], far[keep]
            continue
        alive = (far <= limit[:, None]) & (far < np.inf)
        if seen == dim or alive.mean() < SPARSE:
            at_q, at_r = np.nonzero(alive)
            far = far[at_q, at_r]
    score = np.zeros(len(at_q))
    for j in range(x.shape[1]):  # as in ``inner``
        score += x[at_r, j] * q[at_q, j]
    top_k = foremost(at_q, ids[at_r], score, k)
    at_q, at_r, score, far = at_q[top_k], at_r[top_k], score[top_k], far[top_k]
    count, worst = np.bincount(at_q, minlength=len(best)), np.zeros(len(best))
    np.maximum.at(worst, at_q, far)
    full = count == k
    best[full] = np.minimum(best[full], worst[full])
    return at_q, at_r, score


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, dim))


def top(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, probe: float = 0.8,
        per_list: int = 500, most_lists: int = 2048, sample: int = 20_000, slack: float = 2.1) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query, ties to the smaller id.

    Queries are the rows whose id is a multiple of ``every``, candidates all others. Centroids are fitted on at most ``sample``
    vectors (the lowest hashes of the id), one for ``per_list`` rows and ``most_lists`` at most, so that they can be sent to every
    task; every row is put in its list. The sampled vectors are a list of their own that every query looks through first: it gives ``k``
    neighbours, and a distance beyond which no candidate counts any more. Of the other lists a query probes the share ``probe``, nearest first.
    Lists and queries meet in cells of bounded size, in which candidates leave early and of which only those come back that beat
    the query's k-th best so far. Where the sample is a small part of all rows, the lists take turns, each of at most ``GROWTH`` times the rows seen
    before, so that a query gets some ``GROWTH`` times ``k`` rows back a turn at most, however many cells there are. Time still grows with queries times rows. Scores are those of
    the original vectors.

    Vectors that are null, zero, of another length than the most frequent (then the smaller) one, or that hold a null or a
    component that is not finite, take no part, nor do null ids; of rows with one id the smallest vector counts. With ``k`` candidates or
    fewer all are returned. Other columns are not read. An empty table gives no rows.
    """
    v = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    good = v.where("vec_id is not null and v is not null and size(v) > 0").where(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    sizes = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    out = "query_id bigint, vec_id bigint, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = sizes.dim
    good = good.where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    good = materialize(good)
    stats = good.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("norm")).first()
    lists = max(1, min(most_lists, stats.n // per_list))
    probes = max(1, round(lists * probe))
    drawn = sorted((r.vec_id, r.v) for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample, max(64 * lists, 4 * k))).collect())
    bound = float(np.sqrt(stats.norm)) * (1 + 1e-12)
    first_ids, first = np.array([i for i, _ in drawn], np.int64), np.array([v for _, v in drawn])
    centre = centroids(lift(first, bound), lists)

    def turned(q: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.zeros((len(q), 1))], 1) @ rotation(dim + 1)

    def placed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf[~np.isin(pdf["vec_id"].to_numpy(np.int64), first_ids)]
            if len(pdf):
                near = nearest(lift(_matrix(pdf["v"], dim), bound), centre, 1)[:, 0]
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "list": near.astype("int32"), "v": pdf["v"]})

    def probed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lifted, chunk = lift(first, bound), max(1, PAIRS // len(first))
        for whole in parts:
            for low in range(0, len(whole), chunk):
                pdf = whole.iloc[low:low + chunk]
                q, qids = _matrix(pdf["v"], dim), pdf["vec_id"].to_numpy(np.int64)
                ql = turned(q)
                asks = np.zeros((len(q), lists), bool)
                np.put_along_axis(asks, nearest(ql, centre, probes), True, 1)
                at, row, score = search(first_ids, first, lifted, qids, q, ql, np.full(len(q), np.inf), k, slack, bound)
                ends = np.cumsum(np.bincount(at, minlength=len(q)))[:-1]
                yield pd.DataFrame({"query_id": qids, "q": pdf["v"].to_numpy(), "asks": [a.tobytes() for a in np.packbits(asks, axis=1)],
                                    "ids": np.split(first_ids[row], ends), "scores": np.split(score, ends)})

    rows = materialize(good.mapInPandas(placed, "vec_id bigint, list int, v array<double>"))
    asked = materialize(good.where(F.col("vec_id") % every == 0).mapInPandas(
        probed, "query_id bigint, q array<double>, asks binary, ids array<bigint>, scores array<double>"))
    found = asked.select("query_id", F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))))
    # Cells: lists are put together in bins, a bin of many rows is cut by hash of the id, and so are the queries.
    bins = max(1, min(lists, math.ceil((stats.n - len(drawn)) / LIST_ROWS)))
    query_parts = max(1, math.ceil(asked.count() / LIST_QUERIES))
    rows = rows.withColumn("bin", F.pmod("list", F.lit(bins)).cast("int"))
    per = materialize(rows.groupBy("bin").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("row_parts"), F.count("*").alias("n")))

    def block(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        out_q, out_id, out_score = [none], [none], [np.zeros(0)]
        if len(have) and len(want):
            have = have.sort_values(["list", "vec_id"])
            ids, x, lists_of = have["vec_id"].to_numpy(np.int64), _matrix(have["v"], dim), have["list"].to_numpy()
            lifted, q, qids = lift(x, bound), _matrix(want["q"], dim), want["query_id"].to_numpy(np.int64)
            ql, asks = turned(q), np.unpackbits(np.frombuffer(b"".join(want["asks"]), np.uint8).reshape(len(q), -1), axis=1)
            least = want["least"].to_numpy(np.float64)
            best = np.where(np.isnan(least), np.inf, (ql * ql).sum(1) + bound * bound - 2 * least)
            best = np.maximum(best, 0.0)
            cut = [0, *(np.flatnonzero(lists_of[1:] != lists_of[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(cut, cut[1:]):
                asking = np.flatnonzero(asks[:, lists_of[lo]])
                for part in np.array_split(asking, math.ceil(len(asking) * (hi - lo) / PAIRS)) if len(asking) else []:
                    now = best[part]
                    at, row, score = search(ids[lo:hi], x[lo:hi], lifted[lo:hi], qids[part], q[part], ql[part], now, k, slack, bound)
                    best[part] = now
                    out_q.append(part[at]), out_id.append(ids[lo:hi][row]), out_score.append(score)
        got_q, got_id, got = np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_score)
        keep = foremost(got_q, got_id, got, k)
        return pd.DataFrame({"query_id": qids[got_q[keep]] if len(keep) else none, "vec_id": got_id[keep], "score": got[keep]})

    keys, order = ["bin", "row_part", "query_part"], Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    sizes = sorted((r.bin, r.n) for r in per.collect())  # a bin holds a list at least: 2,048 of them at most
    seen, low = len(drawn), 0
    while low < len(sizes):
        high, more = low, 0
        while high < len(sizes) and (high == low or more + sizes[high][1] <= GROWTH * seen):
            more, high = more + sizes[high][1], high + 1
        turn = per.where(F.col("bin").between(sizes[low][0], sizes[high - 1][0])).drop("n")
        left = (rows.join(F.broadcast(turn), "bin").withColumn("row_part", F.pmod(F.xxhash64("vec_id"), F.col("row_parts")).cast("int"))
                .withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))).select(*keys, "vec_id", "list", "v"))
        least = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
        right = (asked.join(least, "query_id", "left").withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int"))
                 .crossJoin(F.broadcast(turn)).withColumn("row_part", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)))
                 .select(*keys, "query_id", "q", "asks", "least"))
        came = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, out)
        found = (found.unionByName(came).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "score"))
        seen, low = seen + more, high
        if low < len(sizes):
            found = materialize(found)
    return found.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "score")
