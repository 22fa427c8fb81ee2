"""Importance resampling towards a target: array-scored weights, exact ranks by regular sampling."""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eligra.llm.common import bound_batches
from eligra.session import materialize

#: Sorted runs and segments at most; the driver sorts the square of their number of sample keys.
MOST_RUNS = 1000
#: Bytes of words stand for themselves, A-Z for a-z, all others for a space. Bytes of other characters than ASCII belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(body: bytes, run: int = 1) -> list[bytes]:
    """All runs of 1 to ``run`` consecutive words, joined by one space."""
    words = body.translate(_FOLD).split()
    out = list(words)
    for n in range(2, run + 1):
        out += [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return out


def buckets_of(body: bytes, run: int, buckets: int) -> np.ndarray:
    found = features(body, run)
    return (np.fromiter(map(zlib.crc32, found), np.uint32, len(found)) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str, run: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows, as one array: a partial array a task, nonzero entries summed by bucket."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for pdf in parts:
            for body in pdf["body"]:
                total += np.bincount(buckets_of(body, run, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    body = F.coalesce(texts[text_col].cast("string"), F.lit("")).cast("binary")
    sums = bound_batches(texts).select(body.alias("body")).where(F.octet_length("body") > 0).mapInPandas(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in sums.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r.bucket] = r.n
    return out


def gains(here: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(share in the target / share here)) of each bucket, one added to every count."""
    buckets, s_all, t_all = len(here), float(here.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
                     for s, t in zip(here.tolist(), target.tolist())], np.int64)


def noise(key: str) -> int:
    """floor of 1,000 times a Gumbel variate that the key's sha256 fixes."""
    h = int(hashlib.sha256(key.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", run: int = 1,
          buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_features, weight, score; the weight is the mean gain of a row's features.

    The bucket arrays of ``docs`` and ``target`` are all that is collected or sent to tasks: their size is ``buckets``.
    """
    table = docs.sparkSession.sparkContext.broadcast(
        gains(bucket_counts(docs, text_col, run, buckets), bucket_counts(target, target_text, run, buckets)))

    @F.pandas_udf("n_features long, n_words long, weight long, score long")
    def scored(ids: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        out = []
        for key, body in zip(ids, bodies):
            found, words = buckets_of(body, run, buckets), len(body.translate(_FOLD).split()) if run > 1 else None
            weight = int(table.value[found].sum()) // len(found) if len(found) else 0
            out.append((len(found), len(found) if words is None else words, weight, weight + noise(f"{seed}:{key}")))
        return pd.DataFrame(out, columns=["n_features", "n_words", "weight", "score"])

    body = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    return bound_batches(docs).select(docs[id_col].alias("doc_id"), scored(F.coalesce(docs[id_col].cast("string"), F.lit("")), body).alias("s")).select("doc_id", "s.*")


def ranked(rows: DataFrame, by: str, tie: str) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3, ... by ``by`` (long, never null) falling, then ``tie`` rising, nulls last, without a single sorting task.

    Parallel sorting by regular sampling. Every run is sorted where it lies and gives keys at even distances; the sorted sample
    gives splitters, between which lie at most twice as many rows as a run holds. Rows go to their segment, whose sorted pieces
    are merged by Spark's sort, which spills; row numbers there plus the counts of the segments before are the ranks.
    Rows equal in both keys are told apart by their place in the written table, so a crowd of them is split like any other rows.
    """
    spark = rows.sparkSession
    runs = min(MOST_RUNS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    held = held.coalesce(min(runs, max(1, held.rdd.getNumPartitions())))
    order = [F.desc(by), F.asc_nulls_last(tie), F.asc("_row")]
    local = materialize(held.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    # The upper bits of the place are the run, the lower 33 count its rows.
    run, at = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.run: r.n for r in local.groupBy(run.alias("run")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    segments = max(1, len(sizes))
    steps = spark.createDataFrame([(r, max(1, n // segments)) for r, n in sizes.items()], "run long, step long")
    sample = (local.withColumn("run", run).join(F.broadcast(steps), "run").where(at % F.col("step") == 0)
              .select(by, F.col(tie).isNull().alias("none"), tie, "_row").collect())
    keys = sorted((-r[by], r.none, r[tie] if not r.none else 0, r["_row"]) for r in sample)
    splitters = spark.sparkContext.broadcast(keys[len(keys) // segments::max(1, len(keys) // segments)])

    @F.pandas_udf("int")
    def segment(value: pd.Series, none: pd.Series, key: pd.Series, row: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(splitters.value, (-v, n, k if not n else 0, r)) for v, n, k, r in zip(value, none, key, row)], dtype="int32")

    plain = F.coalesce(tie, F.lit(0)) if dict(local.dtypes)[tie] in ("bigint", "int", "smallint", "tinyint") else F.col(tie)
    dealt = materialize(local.withColumn("_segment", segment(F.col(by), F.col(tie).isNull(), plain, F.col("_row")))
                        .withColumn("_n", F.row_number().over(Window.partitionBy("_segment").orderBy(*order)).cast("long")))
    before, offsets = 0, []
    for r in dealt.groupBy("_segment").agg(F.count("*").alias("n")).orderBy("_segment").collect():
        offsets.append((r["_segment"], before))
        before += r.n
    starts = spark.createDataFrame(offsets, "_segment int, _before long")
    return dealt.join(F.broadcast(starts), "_segment").select(*rows.columns, (F.col("_n") + F.col("_before")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", run: int = 1,
             buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_features, weight, score, rank.

    Of the rows with ``least_words`` words or more, the ``percent`` (rounded down) of the highest scores have a rank from 1, by falling
    score, ties by the smaller id, null ids last; all others have a null rank. Rows equal in id and score follow each other in any
    order. A null id is hashed as an empty one. Null and empty texts have no features and weight 0. Other columns are not
    read. An empty table gives no rows; an empty target leaves a uniform share to each bucket.
    """
    rows = materialize(score(docs, target, id_col, text_col, target_text, run, buckets, seed))
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    out = ["doc_id", "n_features", "weight", "score"]
    return (ranked(able, "score", "doc_id").select(*out, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
            .unionByName(rows.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank"))))
