"""Repeated word windows found by anchors at the places of a difference cover.

The places of a text are numbered by word. A window is hashed only where its place modulo ``PERIOD`` lies in ``COVER``, whose differences
give every remainder. Of two equal windows of ``LENGTH`` words at places i and j, some shift below ``PERIOD`` therefore takes both to
places of the cover, and the ``CORE`` words there are equal. Around such an anchor the match is extended to both sides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligra.llm.common import bitmap, bound_batches, hot_join, in_bitmap, written
from eligra.session import materialize

LENGTH = 50
#: A perfect difference set, 6 * 5 differences for the 30 remainders of 31.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
#: Words of an anchor, and of the shorter of its two arms in a window.
CORE, ARM = LENGTH - PERIOD + 1, (PERIOD - 1) // 2
_IS_COVER = np.isin(np.arange(PERIOD), COVER)


class Words:
    """The words of a text, joined by one space, with the place of each."""

    def __init__(self, body: bytes):
        found = body.split()  # only the six ASCII spaces split bytes
        self.joined, self.n = b" ".join(found), len(found)
        sizes = np.fromiter(map(len, found), np.int64, self.n)
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes

    def anchors(self) -> np.ndarray:
        places = np.arange(max(0, self.n - CORE + 1)) if self.n >= LENGTH else np.empty(0, np.int64)
        return places[_IS_COVER[places % PERIOD]]

    def slices(self, first: np.ndarray, last: np.ndarray) -> Iterator[bytes]:
        """The words ``first`` to ``last`` (exclusive) of each pair, none of them empty."""
        joined = self.joined
        return (joined[a:b] for a, b in zip(self.start[first].tolist(), self.end[last - 1].tolist()))


def _cores(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_64_intdigest
    for pdf in parts:
        hashes, counts = [], []
        for body in pdf["body"]:
            words = Words(body)
            at = words.anchors()
            hashes += map(digest, words.slices(at, at + CORE))
            counts.append(len(at))
        yield pd.DataFrame({"core": np.array(hashes, np.uint64).view(np.int64), "doc_id": pdf["doc_id"].repeat(counts).to_numpy()})


def _contexts(repeated):
    """Anchors whose core may be in several documents: the hashes of all words that their windows reach, and of core with either arm."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        core_of, digest = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for pdf in parts:
            out = []
            for doc_id, k1, k2, body in zip(pdf["doc_id"], pdf["k1"], pdf["k2"], pdf["body"]):
                words = Words(body)
                at = words.anchors()
                if not len(at):
                    continue
                at = at[in_bitmap(repeated.value, np.fromiter(map(core_of, words.slices(at, at + CORE)), np.uint64, len(at)))]
                if not len(at):
                    continue
                low, high = np.maximum(at - PERIOD + 1, 0), np.minimum(at + LENGTH, words.n)
                reach = [digest(s, left) for s, left in zip(words.slices(low, high), (at - low).tolist())]
                arms = {"left": (np.maximum(at - ARM, 0), at + CORE, at < ARM), "right": (at, np.minimum(at + CORE + ARM, words.n), at + CORE + ARM > words.n)}
                out.append(pd.DataFrame({
                    "doc_id": doc_id, "k1": k1, "k2": k2, "at": at.astype(np.int32), "reach": reach, "high": high.astype(np.int32),
                    **{name: pd.arrays.IntegerArray(np.fromiter(map(core_of, words.slices(a, b)), np.uint64, len(at)).view(np.int64), cut)
                       for name, (a, b, cut) in arms.items()}}))
            if out:
                yield pd.concat(out)

    return run


def _windows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each window of a text that an extended anchor may match, once, with its hash."""
    digest = xxhash.xxh3_128_digest
    for pdf in parts:
        for doc_id, k1, k2, body, wanted in zip(pdf["doc_id"], pdf["k1"], pdf["k2"], pdf["body"], pdf["wanted"]):
            words = Words(body)
            mark = np.zeros(words.n + 1, np.int32)
            for w in wanted:
                first = max(0, w["at"] - (PERIOD - 1 if w["is_left"] else ARM))
                last = min(words.n - LENGTH, w["at"] - (ARM if w["is_left"] else 0))
                if first <= last:
                    mark[first] += 1
                    mark[last + 1] -= 1
            at = np.flatnonzero(np.cumsum(mark) > 0)
            yield pd.DataFrame({"doc_id": doc_id, "k1": k1, "k2": k2, "at": at.astype(np.int32),
                                "window": [digest(s) for s in words.slices(at, at + LENGTH)]})


def _keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is left of each text without the words of its spans."""
    for pdf in parts:
        out = []
        for k1, k2, body, spans in zip(pdf["k1"], pdf["k2"], pdf["body"], pdf["spans"]):
            words = Words(body)
            mark = np.zeros(words.n + 1, np.int32)
            for s in spans:
                mark[s["low"]] += 1
                mark[s["high"]] -= 1
            keep = np.flatnonzero(np.cumsum(mark[:words.n]) == 0)
            digest = hashlib.sha256(b" ".join(words.slices(keep, keep + 1)))
            out.append((k1, k2, words.n - len(keep), digest.hexdigest()))
        yield pd.DataFrame(out, columns=["k1", "k2", "n_removed", "kept"])


def _with_bodies(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The text of each (k1, k2) of ``wanted``, with its columns; a bitmap keeps most other texts from the shuffle."""
    keys = bitmap(wanted, "k1")

    @F.pandas_udf("boolean")
    def may(k: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(keys.value, k.to_numpy(np.int64).view(np.uint64)))

    return rows.where(may("k1")).select("k1", "k2", "body").join(wanted, ["k1", "k2"])


def _single_texts(rows: DataFrame) -> DataFrame:
    """One row (doc_id, k1, k2, body) for each text that a row with an id has, under its smallest id. Only repeated texts are shuffled."""
    again = materialize(rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").select("k1"))
    keys = bitmap(again, "k1")

    @F.pandas_udf("boolean")
    def may(k: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(keys.value, k.to_numpy(np.int64).view(np.uint64)))

    first = rows.where(may("k1")).groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.first("body").alias("body"))
    return rows.where(~may("k1")).unionByName(materialize(first.select(*rows.columns)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Every word is removed that a window of 50 words covers whose words also stand in a row with a smaller id. Null and empty texts have no
    words; texts of fewer than 50 words lose none. A null id is smaller than none and larger than none: such rows keep all words and
    take none from others. Rows of one id do not take words from each other; repeated rows repeat their result. Other columns are not
    read. An empty table gives no rows.

    Equal texts are worked out once, under their smallest id; under a larger id the match spans the whole text. Steps: (1) core
    hashes at the cover's places, and those in several documents as a bitmap; (2) anchors with such a core, each with the hash of all
    words that windows around it reach: where a smaller id has the same, all its windows are repeated, and the smallest id stands for the
    rest; (3) a window reaches 15 words beyond its anchor to one side or the other, so anchors whose core with that arm stands in one
    document only are dropped; (4) the windows of the others are looked up by their own hash. No step pairs the members of a group: each keeps its least id.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = bound_batches(docs).select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.cast("binary").alias("body"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    long = _single_texts(rows.where("doc_id is not null").where(F.octet_length("body") >= 2 * LENGTH - 1))

    span = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")]
    cores = long.mapInPandas(_cores, f"core bigint, doc_id {id_type}").groupBy("core").agg(*span[:2]).where("least < most").select("core")
    found = written(long.mapInPandas(_contexts(bitmap(materialize(cores), "core")),
                                         f"doc_id {id_type}, k1 bigint, k2 bigint, at int, high int, reach binary, left bigint, right bigint"))

    reaches = materialize(found.groupBy("reach").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    judged = hot_join(found, reaches, ["reach"], "n", ["k1", "at"])
    # A covered anchor needs its arms no more.
    is_open = F.col("doc_id") == F.col("least")
    judged = written(judged.select("doc_id", "k1", "k2", "at", F.when(~is_open, F.col("high")).alias("high"),
                                       F.when(is_open, F.col("left")).alias("left"), F.when(is_open, F.col("right")).alias("right")))
    covered = judged.where("high is not null").select("k1", "k2", F.greatest(F.col("at") - PERIOD + 1, F.lit(0)).alias("low"), "high")
    open_ends = judged.where("high is null")
    arms = written(open_ends.select("doc_id", "k1", "k2", "at", F.explode(F.filter(F.array(
        F.struct(F.lit(True).alias("is_left"), F.col("left").alias("arm")),
        F.struct(F.lit(False).alias("is_left"), F.col("right").alias("arm"))), lambda x: x["arm"].isNotNull())).alias("x"))
        .select("doc_id", "k1", "k2", "at", "x.*"))
    shared = materialize(arms.groupBy("is_left", "arm").agg(*span).where("least < most"))
    place = F.struct("at", "is_left")
    wanted = materialize(hot_join(arms, shared, ["is_left", "arm"], "n", ["k1", "at"])
                         .groupBy("doc_id", "k1", "k2").agg(F.collect_set(place).alias("wanted")))
    windows = written(_with_bodies(long, wanted).select("doc_id", "k1", "k2", "body", "wanted")
                          .mapInPandas(_windows, f"doc_id {id_type}, k1 bigint, k2 bigint, at int, window binary"))
    repeated = materialize(windows.groupBy("window").agg(*span).where("least < most"))
    matched = hot_join(windows, repeated, ["window"], "n", ["k1", "at"]).where("doc_id > least").select(
        "k1", "k2", F.col("at").alias("low"), (F.col("at") + LENGTH).alias("high"))
    spans = materialize(covered.unionByName(matched).groupBy("k1", "k2").agg(F.collect_set(F.struct("low", "high")).alias("spans")))
    kept = materialize(_with_bodies(long, spans).select("k1", "k2", "body", "spans").mapInPandas(_keep, "k1 bigint, k2 bigint, n_removed bigint, kept string"))

    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    slim = materialize(docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"),
                                   F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"), F.sha2(plain, 256).alias("sha")))
    # The smallest id of each text that has copies or lost words, and what it kept.
    firsts = slim.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    fates = materialize(firsts.join(kept, ["k1", "k2"], "left").where("n > 1 or kept is not null"))
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_words") >= LENGTH)
    first = F.col("doc_id") == F.col("least")
    return hot_join(slim, fates, ["k1", "k2"], "n", ["doc_id"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(first, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).when(first, F.coalesce("kept", "sha")).otherwise(F.col("sha")).alias("kept_sha256"))
