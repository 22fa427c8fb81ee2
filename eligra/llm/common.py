"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligra.session import materialize, shared_folder, tidy

#: A word is a maximal run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted`` names, lengthened until ``df`` has no column of that name in either case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of an Arrow batch of whole texts.
TEXTS_PER_BATCH = 500


def bound_batches(df: DataFrame) -> DataFrame:
    """``df``, after the session's Arrow batches are held to ``TEXTS_PER_BATCH`` rows: ten thousand long texts would not fit a worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= TEXTS_PER_BATCH:
        conf.set(key, str(TEXTS_PER_BATCH))
    return df


def texts(docs: DataFrame, id_col: str, text_col: str, **more: str) -> DataFrame:
    """The columns an operator reads, under its own names; a null text counts as empty. Other columns are left behind."""
    return bound_batches(docs).select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
                       *[docs[c].alias(name) for name, c in more.items()])


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, train: Column, rows: int,
                    chars: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts for each class that ``train`` admits and ``chars`` characters bound, the lowest hashes of the id first.

    The bound of the training set is these two figures. Only ids and lengths are ranked; the chosen texts alone are read again
    and come to the driver. A document labelled twice takes its smallest label, rows of one id their smallest text.
    """
    marks = (labels.select(labels["doc_id"].alias("doc_id"), labels[label_col].cast("int").alias("label"))
             .where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label")).where(train))
    short = docs.where(F.length("text") <= chars).groupBy("doc_id").agg(F.count("*").alias("n"))
    known = marks.join(short, "doc_id").select("doc_id", "label")
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen)
    picked = (docs.where(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id")
              .groupBy("doc_id", "label").agg(F.min("text").alias("text")))
    return [(r.text, r.label) for r in sorted(picked.collect(), key=lambda r: r.doc_id)]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root the smallest node that can be reached.

    Alternates large stars and small stars over the edges until they rest, so that every round is a few joins and
    aggregations of shrinking edge lists. Nothing is collected; each round is cut by a checkpoint in the shared folder.
    """
    e = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = materialize(small)
        with tidy(e.sparkSession):
            now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before or now.n == 0:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def written(df: DataFrame) -> DataFrame:
    """``materialize`` as Parquet in the shared folder: rows of one text repeat its keys, which a checkpoint would spell out each time."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than one in so many of all rows is split by ``hot_join``; so at most that many keys are.
HOT = 500


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, spread: list[str], how: str = "inner",
             counts: DataFrame | None = None) -> DataFrame:
    """Join (inner or left) of ``rows`` with the one row that ``groups`` has of each key, hot keys dealt over several tasks.

    ``counts`` (materialized; ``groups`` itself if not given) has the number of rows of each key in ``n``. Keys of over a ``HOT``-th of all of
    them, ``HOT`` keys at most, are cut into parts by the hash of ``spread``, the largest into parts of that size; their row of ``groups`` goes to
    each part. Only these keys' hashes come to the driver.
    """
    counts = groups if counts is None else counts
    with tidy(rows.sparkSession):
        total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(64, total // HOT)
    hot = counts.where(F.col(n) > limit).select(F.xxhash64(*keys).alias("key"), F.ceil(F.col(n) / limit).cast("int").alias("parts")).collect()
    # Known by their hash: another key of that hash is split as well, on both sides alike.
    parts, is_hot = max([r["parts"] for r in hot], default=1), F.xxhash64(*keys).isin([r["key"] for r in hot])
    part = F.when(is_hot, F.pmod(F.xxhash64(*spread), F.lit(parts))).otherwise(0).cast("int")
    spots = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_part", part).join(groups.withColumn("_part", F.explode(spots)), [*keys, "_part"], how).drop("_part")


def attach(rows: DataFrame, key: str, table: DataFrame, spread: list[str]) -> DataFrame:
    """Inner ``hot_join`` of ``rows`` with ``table``, which has one row a key and any number of columns; the rows of each key are counted first."""
    counts = materialize(rows.groupBy(key).agg(F.count("*").alias("_n")))
    return hot_join(rows, table, [key], "_n", spread, counts=counts)


#: Bitmaps have 2 ** MOST_BITS slots at most: 16 megabytes.
MOST_BITS = 27


def bitmap(hashes: DataFrame, column: str):
    """Broadcast bitmap of the first bits of all 64-bit hashes: 1,024 slots for each, 16 megabytes at most, filled in tasks.

    Another hash passes by chance at times, more often if there are very many; the join behind it sorts that out.
    """
    with tidy(hashes.sparkSession):
        bits = min(MOST_BITS, max(16, int(hashes.count()).bit_length() + 10))
    spots = hashes.selectExpr(f"shiftrightunsigned({column}, {64 - bits}) as spot").selectExpr(
        "cast(shiftright(spot, 3) as int) as byte", "shiftleft(1, cast(spot & 7 as int)) as bit")
    per_byte = spots.groupBy("byte").agg(F.expr("bit_or(bit)").alias("bit")).withColumn("part", F.shiftright("byte", 13))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros(8192, np.uint8)
        table[pdf["byte"].to_numpy() & 8191] = pdf["bit"].to_numpy()
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "bits": [table.tobytes()]})

    table = bytearray(1 << (bits - 3))
    for r in per_byte.groupBy("part").applyInPandas(pack, "part int, bits binary").toLocalIterator():
        table[r["part"] * 8192:r["part"] * 8192 + 8192] = r["bits"][:len(table)]
    return hashes.sparkSession.sparkContext.broadcast(bytes(table))


def in_bitmap(table: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the unsigned hashes may be in it."""
    bits, shift = np.frombuffer(table, np.uint8), np.uint64(64 - (len(table).bit_length() + 2))
    k = (hashes >> shift).astype(np.int64)
    return ((bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1).astype(bool)


def batches(items: Iterable, size: int):
    """Lists of up to ``size`` items."""
    held = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
