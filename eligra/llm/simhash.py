"""SimHash near-duplicates whose candidates are found and pruned by chains of ring segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from eligra.llm.common import bound_batches, components, fresh, texts
from eligra.session import materialize

BITS = 64
#: Shingles hashed before their bits are counted, so that a very long text needs no more memory than this.
PIECE = 16_384


def fingerprint_of(text: str, words: int = 4) -> int:
    """Majority bits of the XXH64 (seed 42) values of all word shingles, as a signed 64-bit integer; no word: 0."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only the six ASCII spaces split
    if not found:
        return 0
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - words + 1)
    first, last = starts[:n].tolist(), (ends[words - 1:] if len(found) >= words else ends[-1:]).tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, PIECE):
        h = np.array([digest(joined[i:j], 42) for i, j in zip(first[k:k + PIECE], last[k:k + PIECE])], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def fingerprint(text: Column, words: int = 4) -> Column:
    @F.pandas_udf(LongType())
    def majority(column: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, words) for t in column], dtype="int64")

    return majority(text)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def ring(distance: int) -> list[list[int]]:
    """Bit numbers of ``distance + 1`` consecutive segments, as even as possible."""
    cut = [round(i * BITS / (distance + 1)) for i in range(distance + 2)]
    return [list(range(cut[i], cut[i + 1])) for i in range(distance + 1)]


def _mask(bits) -> int:
    return _signed(sum(1 << b for b in bits))


def _options(rows: list[tuple[int, int, int]]) -> Column:
    """A literal array of (start, mask, flip), exploded beside a fingerprint."""
    return F.inline(F.expr("array(" + ", ".join(
        f"named_struct('start', {s}, 'mask', {m}L, 'flip', {f}L)" if m != -(1 << 63) and f != -(1 << 63) else
        f"named_struct('start', {s}, 'mask', {'shiftleft(1L, 63)' if m == -(1 << 63) else f'{m}L'}, "
        f"'flip', {'shiftleft(1L, 63)' if f == -(1 << 63) else f'{f}L'})" for s, m, f in rows) + ")"))


def links(prints: DataFrame, distance: int = 4, bucket: int = 512) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that connect all those ``distance`` or fewer bits apart.

    Pigeonring: of ``distance + 1`` segments on a ring, two fingerprints within the distance have a start from which the
    chain of the next l segments differs in at most l * distance / (distance + 1) bits, for every l. The first segment is
    therefore equal and the second differs in one bit at most: that is an equi-join of the first two segments with each
    one-bit change of the second (26 bits for distance 4). Longer chains prune the candidates before the full count.

    A bucket of more than ``bucket`` fingerprints gives no pairs. Its members meet in all values up to ``distance // 2``
    bits away from each instead, which two fingerprints share just if they lie within an even distance; the rows stay in
    proportion to the members, and every link is still found, as a path.
    """
    if distance % 2:
        raise ValueError("distance must be even")
    seg = ring(distance)
    m = len(seg)
    index, probe = [], []
    for i in range(m):
        mask = _mask(seg[i] + seg[(i + 1) % m])
        index.append((i, mask, 0))
        probe += [(i, mask, _mask([b]) if b is not None else 0) for b in [None, *seg[(i + 1) % m]]]
    prints = prints.select("fp").distinct()

    def keyed(options, name):
        return (prints.select(F.col("fp").alias(name), _options(options))
                .select(name, "start", F.col(name).bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip")).alias("key")))

    left, right = keyed(probe, "a"), keyed(index, "b")
    # Buckets with one fingerprint can still be probed by others, so the index keeps them all; sizes are counted first.
    sizes = materialize(right.groupBy("start", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket))
    crowded = not sizes.isEmpty()
    if crowded:
        right_small, left_small = (d.join(sizes.select("start", "key"), ["start", "key"], "left_anti") for d in (right, left))
    else:
        right_small, left_small = right, left
    diff = F.col("a").bitwiseXOR(F.col("b"))
    chain = F.lit(True)
    for i in range(m):
        within = F.lit(True)
        for length in range(3, m):
            bits = [b for k in range(length) for b in seg[(i + k) % m]]
            within &= F.bit_count(diff.bitwiseAND(F.lit(_mask(bits)))) <= length * distance // m
        chain &= (F.col("start") != i) | within
    found = (left_small.join(right_small, ["start", "key"]).where("a < b").where(chain)
             .where(F.bit_count(diff) <= distance).select("a", "b").distinct())
    if not crowded:
        return found
    hot = (left.withColumnRenamed("a", "fp").unionByName(right.withColumnRenamed("b", "fp"))
           .join(sizes.select("start", "key"), ["start", "key"], "left_semi").select("fp").distinct())
    bits = F.array(*[F.shiftleft(F.lit(1).cast("long"), b) for b in range(BITS)])
    ball = hot
    for step in range(distance // 2):  # each step changes one more bit or none
        ball = ball.withColumn("near" if step == 0 else "next", F.explode(F.concat(F.array(F.lit(0).cast("long")), bits)))
        ball = (ball.withColumn("near", F.col("fp").bitwiseXOR(F.col("near"))) if step == 0 else
                ball.withColumn("near", F.col("near").bitwiseXOR(F.col("next"))).drop("next"))
    ball = materialize(ball.distinct())
    least = ball.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return found.unionByName(ball.join(least, "near").where("fp > a").select("a", F.col("fp").alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4,
                    bucket: int = 512) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and link like any other. A null id is skipped where a smaller one is sought; a
    component of null ids alone has a null component_id. Repeated rows give repeated rows. Other columns are not read. An
    empty table gives no rows. Equal fingerprints are one node, so a group of copies costs one node however large it is.
    """
    rows = materialize(texts(docs, id_col, text_col).select("doc_id", fingerprint(F.col("text"), words).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(nodes, distance, bucket))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = nodes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The row of each component with its smallest id, with all columns of ``docs``.

    Rows of one id are told apart by their text; of rows equal in both, one stays. Rows without an id have no
    component_id to be kept by and stay only if their whole component has none (then the smallest text hash stays).
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    slim = bound_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(slim.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
                                   fingerprint(F.coalesce("text", F.lit("")), options.get("words", 4)).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    return least_rows(docs, rows, nodes, links(nodes, options.get("distance", 4), options.get("bucket", 512)), id_col, text_col)


def least_rows(docs: DataFrame, rows: DataFrame, nodes: DataFrame, edges: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The row of ``docs`` with the least (none, doc_id, text_hash) of each component of ``nodes`` (fp, best) under ``edges`` (a, b)."""
    text_hash, count, component = fresh(docs, "text_hash", "n", "component_id")
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    nodes = nodes.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = nodes.groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.text_hash")
    repeats = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    kept = (best.join(repeats, best["doc_id"].eqNullSafe(repeats["doc_id"]) & (best["text_hash"] == repeats["text_hash"]))
            .select(best["doc_id"].alias(component), best["text_hash"].alias(text_hash), F.col("n").alias(count)))
    kept = materialize(kept)
    marked = docs.withColumn(f"{text_hash}_", hashed)
    out = marked.join(kept, marked[id_col].eqNullSafe(kept[component]) & (marked[f"{text_hash}_"] == kept[text_hash]))
    single = out.where(F.col(count) == 1).select(*[marked[c] for c in docs.columns])
    if kept.where(F.col(count) > 1).isEmpty():
        return single
    return single.unionByName(out.where(F.col(count) > 1).select(*[marked[c] for c in docs.columns])
                              .dropDuplicates([id_col, text_col]))
