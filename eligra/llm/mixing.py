"""Source mixing to target word shares by cube-method balanced sampling."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligra.llm.common import fresh, word_count
from eligra.session import materialize

#: A document above this part of its source's words is decided before the others: at most 100 of a source can be.
GIANT = 0.01
EPS = 1e-9


def _positions(sources: DataFrame) -> DataFrame:
    """``at``: place of each source by code point from 0, null last; sorted in ranges, with one small row for each range."""
    order = F.col("source").asc_nulls_last()
    placed = materialize(sources.repartitionByRange(order).sortWithinPartitions(order)
                         .withColumn("id", F.monotonically_increasing_id())
                         .select("*", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("row")))
    before = placed.groupBy("part").agg(F.count("*").alias("n"))
    offsets = before.alias("x").join(before.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy("x.part").agg(
        F.coalesce(F.sum("y.n"), F.lit(0)).alias("offset"))
    return placed.join(offsets, "part").withColumn("at", F.col("offset") + F.col("row")).drop("id", "part", "row", "offset")


def targets(sources: DataFrame, share: float, cap: float, weights: Sequence[float]) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): weights by place, ``share`` of all words, none above ``cap`` times its words.

    The level of words for each unit of weight rises until no excess is left to share anew: one aggregate a round, and each
    round caps a source more at least.
    """
    placed = _positions(sources)
    pick = F.array(*[F.lit(float(w)) for w in weights])
    placed = materialize(placed.withColumn("weight", F.element_at(pick, (F.col("at") % len(weights) + 1).cast("int"))).drop("at"))
    most = F.col("source_size") * cap
    total = placed.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    if not total.n:
        return placed.withColumn("target", F.lit(0.0)).drop("weight")
    level, capped = share * total.n / total.w, -1
    while True:
        full = most <= F.col("weight") * level
        now = placed.agg(F.count_if(full).alias("capped"), F.sum(F.when(full, most)).alias("words"),
                         F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if now.capped == capped or not now.w:
            break
        capped, level = now.capped, (share * total.n - (now.words or 0.0)) / now.w
    return placed.withColumn("target", F.least(most.cast("double"), F.col("weight") * level)).drop("weight")


def _seed(*parts) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(zlib.crc32(repr(parts).encode())))


def giants(pdf: pd.DataFrame, cap: float, seed: int) -> pd.DataFrame:
    """Copies of a source's largest documents, one after the other: a move that keeps the word total shifts the rate of all others."""
    pdf = pdf.sort_values(["size", "h", "doc_id", "copy"], ascending=[False, True, True, True])
    left, words = float(pdf["target"].iloc[0]), float(pdf["source_size"].iloc[0])
    rng, copies = _seed(seed, "giants", str(pdf["source"].iloc[0])), []
    for size in pdf["size"].tolist():
        rate = min(max(left / words, 0.0), cap)
        low, p = int(rate), rate - int(rate)
        rest = words - size

        def off(n: int) -> float:  # words that no rate of the rest can mend
            need = left - n * size
            return max(-need, need - cap * rest, 0.0)

        options = [n for n in (low, low + 1) if n <= cap]
        least = min(map(off, options))
        options = [n for n in options if off(n) <= least + 0.5]
        n = options[0] if len(options) == 1 else low + (rng.random() < p)
        copies.append(n)
        left, words = left - n * size, rest
    rate = min(max(left / words, 0.0), cap) if words > 0 else 0.0
    return pdf.assign(copies=copies, rate=rate)[["source", "doc_id", "h", "size", "copy", "copies", "rate"]]


def flight(p: list[float], x: list[float], rng: np.random.Generator) -> list[int]:
    """Moves ``p`` to 0 or 1 along vectors that change neither sum(p) nor sum(p * x); places of the two or fewer left between.

    Three units leave one direction free (the cross product of the two constraints). A step as far as the unit cube allows,
    up or down with odds that keep each expectation, settles one unit at least, which the next one replaces.
    """
    active: list[int] = []
    draws = iter(())
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            active.append(i)
        else:
            p[i] = float(round(p[i]))
        while len(active) == 3:
            a, b, c = active
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            if u == (0, 0, 0):
                u = (1, -1, 0)
            up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(active, u) if d)
            down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(active, u) if d)
            draw = next(draws, None)
            if draw is None:
                draws = iter(rng.random(4096).tolist())
                draw = next(draws)
            step = up if draw * (up + down) < down else -down
            for k, d in zip((a, b, c), u):
                p[k] += step * d
                if p[k] < EPS or p[k] > 1 - EPS:
                    p[k] = float(p[k] > 0.5)
                    active.remove(k)
    return active


def land(p: list[float], x: list[float], active: list[int]) -> None:
    """The outcome of the last two units that is nearest in words, then in documents."""
    best = min(((abs(sum((s - p[k]) * x[k] for k, s in zip(active, pick))), abs(sum(s - p[k] for k, s in zip(active, pick))), pick)
                for pick in ([(0,), (1,)] if len(active) == 1 else [(0, 0), (0, 1), (1, 0), (1, 1)])))
    for k, s in zip(active, best[2]):
        p[k] = float(s)


def _fly(seed: int, level: int, last: bool):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h", "doc_id", "copy"], ascending=[False, True, True, True])
        p, x = pdf["p"].tolist(), pdf["size"].tolist()
        active = flight(p, x, _seed(seed, level, str(pdf["source"].iloc[0]), int(pdf["block"].iloc[0])))
        if last and active:
            land(p, x, active)
        return pdf.assign(p=p)[["source", "doc_id", "h", "size", "copy", "base", "p"]]

    return block


def decide(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
           share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = (3, 1, 2), block: int = 4_000,
           seed: int = 42) -> DataFrame:
    """How often each row is taken: doc_id, h (hash of the text), source, size, source_size, target, copies, taken.

    ``size`` is the number of words unless another column is given. A document's rate is its source's target over its words:
    the whole part is taken for sure, the fraction is an inclusion probability. Documents above 1 % of their source are
    settled first. The others fly in blocks of about ``block`` rows of a source, balanced on words and documents, largest
    first; two or fewer of a block stay open and meet in the next, smaller level, until one block a source is left and its
    last two units land where the words come nearest.

    A null text has size 0, null sources are one source, null ids are kept. Rows equal in id, source and text are numbered,
    which splits them over blocks, and decided one by one. Draws depend on the seed and on these values alone, so reruns
    agree. An empty table gives no rows.
    """
    n = word_count(F.col(text_col)) if size is None else size
    # Ids pass pandas as text: a column of integers and nulls would become floating point there.
    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), docs[source_col].cast("string").alias("source"), n.alias("size"),
                       F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("h"))
    rows = materialize(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("n")))
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sources = materialize(targets(sources, share, cap, weights))
    s = sources.select(F.col("source").alias("s"), "source_size", "target", "docs")
    units = (rows.join(s, F.col("source").eqNullSafe(F.col("s")))
             .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n", "s"))
    big = F.col("size") > F.col("source_size") * GIANT
    kept = "source string, doc_id string, h bigint, size bigint, copy bigint"
    first = materialize(units.where(big).groupBy("source").applyInPandas(lambda pdf: giants(pdf, cap, seed), f"{kept}, copies int, rate double"))
    rates = first.groupBy(F.col("source").alias("g")).agg(F.max("rate").alias("rate"))
    rate = F.coalesce("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    open_ = (units.where(~big).join(rates, F.col("source").eqNullSafe(F.col("g")), "left").withColumn("rate", rate)
             .select("source", "doc_id", "h", "size", "copy", F.floor("rate").cast("int").alias("base"),
                     (F.col("rate") - F.floor("rate")).alias("p"), F.ceil(F.col("docs") / block).cast("int").alias("blocks")))
    settled, level = first.select("source", "doc_id", "h", "size", "copies"), 0
    last = (sources.agg(F.max("docs").alias("n")).first().n or 0) <= block
    while True:
        cut = F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "h", "copy"), F.col("blocks")).cast("int")
        flown = materialize(open_.withColumn("block", cut).drop("blocks").groupBy("source", "block")
                            .applyInPandas(_fly(seed, level, last), f"{kept}, base int, p double"))
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        settled = settled.unionByName(flown.where(whole).select("source", "doc_id", "h", "size", (F.col("base") + F.col("p")).cast("int").alias("copies")))
        if last:
            break
        rest = flown.where(~whole)
        per = materialize(rest.groupBy(F.col("source").alias("g")).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
        last, level = (per.agg(F.max("blocks").alias("n")).first().n or 1) == 1, level + 1
        open_ = rest.join(per, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    return (settled.join(s.drop("docs"), F.col("source").eqNullSafe(F.col("s")))
            .select(F.col("doc_id").cast(docs.schema[id_col].dataType), "h", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document taken, with all its columns and ``copies`` and ``target`` behind them.

    Rows equal in id, source and text stay apart. Columns of those names in ``docs`` make the new ones longer.
    """
    id_col, source_col, text_col = (options.get(k, d) for k, d in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text")))
    copies, target = fresh(docs, "copies", "target")
    i, h, s, mark = fresh(docs, "i_", "h_", "s_", "mark_")
    got = (decide(docs, **options).groupBy("doc_id", "h", "source", "target").agg(F.collect_list("copies").alias("copies")))
    got = materialize(got.select(F.col("doc_id").alias(i), F.col("h").alias(h), F.col("source").alias(s), F.col("target").alias(target),
                                 F.col("copies").alias(copies)).where(F.exists(copies, lambda c: c > 0)))
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = marked.join(got, marked[id_col].eqNullSafe(got[i]) & (marked[mark] == got[h]) & marked[source_col].eqNullSafe(got[s]))

    def rows(df: DataFrame) -> DataFrame:
        return df.select(*[marked[c] for c in docs.columns], F.explode(copies).alias(copies), target).where(F.col(copies) > 0)

    single = rows(out.where(F.size(copies) == 1))
    if got.where(F.size(copies) > 1).isEmpty():
        return single
    return single.unionByName(rows(out.where(F.size(copies) > 1).dropDuplicates([i, h, s])))
