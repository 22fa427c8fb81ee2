"""Benchmark leaks found by spaced-seed hashing and verified along their diagonal."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligra.llm.common import bitmap, fresh, in_bitmap, texts
from eligra.session import materialize

#: Token positions that count (1) and that may differ (0). Every stretch of 13 words or more that begins and ends in equal words and
#: is 80 % alike holds one of them in equal words, wherever its other words are (shown in the tests): no such overlap goes unverified.
MASKS = ("111111", "11101011", "11001000111", "1101000001101")
COVERED = (13, 0.8)
TOKEN = re.compile(r"\w+")


class Hashes(dict):
    """64-bit hashes of words, worked out once for each word; emptied between texts when it holds very many."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def hashed(text: str, known: Hashes) -> np.ndarray:
    """Hashes of the words in lower case."""
    if len(known) > 300_000:
        known.clear()
    words = TOKEN.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def whole_masks(n: int, same: float) -> list[str]:
    """Masks of ``n`` words, one of which any sequence fits that is ``same`` alike and equal in its first and last word.

    Of one more piece of the inner words than may differ, one is equal.
    """
    cuts = int((1 - same) * n + 1e-9) + 1
    inner = max(0, n - 2)
    edges = [inner * k // cuts for k in range(cuts + 1)]
    return list(dict.fromkeys("".join("1" if i in (0, n - 1) or lo < i <= hi else "0" for i in range(n)) for lo, hi in zip(edges, edges[1:])))


def long_masks(least: int, same: float) -> tuple[str, ...]:
    """Masks for overlaps of ``least`` words: ``MASKS`` where they cover the rule, else the run of equal words that no overlap can be without."""
    if least >= COVERED[0] and same >= COVERED[1]:
        return MASKS
    runs = []
    for n in range(least, least + 2_000):
        odd = int((1 - same) * n + 1e-9)
        runs.append(-(-(n - odd) // (odd + 1)))
    return ("1" * max(1, min(runs)),)


Shape = tuple[int, str]


def shapes(least: int, same: float, n: int | None = None) -> list[Shape]:
    """Numbered masks of items of ``n`` words, fewer than an overlap has and so compared whole, or (None) of all longer ones."""
    return list(enumerate(long_masks(least, same))) if n is None else [(64 * n + k, m) for k, m in enumerate(whole_masks(n, same))]


def longest_whole(least: int, same: float) -> int:
    """Items of up to so many words are compared whole; longer ones hold a long mask wherever they overlap enough."""
    return (COVERED[0] if long_masks(least, same) == MASKS else least) - 1


def seeds(words: np.ndarray, masks: list[Shape]) -> list[np.ndarray]:
    """For each mask, the hash of its counted words at every place where it fits."""
    out = []
    for k, mask in masks:
        n = len(words) - len(mask) + 1
        if n < 1:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.full(n, (0x9E3779B97F4A7C15 + k) % (1 << 64), np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ words[i:i + n]) * np.uint64(0xFF51AFD7ED558CCD)
                h ^= h >> np.uint64(32)
        out.append(h)
    return out


def _item_rows(least: int, same: float):
    def rows_of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, whole = Hashes(), longest_whole(least, same)
        for pdf in parts:
            rows = []
            for item, text in zip(pdf["item_id"], pdf["text"]):
                words = hashed(text, known)
                if len(words):
                    for h in seeds(words, shapes(least, same, len(words) if len(words) <= whole else None)):
                        rows += [(item, i, int(v), len(words)) for i, v in enumerate(h.view(np.int64))]
            yield pd.DataFrame(rows, columns=["item_id", "at", "seed", "n"])

    return rows_of


def _doc_seeds(of_items, masks: list[Shape]):
    """Places of a text whose seed may be one of a benchmark. Texts are hashed together; a seed that runs over an end is left out."""

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashes()
        for pdf in parts:
            words = [hashed(t, known) for t in pdf["text"]]
            ends = np.cumsum([len(w) for w in words])
            flat = np.concatenate(words) if words else np.empty(0, np.uint64)
            docs, rids, out = pdf["doc_id"].to_numpy(), pdf["rid"].to_numpy(), []
            for mask in masks:
                (h,), n = seeds(flat, [mask]), len(mask[1])
                at = np.flatnonzero(in_bitmap(of_items.value, h))
                row = np.searchsorted(ends, at, side="right")
                inside = at + n <= ends[row] if len(at) else np.zeros(0, bool)
                at, row = at[inside], row[inside]
                start = np.concatenate([[0], ends])[row]
                out.append(pd.DataFrame({"doc_id": docs[row], "rid": rids[row], "place": (at - start).astype(np.int32),
                                         "seed": h[at].view(np.int64) if len(h) else np.empty(0, np.int64)}))
            yield pd.concat(out)

    return scan


def _cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each diagonal of a text, its words there."""
    known = Hashes()
    for pdf in parts:
        rows, size = [], 0
        for doc, rid, text, met in zip(pdf["doc_id"], pdf["rid"], pdf["text"], pdf["met"]):
            words = hashed(text, known).view(np.int64)
            for m in met:
                low = max(0, m["diagonal"])
                part = words[low:max(0, m["diagonal"] + m["n"])]
                rows.append((doc, rid, m["item_id"], m["diagonal"], low, part.tolist()))
                size += len(part)
                if size > 200_000:
                    yield pd.DataFrame(rows, columns=["doc_id", "rid", "item_id", "diagonal", "low", "words"])
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=["doc_id", "rid", "item_id", "diagonal", "low", "words"])


def overlap(a: np.ndarray, b: np.ndarray, least: int, same: float) -> tuple[int, int, int] | None:
    """Longest stretch of two equally placed word sequences that begins and ends in equal words and is ``same`` alike: (from, to, equal).

    At least ``least`` words, or all of a shorter sequence ``b``.
    """
    eq = a == b
    at = np.flatnonzero(eq)
    if not len(at):
        return None
    # Score +(1 - same) for an equal word, -same for another: a stretch is alike enough if its sum is not negative.
    total = np.concatenate([[0.0], np.cumsum(np.where(eq, 1 - same, -same))])
    start, end = total[at], total[at + 1]
    low = np.minimum.accumulate(start)
    best = None
    for j in range(len(at) - 1, -1, -1):
        if best and at[j] + 1 - at[0] <= best[1] - best[0]:
            break
        i = int(np.searchsorted(-low[:j + 1], -(end[j] + 1e-9)))  # first start whose running minimum is no higher than this end
        if i <= j and at[j] + 1 - at[i] >= least and (best is None or at[j] + 1 - at[i] > best[1] - best[0]):
            best = (int(at[i]), int(at[j] + 1), j - i + 1)
    return best


def _verify(least: int, same: float):
    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for doc, rid, item, low, diagonal, words, item_words in zip(
                    pdf["doc_id"], pdf["rid"], pdf["item_id"], pdf["low"], pdf["diagonal"], pdf["words"], pdf["item_words"]):
                a, b = np.asarray(words), np.asarray(item_words)[low - diagonal:]
                got = overlap(a, b[:len(a)], min(least, len(item_words)), same)
                if got:
                    rows.append((doc, rid, item, low + got[0], low + got[1], got[2], len(item_words)))
            yield pd.DataFrame(rows, columns=["doc_id", "rid", "item_id", "first_word", "end_word", "n_equal", "item_words"])

    return check


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", least: int = 13, same: float = 0.8) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, rid (text hash), item_id, first_word, end_word, n_equal, item_words.

    Words are runs of word characters in lower case. A seed hashes the words that a mask counts; documents meet benchmark
    items by an equi-join on seeds. Around each hit, both are compared word by word on its diagonal: an overlap has ``least``
    words or more (all of a shorter item), begins and ends in equal words, and ``same`` of its words are equal. The longest
    one of a pair is returned. The masks hit every such overlap; items of fewer words have masks of their own length.

    A bitmap of bounded size, made of the benchmark's seeds, keeps other seeds of the documents from being shuffled, and one of
    the documents that met an item keeps other texts from it. Null texts and texts without words have no row, null ids
    are kept, equal rows give one result, and empty tables give no rows. Other columns are not read.
    """
    tests = benchmark.select(benchmark[item_col].alias("item_id"), F.coalesce(benchmark[item_text_col].cast("string"), F.lit("")).alias("text")).distinct()
    item_type, doc_type = benchmark.schema[item_col].dataType, docs.schema[id_col].dataType
    as_text = tests.select(F.col("item_id").cast("string"), "text")  # ids pass pandas as text: integers and nulls would become floating point
    items = materialize(as_text.mapInPandas(_item_rows(least, same), "item_id string, at int, seed bigint, n int"))

    def words_of(parts):
        known = Hashes()
        for pdf in parts:
            yield pd.DataFrame({"item_id": pdf["item_id"], "item_words": [hashed(t, known).view(np.int64).tolist() for t in pdf["text"]]})

    full = materialize(as_text.mapInPandas(words_of, "item_id string, item_words array<bigint>"))
    shorter = [r.n for r in items.where(F.col("n") <= longest_whole(least, same)).select("n").distinct().collect()]
    masks = shapes(least, same) + [m for n in sorted(shorter) for m in shapes(least, same, n)]
    rows = texts(docs, id_col, text_col).select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("rid"), "text")
    hits = rows.mapInPandas(_doc_seeds(bitmap(items, "seed"), masks), "doc_id string, rid bigint, place int, seed bigint")
    met = hits.join(items, "seed").select("doc_id", "rid", "item_id", "n", (F.col("place") - F.col("at")).alias("diagonal")).distinct()
    by_doc = materialize(met.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("item_id", "n", "diagonal")).alias("met")))
    of_docs = bitmap(by_doc, "rid")

    @F.pandas_udf("boolean")
    def may_hold(rid: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(of_docs.value, rid.to_numpy(np.int64).view(np.uint64)))

    # Only texts that may have met an item are shuffled.
    some = rows.where(may_hold("rid")).dropDuplicates(["doc_id", "rid"])
    texts_met = some.join(by_doc.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "met"),
                          F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")))
    cut = texts_met.select("doc_id", "rid", "text", "met").mapInPandas(
        _cut, "doc_id string, rid bigint, item_id string, diagonal int, low int, words array<bigint>")
    pairs = cut.join(full.select(F.col("item_id").alias("i"), "item_words"), F.col("item_id").eqNullSafe(F.col("i")))
    found = pairs.select("doc_id", "rid", "item_id", "low", "diagonal", "words", "item_words").mapInPandas(
        _verify(least, same), "doc_id string, rid bigint, item_id string, first_word int, end_word int, n_equal int, item_words int")
    best = F.max_by(F.struct("first_word", "end_word", "n_equal", "item_words"),
                    F.struct((F.col("end_word") - F.col("first_word")).alias("n"), -F.col("first_word"))).alias("best")
    return found.groupBy("doc_id", "rid", "item_id").agg(best).select(
        F.col("doc_id").cast(doc_type), "rid", F.col("item_id").cast(item_type), "best.*")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that overlap a benchmark item, all columns kept.

    Null and empty texts stay, texts of any length are searched whole, rows without an id go or stay like others, repeated rows share
    their fate, and rows of one id are told apart by their text. Names of other columns may be any. An empty table gives no rows.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    d, r, rid = fresh(docs, "d_", "r_", "rid_")
    bad = materialize(leaks(docs, benchmark, **options).select(F.col("doc_id").alias(d), F.col("rid").alias(r)).distinct())
    marked = docs.withColumn(rid, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return marked.join(bad, marked[id_col].eqNullSafe(bad[d]) & (marked[rid] == bad[r]), "left_anti").drop(rid)
