"""Repeated byte strings by a distributed merge sort of front-coded suffix runs with loser trees.

Sorting every suffix of a corpus moves hundreds of times its size. Here only suffixes at anchors are sorted: the place of the
smallest hash of eight bytes in each stretch of ``REACH`` bytes, which equal strings share whatever stands around them. Each string of
``LENGTH`` bytes has its anchor among its first ``REACH`` places, so it is repeated only where its anchor's next ``CORE`` bytes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligra.llm.common import bitmap, bound_batches, in_bitmap
from eligra.session import materialize

LENGTH, REACH = 200, 120
CORE = LENGTH - REACH + 1
GRAM = 8
#: Suffixes of a sorted run; of a merge task on average; distinct contexts of one anchor beyond which its strings are spread by hash.
RUN, MERGE, CROWD = 20_000, 50_000, 20_000


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): each anchor and the first and last place of the strings it stands for."""
    n = len(raw) - LENGTH + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none
    m = len(raw) - GRAM + 1
    h = np.zeros(m, np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(8)) | raw[k:m + k]
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    # Hash above, place below: the smallest is the leftmost of the smallest hashes.
    h = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    rows = -(-m // REACH)
    full = np.full(rows * REACH, np.uint64(0xFFFFFFFFFFFFFFFF))
    full[:m] = h
    full = full.reshape(rows, REACH)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    at = (np.minimum(behind[:n], ahead[REACH - 1:REACH - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], first, np.append(first[1:], n) - 1


def _core_hashes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = xxhash.xxh3_64_intdigest
    for pdf in parts:
        out = []
        for text in pdf["body"]:
            at, _, _ = anchors(np.frombuffer(text, np.uint8))
            out += [digest(text[p:p + CORE]) for p in at.tolist()]
        yield pd.DataFrame({"hc": np.array(out, np.uint64).view(np.int64)})


def _contexts(repeated):
    """Anchors whose core may be repeated: core hash, hash of all its strings' bytes, place and the reach to the first and last string."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        core_of, wide_of = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for pdf in parts:
            out = []
            for k1, k2, text in zip(pdf["k1"], pdf["k2"], pdf["body"]):
                at, first, last = anchors(np.frombuffer(text, np.uint8))
                if not len(at):
                    continue
                hc = np.array([core_of(text[p:p + CORE]) for p in at.tolist()], np.uint64)
                keep = np.flatnonzero(in_bitmap(repeated.value, hc))
                if not len(keep):
                    continue
                at, first, last, hc = at[keep], first[keep], last[keep], hc[keep]
                hw = [wide_of(text[a:b + LENGTH], p - a) for p, a, b in zip(at.tolist(), first.tolist(), last.tolist())]
                out.append(pd.DataFrame({"k1": k1, "k2": k2, "at": at.astype(np.int32), "first": first.astype(np.int32), "last": last.astype(np.int32),
                                         "hc": hc.view(np.int64), "hw": np.array(hw, np.uint64).view(np.int64)}))
            if out:
                yield pd.concat(out)

    return run


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of which ``known`` bytes need no second look."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n if not x else n - (x.bit_length() + 7) // 8


def front_code(sorted_suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefix of each suffix with the one before it, and what follows."""
    shared, tails, before = [], [], b""
    for s in sorted_suffixes:
        k = common(before, s, 0)
        shared.append(k)
        tails.append(s[k:])
        before = s
    return shared, tails


def merge(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """(run, place, suffix, common prefix with the one before) of front-coded sorted runs, in order.

    A loser tree: every node keeps the loser of its match and how far it agrees with the winner. Of two contenders the one that shares
    more with the last suffix put out is the smaller; only if both share as much are they compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    place, now, lcp, tree = [0] * size, [None] * size, [0] * size, [-1] * size
    for r, (_, tails) in enumerate(runs):
        if tails:
            now[r] = tails[0]

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        if now[a] is None or now[b] is None:
            return (b, a) if now[a] is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        k = common(now[a], now[b], lcp[a])
        x, y = now[a], now[b]
        first = k == len(x) or (k < len(y) and x[k] < y[k])
        win, lose = (a, b) if first else (b, a)
        lcp[lose] = k
        return win, lose

    winners = list(range(size))
    level = size
    while len(winners) > 1:
        level //= 2
        following = []
        for i in range(0, len(winners), 2):
            win, lose = match(winners[i], winners[i + 1])
            tree[level + i // 2] = lose
            following.append(win)
        winners = following
    top = winners[0]
    while now[top] is not None:
        yield top, place[top], now[top], lcp[top]
        place[top] += 1
        shared, tails = runs[top]
        k = place[top]
        if k < len(tails):
            lcp[top], now[top] = shared[k], now[top][:shared[k]] + tails[k]
        else:
            now[top] = None
        node = (top + size) // 2
        while node:
            top, tree[node] = match(top, tree[node])
            node //= 2


def _pack(entries: list[tuple]) -> bytes:
    """One run, sorted by suffix and front-coded; entries are (suffix, left context, k1, k2, at, first, last)."""
    entries.sort(key=lambda e: e[0])
    shared, tails = front_code([e[0] for e in entries])
    numbers = np.array([(e[2], e[3], e[4], e[5], e[6], s, len(t), len(e[1])) for e, s, t in zip(entries, shared, tails)], np.int64)
    return zstandard.compress(len(entries).to_bytes(8, "big") + numbers.T.tobytes() + b"".join(tails) + b"".join(e[1] for e in entries))


def _unpack(blob: bytes):
    data = zstandard.decompress(blob)
    n = int.from_bytes(data[:8], "big")
    numbers = np.frombuffer(data, np.int64, 8 * n, 8).reshape(8, n)
    at, parts = 8 + 64 * n, []
    for sizes in (numbers[6], numbers[7]):
        ends = (at + np.cumsum(sizes)).tolist()
        parts.append([data[a:b] for a, b in zip([at, *ends[:-1]], ends)])
        at = ends[-1] if ends else at
    return numbers[:5], (numbers[5].tolist(), parts[0]), parts[1]


def _runs(pieces: int):
    """Sorted runs for each merge task, and the strings of crowded anchors by hash."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        count, loose = 0, []

        def out() -> pd.DataFrame:
            rows = [(p, _pack(e), None, None, None, None, None) for p, e in held.items()] + [(None, None, *x) for x in loose]
            held.clear()
            loose.clear()
            # Nullable integers from the start: a detour through floating point would lose digits.
            return pd.DataFrame({c: [r[i] for r in rows] if c == "run" else pd.array([r[i] for r in rows], "Int64")
                                 for i, c in enumerate(("piece", "run", "h1", "h2", "k1", "k2", "at"))})

        for pdf in parts:
            for k1, k2, text, wanted in zip(pdf["k1"], pdf["k2"], pdf["body"], pdf["wanted"]):
                for w in wanted:
                    at, first, last = w["at"], w["first"], w["last"]
                    if w["crowded"]:
                        for i in range(first, last + 1):
                            h = xxhash.xxh3_128_digest(text[i:i + LENGTH])
                            loose.append((int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), k1, k2, i))
                        count += last - first + 1
                    else:
                        held.setdefault(w["hc"] % pieces, []).append((text[at:at + LENGTH], text[first:at], k1, k2, at, first, last))
                        count += 1
                    if count >= RUN:
                        yield out()
                        count = 0
        yield out()

    return run


def repeated_strings(suffixes: list[bytes], lcp: np.ndarray, lefts: list[bytes], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For sorted anchor suffixes: which strings, ``low`` to ``high`` bytes left of each anchor, equal one of another anchor.

    A string that starts a bytes before its anchor equals another's if both share LENGTH - a bytes behind it (no smaller common prefix lies
    between them) and the a bytes before it (numbered anew from a to a + 1, so that equal numbers are equal bytes).
    """
    n = len(suffixes)
    size = np.fromiter(map(len, lefts), np.int64, n)
    flat = np.frombuffer(b"".join(lefts), np.uint8)
    end = np.cumsum(size)
    same = np.zeros((n, REACH), bool)
    left = np.zeros(n, np.int64)
    for a in range(REACH):
        valid = np.flatnonzero((low <= a) & (a <= high))
        if len(valid):
            group = np.cumsum(lcp < LENGTH - a)[valid]
            order = np.lexsort((left[valid], group))
            g, v = group[order], left[valid][order]
            equal = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
            hit = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
            same[valid[order[hit]], a] = True
        byte = np.where(a < size, flat[np.minimum(np.maximum(end - 1 - a, 0), max(0, len(flat) - 1))] if len(flat) else 0, 256)
        left = np.unique(left * 257 + byte, return_inverse=True)[1]
    return same


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Intervals of bytes of repeated strings found by merging the runs of one piece."""
    opened = [_unpack(bytes(b)) for b in pdf["run"]]
    suffixes, lcps, where = [], [], []
    for run, k, s, shared in merge([r for _, r, _ in opened]):
        suffixes.append(s)
        lcps.append(shared)
        where.append((run, k))
    numbers = np.array([opened[r][0][:, k] for r, k in where], np.int64).reshape(-1, 5)
    at, first, last = numbers[:, 2], numbers[:, 3], numbers[:, 4]
    same = repeated_strings(suffixes, np.array(lcps, np.int64), [opened[r][2][k] for r, k in where], at - last, at - first)
    # Runs of repeated strings, from the leftmost (large a) to the anchor.
    edge = np.diff(np.pad(same[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, begin = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    start = at[row] - (REACH - 1 - begin)
    return pd.DataFrame({"k1": numbers[row, 0], "k2": numbers[row, 1], "start": start.astype(np.int32),
                         "end": (start + (stop - begin) - 1 + LENGTH).astype(np.int32)})


def _keep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is left of each text without its intervals, which are united where they touch."""
    for pdf in parts:
        out = []
        for k1, k2, text, spans in zip(pdf["k1"], pdf["k2"], pdf["body"], pdf["spans"]):
            digest, low, removed, n = hashlib.sha256(), 0, 0, 0
            reach = -1  # end of the removed run so far
            for start, end in sorted((s["start"], s["end"]) for s in spans):
                if start > reach:
                    digest.update(text[low:start])
                    n += 1
                    reach = start
                if end > reach:
                    removed += end - reach
                    low = reach = end
            digest.update(text[low:])
            out.append((k1, k2, removed, n, digest.hexdigest()))
        yield pd.DataFrame(out, columns=["k1", "k2", "n_removed", "n_spans", "kept"])


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bodies of the texts that ``wanted`` (k1, k2, ...) names, once each, with its columns: a bitmap keeps most others from the shuffle."""
    keys = bitmap(wanted, "k1")

    @F.pandas_udf("boolean")
    def may(k: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(keys.value, k.to_numpy(np.int64).view(np.uint64)))

    return rows.where(may("k1")).dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte that a string of 200 bytes covers which starts anywhere else in the corpus too, in this text or another, is removed; strings do
    not cross texts. Results depend on the text alone and are worked out once for equal texts. Null and empty texts have no byte;
    texts below 200 bytes lose none. Null ids and repeated rows are kept, and repeated rows repeat each other. Other columns are not read.
    An empty table gives no rows.

    Steps: hashes of anchor cores are counted; anchors of repeated cores come back with a hash of all their strings' bytes. Where
    that is repeated too, all its strings are. Else its suffix goes into sorted, front-coded runs, with one suffix of each repeated context
    that shares its core; loser trees merge the runs of a piece, and common prefixes in that order tell which strings are equal. An anchor
    core in more than ``CROWD`` different contexts would fill a task: its strings are counted by a 128-bit hash instead.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = bound_batches(docs).select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.cast("binary").alias("body"))
    long = rows.where(F.octet_length("body") >= LENGTH).select("k1", "k2", "body")
    counted = long.select("body").mapInPandas(_core_hashes, "hc bigint").groupBy("hc").agg(F.count("*").alias("n")).where("n > 1").select("hc")
    found = materialize(long.mapInPandas(_contexts(bitmap(materialize(counted), "hc")),
                                         "k1 bigint, k2 bigint, at int, first int, last int, hc bigint, hw bigint"))
    contexts = found.groupBy("hc", "hw").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one"))
    cores = contexts.groupBy("hc").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
    judged = materialize(found.join(contexts, ["hc", "hw"]).join(cores.where("total > 1"), "hc"))
    whole = judged.where("n > 1").select("k1", "k2", F.col("first").alias("start"), (F.col("last") + LENGTH).alias("end")).distinct()
    unsure = judged.where(F.col("single") > 0).where((F.col("n") == 1) | (F.col("one") == F.struct("k1", "k2", "at"))).dropDuplicates(["k1", "k2", "at"])
    entry = F.struct("at", "first", "last", F.pmod("hc", F.lit(1 << 31)).alias("hc"), (F.col("kinds") > CROWD).alias("crowded"))
    wanted = materialize(unsure.groupBy("k1", "k2").agg(F.collect_list(entry).alias("wanted")))
    pieces = max(1, -(-(wanted.agg(F.sum(F.size("wanted")).alias("n")).first().n or 0) // MERGE))
    pieces = max(pieces, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    runs = materialize(_texts_of(long, wanted).select("k1", "k2", "body", "wanted").mapInPandas(
        _runs(pieces), "piece bigint, run binary, h1 bigint, h2 bigint, k1 bigint, k2 bigint, at bigint"))
    merged = runs.where("piece is not null").select("piece", "run").groupBy("piece").applyInPandas(_merge, "k1 bigint, k2 bigint, start int, end int")
    loose = runs.where("h1 is not null")
    again = loose.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    spread = loose.join(again, ["h1", "h2"]).select("k1", "k2", F.col("at").cast("int").alias("start"), (F.col("at") + LENGTH).cast("int").alias("end"))
    spans = materialize(whole.unionByName(merged).unionByName(spread).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    kept = materialize(_texts_of(long, spans).select("k1", "k2", "body", "spans").mapInPandas(
        _keep, "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept string"))
    slim = rows.select("doc_id", "k1", "k2", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha"))
    out = slim.join(kept, ["k1", "k2"], "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
