"""Toxic spans tagged by a linear-chain conditional random field; marginals make the document score."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligra.llm.common import batches, fold, labelled_sample, texts

TOKEN = re.compile(r"\w+")
SLOTS = 1 << 18
FEATURES = 7
#: Tokens tagged at a time: the chain of a batch of texts; a longer text is one chain of its own.
CHAIN = 150_000


def features(word: str) -> list[int]:
    """Slots of the word, its beginnings of 3 to 6 characters, its last 3 and the pair of first and last character."""
    parts = ["w" + word, "3" + word[:3], "4" + word[:4], "5" + word[:5], "6" + word[:6], "s" + word[-3:], "e" + word[:1] + word[-1:]]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "surrogatepass")) % SLOTS for p in parts]


def _words(text: str) -> list[str]:
    """Words in lower case, as many as in the text itself: if lowering the whole changes its length, each word is lowered alone."""
    low = text.lower()
    return TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in TOKEN.findall(text)]


def weak_labels(words: list[list[str]], toxic: np.ndarray, least: float = 20.0) -> list[np.ndarray]:
    """Token labels from document labels: in a toxic document, tokens of a word or beginning that stands in toxic documents far more often.

    The test is a log-likelihood ratio over documents; a clean document has no toxic token. Near copies count once: a document
    that shares one of its four smallest five-word hashes with an earlier one is left out of the statistics.
    """
    met: set[int] = set()
    alone = []
    for ws in words:
        five = sorted({xxhash.xxh64_intdigest(" ".join(ws[i:i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(ws) - 4))})[:4]
        alone.append(met.isdisjoint(five))
        met.update(five)
    kept = np.array(alone, bool)
    n1, n0 = max(1, int((toxic & kept).sum())), max(1, int((~toxic & kept).sum()))
    seen = (Counter(), Counter())
    keys: dict[str, tuple[str, ...]] = {}

    def of(w: str) -> tuple[str, ...]:
        k = keys.get(w)
        if k is None:
            k = keys[w] = ("w" + w, *(f"{n}{w[:n]}" for n in (4, 5, 6) if len(w) >= n))
        return k

    for ws, y, k in zip(words, toxic, kept):
        if not k:
            continue
        seen[int(y)].update({f for w in set(ws) for f in of(w)})
    bad = set()
    for k, a in seen[1].items():
        b = seen[0][k]
        if a >= 3 and a / n1 > 8 * (b + 0.5) / n0:
            p = (a + b) / (n1 + n0)
            ratio = 2 * (a * np.log(a / n1 / p) + (b * np.log(b / n0 / p) if b else 0.0))
            if ratio > least:
                bad.add(k)
    return [np.array([bool(y) and any(k in bad for k in of(w)) for w in ws], bool) for ws, y in zip(words, toxic)]


def marginals(emission: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(toxic) of each token, expected counts of the four transitions) of chains laid end to end by the forward-backward algorithm.

    ``first`` marks where a chain starts. A start has a transition that forgets what came before, so that all chains are one,
    cut into about sqrt(n) stretches: their 2 x 2 products come first, then the states between stretches, then all tokens.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    length = max(1, int(n ** 0.5))
    rows = -(-n // length)
    e = np.exp(np.clip(emission, -30, 30))
    m = np.empty((rows * length, 2, 2))
    m[:] = np.eye(2)
    a = np.exp(trans)
    m[:n, :, 0] = np.where(first[:, None], 1.0, a[:, 0][None])
    m[:n, :, 1] = np.where(first[:, None], 1.0, a[:, 1][None]) * e[:, None]
    m /= m.sum((1, 2), keepdims=True)
    m = m.reshape(rows, length, 2, 2)
    whole = m[:, 0].copy()
    for k in range(1, length):
        whole = whole @ m[:, k]
        whole /= whole.sum((1, 2), keepdims=True)
    before, after = np.empty((rows, 2)), np.empty((rows, 2))
    v = np.array([0.5, 0.5])
    for r in range(rows):
        before[r] = v
        v = v @ whole[r]
        v /= v.sum()
    v = np.array([0.5, 0.5])
    for r in range(rows - 1, -1, -1):
        after[r] = v
        v = whole[r] @ v
        v /= v.sum()
    f, b = np.empty((rows, length, 2)), np.empty((rows, length, 2))
    v = before
    for k in range(length):
        x = m[:, k]
        v = np.stack([v[:, 0] * x[:, 0, 0] + v[:, 1] * x[:, 1, 0], v[:, 0] * x[:, 0, 1] + v[:, 1] * x[:, 1, 1]], 1)
        v /= v.sum(1, keepdims=True)
        f[:, k] = v
    v = after
    for k in range(length - 1, -1, -1):
        b[:, k] = v
        x = m[:, k]
        v = np.stack([x[:, 0, 0] * v[:, 0] + x[:, 0, 1] * v[:, 1], x[:, 1, 0] * v[:, 0] + x[:, 1, 1] * v[:, 1]], 1)
        v /= v.sum(1, keepdims=True)
    f, b, m = f.reshape(-1, 2)[:n], b.reshape(-1, 2)[:n], m.reshape(-1, 2, 2)[:n]
    p = f[:, 1] * b[:, 1]
    p = p / (p + f[:, 0] * b[:, 0])
    inner = np.flatnonzero(~first)
    pair = f[inner - 1][:, :, None] * m[inner] * b[inner][:, None, :]
    return p, (pair / pair.sum((1, 2), keepdims=True)).sum(0)


def train(sample: list[tuple[str, int]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-5) -> dict:
    """Weights by Adam on the chains' log-likelihood, and the two numbers that turn marginals into a document score.

    Four fifths of the sample train the field, the last fifth sets the score.
    """
    model = {"w": np.zeros(SLOTS), "bias": -4.0, "trans": np.zeros((2, 2)), "cal": np.array([-3.0, 1.0, 0.0])}
    if not sample:
        return model
    words = [_words(t) for t, _ in sample]
    toxic = np.array([y == 1 for _, y in sample])
    fit = np.arange(len(sample)) % 5 != 4
    labels = weak_labels([w for w, k in zip(words, fit) if k], toxic[fit])
    slots: dict[str, list[int]] = {}

    def coded(ws: list[str]) -> np.ndarray:
        return np.array([slots.get(w) or slots.setdefault(w, features(w)) for w in ws], np.int32).reshape(-1, FEATURES)

    x = [coded(w) for w, k in zip(words, fit) if k]
    rng = np.random.default_rng(3)
    m, v = np.zeros(SLOTS + 5), np.zeros(SLOTS + 5)
    for step in range(1, rounds + 1):
        pick = [i for i in rng.choice(len(x), min(100, len(x)), replace=False) if len(x[i])]
        if not pick:
            continue
        xs, ys = np.concatenate([x[i] for i in pick]), np.concatenate([labels[i] for i in pick])
        first = np.zeros(len(ys), bool)
        first[np.cumsum([0] + [len(x[i]) for i in pick[:-1]])] = True
        p, pairs = marginals(model["w"][xs].sum(1) + model["bias"], first, model["trans"])
        inner = np.flatnonzero(~first)
        held = np.bincount(ys[inner - 1] * 2 + ys[inner], minlength=4).reshape(2, 2)
        off = (p - ys) / len(pick)
        g = np.concatenate([np.bincount(xs.ravel(), np.repeat(off, FEATURES), SLOTS), [off.sum()], ((pairs - held) / len(pick)).ravel()])
        g[:SLOTS] += decay * model["w"]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        model["w"] -= move[:SLOTS]
        model["bias"] -= float(move[SLOTS])
        model["trans"] -= move[SLOTS + 1:].reshape(2, 2)
    rest = [i for i in range(len(sample)) if not fit[i]] or list(range(len(sample)))
    got = np.array([_evidence(p) for p in _tag(model, [words[i] for i in rest])])
    y, c = toxic[rest].astype(float), model["cal"]
    for _ in range(2000):
        s = 1 / (1 + np.exp(-np.clip(c[0] + got @ c[1:], -30, 30)))
        c -= 0.1 * (np.array([(s - y).mean(), *((s - y)[:, None] * got).mean(0)]) + 1e-3 * np.array([0, c[1], c[2]]))
    return model


def _evidence(p: np.ndarray) -> tuple[float, float]:
    """Log odds of the likeliest token, bounded, and log of the expected number of toxic tokens."""
    top = float(p.max()) if len(p) else 0.0
    return max(-8.0, min(8.0, np.log((top + 1e-9) / (1 - top + 1e-9)))), float(np.log1p(p.sum()))


class Emissions(dict):
    """Weight of each word, worked out once."""

    def __init__(self, model: dict) -> None:
        super().__init__()
        self.w, self.bias = model["w"], model["bias"]

    def __missing__(self, word: str) -> float:
        s = self[word] = float(self.w[features(word)].sum()) + self.bias
        return s


def _tag(model: dict, words: list[list[str]], cache: Emissions | None = None) -> list[np.ndarray]:
    cache = Emissions(model) if cache is None else cache
    if len(cache) > 300_000:
        cache.clear()
    out: list[np.ndarray] = []
    held: list[list[str]] = []

    def run() -> None:
        ends = np.cumsum([len(ws) for ws in held])
        e = np.fromiter(map(cache.__getitem__, chain.from_iterable(held)), float, int(ends[-1]))
        first = np.zeros(len(e) + 1, bool)
        first[np.concatenate([[0], ends])] = True
        p, _ = marginals(e, first[:-1], model["trans"])
        out.extend(np.split(p, ends[:-1]))
        held.clear()

    size = 0
    for ws in words:
        held.append(ws)
        size += len(ws)
        if size > CHAIN:
            run()
            size = 0
    if held:
        run()
    return out


def _spans(text: str, p: np.ndarray) -> str:
    """Character offsets of runs of toxic tokens, 'start:end' joined by commas."""
    runs: list[list[int]] = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] >= 0.5:
            if i == last + 1 and runs:
                runs[-1][1] = m.end()
            else:
                runs.append([m.start(), m.end()])
            last = i
    return ",".join(f"{a}:{b}" for a, b in runs)


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, rows: int = 2000, chars: int = 20_000) -> dict:
    """The field learned from at most ``rows`` labelled documents of each class, of ``chars`` characters at most, outside the held-out fold."""
    return train(labelled_sample(texts(docs, "doc_id", "text"), labels, "toxic", fold(F.col("doc_id"), folds) != held_out, rows, chars))


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, threshold: float = 0.5, **bounds) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted, n_spans, spans (code point offsets of toxic runs).

    Null and empty texts, and those without a word, have no token and get the score of no evidence. Null ids count as the
    empty text for the fold. Documents without a label are scored like all others, labels without a document are ignored.
    Without any label every score is low. Other columns are not read. An empty table gives no rows.
    """
    model = fit(docs, labels, held_out, folds, **bounds)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = Emissions(model)
        c = model["cal"]
        for column in parts:
            rows = []
            for part in batches(column, 500):
                tagged = _tag(model, [_words(t) for t in part], cache)
                for t, p in zip(part, tagged):
                    got = _evidence(p)
                    s = 1 / (1 + np.exp(-np.clip(c[0] + c[1] * got[0] + c[2] * got[1], -30, 30)))
                    spans = _spans(t, p) if got[0] >= 0 else ""
                    rows.append((float(s), spans.count(":"), spans))
            yield pd.DataFrame(rows, columns=["score", "n_spans", "spans"])

    tag = F.pandas_udf(run, "score double, n_spans int, spans string")
    found = texts(docs, "doc_id", "text").select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), tag("text").alias("t"))
    return found.select("doc_id", "held_out", "t.score", (F.col("t.score") >= threshold).cast("int").alias("predicted"), "t.n_spans", "t.spans")
