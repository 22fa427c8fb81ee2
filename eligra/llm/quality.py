"""Quality classifier by gated attention over passages (multiple-instance learning from document labels)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligra.llm.common import batches, fold, labelled_sample, texts

WORDS = 64  #: words of a passage
GRAMS = 256  #: slots of hashed byte pairs
HIDDEN, GATE = 32, 16
#: Bytes encoded at a time; a longer text is encoded in parts, cut between passages.
PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
CLASSES = ("upper", "lower", "digit", "space", "symbol", "high")


def _classes() -> np.ndarray:
    table = np.full(256, 4, np.uint8)
    table[128:] = 5
    table[SPACE] = 3
    table[ord("0"):ord("9") + 1] = 2
    table[ord("a"):ord("z") + 1] = 1
    table[ord("A"):ord("Z") + 1] = 0
    return table


def passages(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text and where each passage of ``WORDS`` words starts; no word: one passage."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return raw, np.zeros(1, np.int64)
    space = SPACE[raw]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))[::WORDS]
    if len(start):
        start[0] = 0
    else:
        start = np.zeros(1, np.int64)
    return raw, start


def encode(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row for each passage: shares of byte pairs (hashed) and of character classes, and mean word length. No text of any other is used."""
    n = len(start)
    long = np.diff(np.append(start, len(raw)))
    at = np.repeat(np.arange(n, dtype=np.int64), long)
    kinds = _classes()[raw]
    out = np.zeros((n, GRAMS + len(CLASSES) + 2), np.float32)
    size = np.maximum(long, 1)[:, None].astype(np.float32)
    if len(raw) > 1:
        pair = (raw[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + raw[1:].astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(24)
        out[:, :GRAMS] = np.bincount(at[:-1] * GRAMS + pair, minlength=n * GRAMS).reshape(n, GRAMS) / size * 16
    share = np.bincount(at * 6 + kinds, minlength=n * 6).reshape(n, 6) / size if len(raw) else np.zeros((n, 6))
    out[:, GRAMS:GRAMS + 6] = share * 4
    out[:, -2] = 1 / (share[:, 3] * 10 + 0.1)
    out[:, -1] = 1.0
    return out


class Model:
    """tanh encoder, gated attention (tanh * sigmoid), logistic head."""

    def __init__(self, width: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)

        def start(*shape):
            return rng.normal(0, shape[0] ** -0.5, shape)

        self.p = {"E": start(width, HIDDEN), "V": start(HIDDEN, GATE), "U": start(HIDDEN, GATE), "w": start(GATE), "c": start(HIDDEN), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int):
        p = self.p
        h = np.tanh(x @ p["E"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, a)
        e = np.exp(a - top[bag])
        a = e / np.bincount(bag, e, n)[bag]
        z = np.stack([np.bincount(bag, a * h[:, k], n) for k in range(HIDDEN)], 1)
        return h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))

    def gradient(self, x, bag, y) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        h, t, g, a, z, s = self.forward(x, bag, n)
        d = (s - y) / n
        dz = d[:, None] * p["c"]
        da = (dz[bag] * h).sum(1)
        dscore = a * (da - np.bincount(bag, a * da, n)[bag])
        dtg = dscore[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ dscore, "c": z.T @ d, "b": np.array([d.sum()])}


def train(sample: list[tuple[str, int]], rounds: int = 300, rate: float = 0.01, decay: float = 1e-4) -> dict[str, np.ndarray]:
    """Adam over whole-sample gradients; classes weigh alike, however many rows each has."""
    if not sample:
        return Model(GRAMS + len(CLASSES) + 2).p
    encoded = [encode(*passages(t.encode("utf-8", "surrogatepass"))) for t, _ in sample]
    y = np.array([label for _, label in sample], float)
    model = Model(encoded[0].shape[1])
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.p.items()}
    rng = np.random.default_rng(11)
    sides = [np.flatnonzero(y == k) for k in (0, 1)]
    sides = [s for s in sides if len(s)]
    for step in range(1, rounds + 1):
        pick = np.concatenate([rng.choice(s, min(64, len(s)), replace=False) for s in sides])
        x = np.concatenate([encoded[i] for i in pick])
        bag = np.repeat(np.arange(len(pick)), [len(encoded[i]) for i in pick])
        for k, g in model.gradient(x, bag, y[pick]).items():
            m, v = moment[k]
            g = g + decay * model.p[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            model.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model.p


def score_texts(params: dict[str, np.ndarray], column: list[str]) -> np.ndarray:
    """Score of each text. Passages are folded in as they come: running maximum, weight and weighted representation of each text."""
    model = Model(1)
    model.p = params
    n = len(column)
    top, weight, z = np.full(n, -np.inf), np.zeros(n), np.zeros((n, HIDDEN))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def fold_in() -> None:
        x = np.concatenate([encode(r, s) for _, r, s in held])
        bag = np.repeat([i for i, _, _ in held], [len(s) for _, _, s in held])
        h = np.tanh(x @ params["E"])
        a = (np.tanh(h @ params["V"]) / (1 + np.exp(-(h @ params["U"])))) @ params["w"]
        old = top.copy()
        np.maximum.at(top, bag, a)
        scale = np.where(np.isneginf(old), 0.0, np.exp(old - top))
        e = np.exp(a - top[bag])
        weight[:] = weight * scale + np.bincount(bag, e, n)
        z[:] = z * scale[:, None] + np.stack([np.bincount(bag, e * h[:, k], n) for k in range(HIDDEN)], 1)

    for i, text in enumerate(column):
        raw, start = passages(text.encode("utf-8", "surrogatepass"))
        for low in range(0, len(start), PIECE // 256):
            part = start[low:low + PIECE // 256]
            end = start[low + len(part)] if low + len(part) < len(start) else len(raw)
            held.append((i, raw[part[0]:end], part - part[0]))
            size += end - part[0]
            if size > PIECE:
                fold_in()
                held, size = [], 0
    if held:
        fold_in()
    return 1 / (1 + np.exp(-np.clip((z / np.maximum(weight, 1e-300)[:, None]) @ params["c"] + params["b"], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, rows: int = 1500, chars: int = 20_000) -> dict[str, np.ndarray]:
    """Parameters learned from at most ``rows`` labelled documents of each class, of ``chars`` characters at most, outside the held-out fold."""
    slim = texts(docs, "doc_id", "text")
    return train(labelled_sample(slim, labels, "quality", fold(F.col("doc_id"), folds) != held_out, rows, chars))


def _scored(params):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in parts:
            yield pd.Series(np.concatenate([score_texts(params, part) for part in batches(column, 500)]) if len(column) else [], dtype="float64")

    return F.pandas_udf(run, "double")


def classify(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, threshold: float = 0.7, **bounds) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1, whole text), predicted (1 from ``threshold`` on).

    Null and empty texts are one passage without characters and get the score that follows from it. Null ids count as the empty
    text for the fold. Rows without a label are scored like all others; labels of documents that do not exist are ignored.
    Without any label the score is that of the untrained start. Other columns are not read. An empty table gives no rows.
    """
    run = _scored(fit(docs, labels, held_out, folds, **bounds))
    rows = texts(docs, "doc_id", "text")
    return rows.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), run("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns kept. Nothing is shuffled.

    A null text is scored as an empty one, whole texts are scored however long they are, repeated rows share their fate, and ids and other
    columns, whatever their names and nulls, play no part. An empty table gives no rows.
    """
    run = _scored(fit(docs, labels, **options))
    return docs.where(run(F.coalesce(docs["text"].cast("string"), F.lit(""))) >= threshold)
