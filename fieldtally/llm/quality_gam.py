"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes a few numbers. Each number is binned; the model is one lookup table per number and one per chosen
pair of numbers, learnt by cyclic boosting: the tables take turns, each turn fits a shallow tree over the table's
bins to the gradient and adds a little of it to the table. A score is the logistic of the sum of looked-up values.

The model is fitted on the driver from at most ``SAMPLE`` labelled rows (a few numbers each); tables and bin
edges, a few kilobytes, travel with the scoring function. Texts are scored in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import map_texts, text_facts, training_labels

SAMPLE = 20_000  # labelled rows that the model is fitted on, at most
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 150
RATE = 0.1
LEAVES = 4

NAMES = (
    "log_words", "word_length", "symbols", "upper", "shouts", "pipes", "duplicate_lines", "repeated_words",
    "distinct", "top_word", "digits", "stops", "commas", "longest", "bytes_per_char", "line_length",
)


def numbers(text: str) -> list[float]:
    """The model's inputs, in the order of ``NAMES``; an empty text gives zeros."""
    f = text_facts(text)
    words, chars, letters = max(f["n_words"], 1), max(f["word_chars"], 1), max(f["n_letters"], 1)
    return [
        float(np.log1p(f["n_words"])), f["word_chars"] / words, f["n_symbols"] / chars, f["n_upper"] / letters,
        f["n_shouts"] / words, f["n_pipes"] / words, f["n_dup_lines"] / max(f["n_lines"], 1),
        f["n_repeat_words"] / words, f["n_distinct"] / words, f["top_word"] / words, f["n_digits"] / chars,
        f["n_stops"] / words, f["n_commas"] / words, float(f["longest"]), f["n_bytes"] / max(len(text), 1),
        f["n_words"] / max(f["n_lines"], 1),
    ]


@dataclass
class Gam:
    """Bin edges, lookup tables and the intercept; without training rows it gives every text one half."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges and len(x):
            at = self.bins(x)
            for j, values in enumerate(self.tables):
                total += values[at[:, j]]
            coarse = at * PAIR_BINS // BINS
            for (i, j), values in zip(self.pairs, self.pair_tables):
                total += values[coarse[:, i], coarse[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Learn the tables; rows of one class only give the constant log-odds of a smoothed share."""
    model = Gam()
    if not len(y):
        return model
    share = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    model.tables = [np.zeros(BINS) for _ in model.edges]
    at, total = model.bins(x), np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, values in enumerate(model.tables):
            step = RATE * _tree(at[:, j], *_slopes(total, y))
            values += step
            total += step[at[:, j]]
    coarse = at * PAIR_BINS // BINS
    gradient, weight = _slopes(total, y)
    gains = {p: _pair_tree(coarse[:, p[0]], coarse[:, p[1]], gradient, weight)[1]
             for p in combinations(range(x.shape[1]), 2)}
    model.pairs = sorted(sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS])
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(ROUNDS // 2):
        for (i, j), values in zip(model.pairs, model.pair_tables):
            step = RATE * _pair_tree(coarse[:, i], coarse[:, j], *_slopes(total, y))[0]
            values += step
            total += step[coarse[:, i], coarse[:, j]]
    return model


def _slopes(total: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
    return y - p, p * (1 - p)


def _value(gradient, weight):
    return gradient / (weight + 1.0)


def _gain(gradient, weight):
    return gradient * gradient / (weight + 1.0)


def _tree(at: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The value of each bin under a tree of at most ``LEAVES`` leaves, grown by the best split."""
    g, h = np.bincount(at, gradient, BINS), np.bincount(at, weight, BINS)
    leaves = [(0, BINS)]
    while len(leaves) < LEAVES:
        best = (1e-6, None, None)
        for low, high in leaves:
            if high - low > 1:
                left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
                all_g, all_h = g[low:high].sum(), h[low:high].sum()
                gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
                cut = int(np.argmax(gains))
                if gains[cut] > best[0]:
                    best = (gains[cut], (low, high), low + cut + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    values = np.zeros(BINS)
    for low, high in leaves:
        values[low:high] = _value(g[low:high].sum(), h[low:high].sum())
    return values


def _pair_tree(a, b, gradient, weight) -> tuple[np.ndarray, float]:
    """The best tree with one cut on each axis: a value per cell, and its gain."""
    cell = a * PAIR_BINS + b
    g = np.bincount(cell, gradient, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    h = np.bincount(cell, weight, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarters = []
    for c in (cg, ch):
        rows, columns, total = c[:-1, -1][:, None], c[-1, :-1][None, :], c[-1, -1]
        q = c[:-1, :-1]
        quarters.append([q, rows - q, columns - q, total - rows - columns + q])
    gains = sum(_gain(x, y) for x, y in zip(*quarters))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    values = np.empty((PAIR_BINS, PAIR_BINS))
    leaf = [_value(x[i, j], y[i, j]) for x, y in zip(*quarters)]
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :] = leaf[0], leaf[1]
    values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = leaf[2], leaf[3]
    return values, float(gains[i, j])


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2,
    sample: int = SAMPLE,
) -> Gam:
    """Fit on the labelled texts whose crc32 remainder is not ``held_out``, at most ``sample`` of them.

    An id that stands in several rows is trained on once, with the smallest of its number rows. NULL and empty texts are texts without
    words; labels of ids that are not there are passed over; an empty table gives a model that scores every text alike.
    """
    chosen = training_labels(labels, label, modulus, held_out, sample)  # bounded by ``sample`` rows
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("label_id")
    ).select("doc_id", "text", F.col("label").alias("_label"))

    def rows(ids: list, texts: list[str], batch: dict) -> dict[str, list]:
        return {"doc_id": ids, "label": batch["_label"], "x": [numbers(t) for t in texts]}

    read = (
        map_texts(known, rows, "doc_id long, label int, x array<double>", "_label")
        .groupBy("doc_id").agg(F.min(F.struct("x", "label")).alias("row")).select("row.*")
        .toPandas()
    )
    rows = sorted(zip(map(tuple, read["x"]), read["label"].tolist()))  # the same order in every run
    x = np.array([r[0] for r in rows], float).reshape(len(rows), len(NAMES))
    return fit(x, np.array([r[1] for r in rows], float))


def score(docs: DataFrame, model: Gam, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every row, empty and NULL texts too.

    Repeated rows score alike, each in a row of its own, texts of any length are scored whole, and an empty table gives no rows.
    """

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        x = np.array([numbers(t) for t in texts], float).reshape(len(texts), len(NAMES))
        found = model.score(x)
        return {"doc_id": ids, "score": found.tolist(), "predicted": (found >= threshold).astype(int).tolist()}

    return map_texts(docs, rows, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: Gam, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns unchanged.

    A NULL text is judged as an empty one, repeated rows stay or go together, a score of exactly the threshold stays, and an empty
    table stays empty.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("boolean")
    def good(text):
        x = np.array([numbers(t or "") for t in text], float).reshape(len(text), len(NAMES))
        return type(text)(model.score(x) >= threshold)

    return docs.where(good(F.col("text").cast("string")))
