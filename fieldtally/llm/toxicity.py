"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

*Language model.* Counts of four neighbouring characters over every document, summed by Spark (at most 28^4 rows).

*Channel.* A disguised stretch is a lattice of characters: a symbol stands for one of its letters or is noise, a digit
for one of its letters or itself, a run of three or more equal letters or symbols for one or two, a separator between
single letters for nothing or a blank. Viterbi finds the likeliest path under the language model, in time linear in
the stretch. Stretches with one path only, nearly all of a text, need no decoding; numpy finds the texts with others: a
symbol beside a letter or digit, three equal letters, three single characters in a row.

*Score.* Words that mark toxic training texts get log-odds weights; a logistic model maps what a text has of them to
a probability. Words count in their written and in their restored form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import map_texts, texts, training_labels
from fieldtally.session import staged

SAMPLE = 20_000  # labelled texts that weights are learnt from, at most
LEXICON = 2_000  # weighted words, at most
LEAST_TEXTS = 3  # training texts that a weighted word stands in
LEAST_G2 = 20.0  # evidence against chance that a weighted word needs
NOISE = -9.0  # log-probability of a symbol that stands for nothing, of a digit among letters that is one, of a letter in a number

# Letters that a symbol may stand for.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
SIZE = 28  # character classes: 0 what is no letter, 1-26 a-z, 27 further letters
CLASS = np.zeros(256, np.uint8)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = 27
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in LEET]] = True
BLANK_OUT = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
DECORATION = re.compile(rb"([*%&#])\1{2,}")
_LETTER = rb"[a-z]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3}"
STRETCH = re.compile(  # a whole word with a symbol or three equal letters; each word is tried once, from its start
    rb"(?<![a-z0-9@$!|+\x80-\xff])(?:(%b)(?!\1\1))*+(?:[0-9@$!|+]|(%b)\2\2)[a-z0-9@$!|+\x80-\xff]*" % (_LETTER, _LETTER)
)
ALNUM = re.compile(rb"[a-z0-9\x80-\xff]")
LETTERS = re.compile(rb"(%b)\1\1" % _LETTER)
SPACED = re.compile(rb"(?<![a-z0-9\x80-\xff])[a-z0-9@$!|+](?:[ ._*-][a-z0-9@$!|+]){2,}(?![a-z0-9\x80-\xff])")
RUNS = re.compile(r"(.)\1*")


def character_counts(docs: DataFrame) -> np.ndarray:
    """How often each four character classes follow each other, over all documents (a table of four dimensions)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**4, np.int64)
        for batch in batches:
            bodies = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            c = CLASS[np.frombuffer(b"\n\n\n" + b"\n\n\n".join(bodies) + b"\n\n\n", np.uint8)].astype(np.int32)
            total += np.bincount(((c[:-3] * SIZE + c[1:-2]) * SIZE + c[2:-1]) * SIZE + c[3:], minlength=SIZE**4)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_pydict({"code": pa.array(seen, pa.int32()), "n": pa.array(total[seen])})

    rows = texts(docs).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(SIZE**4, np.int64)
    table[rows["code"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)  # at most 28^4 rows
    return table.reshape((SIZE,) * 4)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(fourth | first three), smoothed with the shares given fewer characters."""
    shares = np.full(SIZE, 1 / SIZE)
    for known in range(4):
        seen = counts.sum(tuple(range(3 - known)))
        shares = (seen + 10 * shares) / (seen.sum(-1, keepdims=True) + 10)
    return np.log(shares).astype(np.float32)


def _class(char: str) -> int:
    return int(CLASS[ord(char)]) if ord(char) < 128 else 27


def lattice(stretch: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """The readings of each run of equal characters, with the channel's log-probability."""
    units = []
    worded = any(c.isalpha() for c in stretch)  # else a number or price: there a letter is what hardly occurs
    letter, noise = (0.0, NOISE) if worded else (NOISE, 0.0)
    for run in RUNS.finditer(stretch):
        char, k = run[1], len(run[0])
        if char in LEET:
            other = [(char if char.isdigit() else "", noise)]
            if k <= 2 and not (char == "!" and run.end() == len(stretch)):
                units += [[(c, letter) for c in LEET[char]] + other] * k
                continue
            readings = [("".join(c), letter) for c in product(LEET[char], repeat=min(k, 2))]
            if k > 2:
                readings += [(c, letter) for c in LEET[char]]
            if char.isdigit():
                readings.append((run[0], noise))
            elif char == "!" and run.end() == len(stretch):
                readings.append(("", 0.0))  # a mark
            else:
                readings += [("", noise), (" ", noise)]
            units.append(readings)
        elif spaced and char in " ._*-":
            units.append([("", 0.0), (" ", 0.0)])
        elif k > 2 and char.isalpha():
            units.append([(char, 0.0), (char * 2, 0.0)])
        else:
            units.append([(run[0], 0.0)])
    return units


def decode(stretch: str, model: np.ndarray, spaced: bool = False) -> str:
    """The likeliest reading of a stretch under channel and language model (Viterbi over the last three classes).

    A path is its last reading and the path before it; of equally likely ones the first stands.
    """
    flat, last = memoryview(np.ascontiguousarray(model).reshape(-1)), SIZE**3
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for readings in lattice(stretch, spaced):
        coded = [(letters, cost, [_class(c) for c in letters]) for letters, cost in readings]
        after: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, path) in states.items():
            for letters, cost, classes in coded:
                at, total = state, score + cost
                for c in classes:
                    at = at * SIZE + c
                    total += flat[at]
                    at %= last
                if at not in after or total > after[at][0]:
                    after[at] = (total, (letters, path))
        states = after
    path = max(((score + flat[at * SIZE], path) for at, (score, path) in states.items()), key=lambda x: x[0])[1]
    parts = []
    while path:
        parts.append(path[0])
        path = path[1]
    return "".join(reversed(parts))


class Restorer:
    """Words of a text in written and restored form; decoded stretches are remembered up to a bound."""

    def __init__(self, model: np.ndarray, bound: int = 100_000):
        self.model, self.bound, self.known = model, bound, {}

    def words(self, text: str) -> set[bytes]:
        body = text.encode("utf-8", "surrogatepass").lower()
        found = set(body.translate(BLANK_OUT).split())
        if self._disguised(body):
            found.update(self._restored(body).translate(BLANK_OUT).split())
        return found

    @staticmethod
    def _disguised(body: bytes) -> bool:
        raw = np.frombuffer(body, np.uint8)
        if len(raw) < 2:
            return False
        letter, symbol = CLASS[raw] > 0, SYMBOL[raw]
        word = letter | symbol | DIGIT[raw]
        plain = letter | DIGIT[raw]
        if (symbol[:-1] & plain[1:]).any() or (plain[:-1] & symbol[1:]).any():
            return True
        if LETTERS.search(body) if letter[raw >= 128].any() else (
            letter[2:] & (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2])
        ).any():
            return True
        alone = word & ~np.append(word[1:], False) & ~np.insert(word[:-1], 0, False)
        return bool((alone[4:] & alone[2:-2] & alone[:-4]).any()) if len(raw) > 4 else False

    def _restored(self, body: bytes) -> bytes:
        body = DECORATION.sub(b" ", body)
        body = SPACED.sub(lambda m: self._reading(m[0], True), body)
        return STRETCH.sub(lambda m: self._reading(m[0], False) if ALNUM.search(m[0]) else m[0], body)

    def _reading(self, stretch: bytes, spaced: bool) -> bytes:
        key = (stretch, spaced)
        if key not in self.known:
            if len(self.known) >= self.bound:
                self.known.clear()
            text = stretch.decode("utf-8", "surrogatepass")
            self.known[key] = decode(text, self.model, spaced).encode("utf-8", "surrogatepass")
        return self.known[key]


@dataclass
class Toxicity:
    """Language model, weighted words and the logistic map; without training texts it gives every text ``share``."""

    model: np.ndarray
    weights: dict[bytes, float] = field(default_factory=dict)
    slope: np.ndarray = field(default_factory=lambda: np.zeros(3))
    intercept: float = 0.0

    def inputs(self, words: set[bytes]) -> list[float]:
        hits = [self.weights[w] for w in (words & self.weights.keys() if self.weights else ())]
        return summary(hits)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.slope + self.intercept, -30, 30)))


def summary(hits: list[float]) -> list[float]:
    """Strongest word, number of words and their weights' root: what the logistic map sees of a text."""
    return [max(hits, default=0.0), float(np.log1p(len(hits))), float(np.sqrt(sum(hits)))]


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1,
    sample: int = SAMPLE,
) -> Toxicity:
    """Learn the language model from all texts, weights from labelled texts whose remainder is not ``held_out``.

    Texts of the same words and label count once, or the words of a much-copied text would all look telling. NULL and empty texts
    have no word; words of equal weight are kept in their order; without a label (or with an empty table) every text scores alike.
    """
    found = Toxicity(log_model(character_counts(docs)))
    chosen = training_labels(labels, label, modulus, held_out, sample)  # bounded by ``sample`` rows
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("label_id")
    ).select("doc_id", "text", F.col("label").alias("_label"))
    held: dict[str, Restorer] = {}

    def rows(ids: list, bodies: list[str], batch: dict) -> dict[str, list]:
        restorer = held.setdefault("r", Restorer(found.model))
        words = [sorted(w.decode("utf-8", "replace") for w in restorer.words(t)) for t in bodies]
        return {"doc_id": ids, "label": batch["_label"], "words": words}

    read = staged(
        map_texts(known, rows, "doc_id long, label int, words array<string>", "_label").withColumn(
            "row", F.xxhash64("words")
        ).dropDuplicates(["row", "label"]),
        "toxicity-words",
    )
    sizes = {r["label"]: r["n"] for r in read.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    found.intercept = float(np.log((toxic + 1) / (clean + 1)))
    if not toxic or not clean:
        return found
    found.weights = _lexicon(read, toxic, clean)
    _fit(found, read)
    return found


def _lexicon(read: DataFrame, toxic: int, clean: int) -> dict[bytes, float]:
    """Words with more than chance in toxic texts: the ``LEXICON`` of most evidence, with their log-odds."""
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = (a + b) / (toxic + clean)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    g2 = 2 * (
        part(a, share * toxic) + part(b, share * clean)
        + part(toxic - a, (1 - share) * toxic) + part(clean - b, (1 - share) * clean)
    )
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    counted = (
        read.select("label", F.explode("words").alias("word")).groupBy("word")
        .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        .where((F.col("a") >= LEAST_TEXTS) & (F.col("a") * clean > F.col("b") * toxic))
        .select("word", odds.alias("weight"), g2.alias("g2")).where(F.col("g2") >= LEAST_G2)
        .orderBy(F.desc("g2"), "word").limit(LEXICON)
    )
    return {r["word"].encode(): r["weight"] for r in counted.collect()}  # at most ``LEXICON`` rows


def _fit(found: Toxicity, read: DataFrame) -> None:
    """Logistic map over the training texts' summaries, by Newton steps."""
    spark = read.sparkSession
    known = spark.createDataFrame([(w.decode(), v) for w, v in found.weights.items()], "word string, weight double")
    hits = (
        read.select("row", "label", F.explode("words").alias("word")).join(F.broadcast(known), "word")
        .groupBy("row", "label").agg(F.sort_array(F.collect_list("weight")).alias("hits"))
    )
    with_hits = [(r["label"], r["hits"]) for r in hits.orderBy("row", "label").collect()]  # at most a row per sample text
    total = {r["label"]: r["n"] for r in read.groupBy("label").agg(F.countDistinct("row").alias("n")).collect()}
    for label, n in total.items():
        with_hits += [(label, [])] * (n - sum(1 for y, h in with_hits if y == label and h))
    x = np.array([[*summary(h), 1.0] for _, h in with_hits])
    y = np.array([label for label, _ in with_hits], float)
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([0.1, 0.1, 0.1, 1e-6])
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    found.slope, found.intercept = beta[:3], float(beta[3])


def score(docs: DataFrame, model: Toxicity, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted (1 from ``threshold`` on) of every row, empty and NULL texts too.

    Repeated rows score alike, each in a row of its own, texts of any length are scored whole, and an empty table gives no rows.
    """
    held: dict[str, Restorer] = {}

    def rows(ids: list, bodies: list[str]) -> dict[str, list]:
        restorer = held.setdefault("r", Restorer(model.model))
        x = np.array([model.inputs(restorer.words(t)) for t in bodies]).reshape(len(bodies), 3)
        found = model.score(x)
        return {"doc_id": ids, "score": found.tolist(), "predicted": (found >= threshold).astype(int).tolist()}

    return map_texts(docs, rows, "doc_id long, score double, predicted int")
