"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule votes good (1), bad (-1) or abstains (0) on a text. Nobody knows the truth; rules that agree with the
others beyond chance earn weight. The state of the estimation is two accuracies per rule (how often its vote is right on
good and on bad texts; a rule may know one kind of junk and say nothing against the others) and the share of good
texts. Its input is how often each pattern of votes occurs, at most 3^11 rows however many documents there are, so
it sees every document. A text is kept if the posterior probability that it is good reaches ``KEEP``, instead of
having to pass every rule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import map_texts, text_facts
from fieldtally.session import staged

KEEP = 0.5
FIRST = (0.999, 0.4)  # accuracies on good and on bad texts to start from
FIRST_SHARE = 0.85
BOUNDS = ((0.5, 0.9999), (0.01, 0.9999))  # of the accuracies
PRIOR = 20  # votes that the accuracies to start from count as: they steady a rule that hardly votes
ROUNDS = 200

# A rule: name, value of the facts, good up to or from, bad beyond; between them it abstains.
RULES = (
    ("symbols", lambda f: f["n_symbols"] / max(f["n_words"], 1), 0.1, 0.5),
    ("shouts", lambda f: f["n_shouts"] / max(f["n_words"], 1), 0.05, 0.3),
    ("pipes", lambda f: f["n_pipes"] / max(f["n_words"], 1), 0.02, 0.15),
    ("upper", lambda f: f["n_upper"] / max(f["n_letters"], 1), 0.2, 0.4),
    ("repeats", lambda f: f["n_repeat_words"] / max(f["n_words"], 1), 0.15, 0.4),
    ("lines", lambda f: f["n_dup_lines"] / max(f["n_lines"], 1), 0.15, 0.5),
    ("top_word", lambda f: f["top_word"] / max(f["n_words"], 1), 0.12, 0.25),
    ("word_length", lambda f: abs(f["word_chars"] / max(f["n_words"], 1) - 6), 2.5, 5.0),
    ("letters", lambda f: 1 - f["n_letterlike"] / max(f["word_chars"], 1), 0.2, 0.3),
    ("digits", lambda f: f["n_digits"] / max(f["word_chars"], 1), 0.05, 0.25),
    ("sentences", lambda f: abs(np.log((f["n_stops"] + 0.5) / (f["n_words"] + 1) * 12)), 1.2, 2.5),
)
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, pattern int"


def votes(facts: dict[str, float]) -> list[int]:
    """A vote per rule; a text without a word gets none."""
    if not facts["n_words"]:
        return [0] * len(RULES)
    values = [rule[1](facts) for rule in RULES]
    return [1 if v <= good else -1 if v > bad else 0 for v, (_, _, good, bad) in zip(values, RULES)]


def pattern(ballot: list[int]) -> int:
    """The votes as one number to base three."""
    return sum((v + 1) * 3**k for k, v in enumerate(ballot))


def ballots(patterns: np.ndarray, rules: int = len(RULES)) -> np.ndarray:
    return np.stack([patterns // 3**k % 3 - 1 for k in range(rules)], 1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rules: int = len(RULES)) -> tuple[np.ndarray, float]:
    """(accuracies of each rule on good and on bad texts, share of good texts) by expectation-maximisation."""
    v, share = ballots(patterns, rules), FIRST_SHARE
    accuracy = np.tile(np.array(FIRST)[:, None], (1, rules))
    for _ in range(ROUNDS):
        good = posterior(v, accuracy, share)
        before = accuracy
        found = []
        for weight, right, first, bounds in zip((good * counts, (1 - good) * counts), (1, -1), FIRST, BOUNDS):
            voted, correct = weight @ (v != 0), weight @ (v == right)
            found.append(np.clip((correct + PRIOR * first) / (voted + PRIOR), *bounds))
        accuracy = np.array(found)
        share = float(np.clip((good @ counts + 1) / (counts.sum() + 2), 0.01, 0.99))
        if np.abs(accuracy - before).max() < 1e-9:
            break
    return accuracy, share


def posterior(v: np.ndarray, accuracy: np.ndarray, share: float) -> np.ndarray:
    """Probability that a text with these votes is good."""
    on_good, on_bad = accuracy
    odds = np.full(len(v), np.log(share / (1 - share)))
    odds += (v == 1) @ np.log(on_good / (1 - on_bad)) + (v == -1) @ np.log((1 - on_good) / on_bad)
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def base_facts(docs: DataFrame) -> DataFrame:
    """The base counts of every row and its vote pattern, in one pass over the texts."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        facts = [text_facts(t) for t in texts]
        return {"doc_id": ids, "pattern": [pattern(votes(f)) for f in facts]} | {
            n: [f[n] for f in facts] for n in names
        }

    return map_texts(docs, rows, BASE)


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, posterior and kept of every row.

    A NULL or empty text has no word, so it fails the base rules. The estimation needs no labels. Repeated rows count
    as often as they stand; an empty table gives no rows.
    """
    spark = docs.sparkSession
    facts = staged(base_facts(docs), "rule-facts")
    seen = facts.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toPandas()  # 3^rules rows at most
    patterns, counts = seen["pattern"].to_numpy(np.int64), seen["n"].to_numpy(float)
    if len(patterns):
        good = posterior(ballots(patterns), *estimate(patterns, counts))
    else:
        good = np.zeros(0)
    known = spark.createDataFrame(
        list(zip(patterns.tolist(), good.tolist())), "pattern int, posterior double"
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        facts.join(F.broadcast(known), "pattern")
        .withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= keep))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            F.round("posterior", 6).alias("posterior"),
        )
    )
