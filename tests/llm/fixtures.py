"""Small tables with every awkward case, and helpers that the tests of the operators share."""

from __future__ import annotations

import random
import re

import duckdb

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    stems = ["river", "stone", "garden", "window", "letter", "morning", "winter", "market", "silver", "bridge",
             "forest", "engine", "harbour", "copper", "meadow", "signal", "castle", "pocket", "thunder", "island"]
    made = [rng.choice(stems) + rng.choice(["", "s", "ed", "ing", "ly", "er"]) + rng.choice(["", "a", "o", "um"])
            for _ in range(words)]
    return " ".join(w + ("." if k % 11 == 10 else "") for k, w in enumerate(made))


def awkward(spark):
    """NULLs in every column, empty and blank texts, a very long text, ties, repeated rows and clashing names."""
    long = prose(1, 30_000)
    shared = prose(2, 80)
    rows = [
        (1, prose(3, 120), "en", "a", 1), (2, prose(3, 120), "en", "a", 1), (3, "", "en", "a", 0), (4, None, None, None, None),
        (5, " \t\n\r\x0b\x0c ", "en", "a", 7), (6, long, "en", "a", 1), (7, long + " end", "en", "a", 1),
        (8, prose(4, 40) + " " + shared + " " + prose(5, 40), "en", "a", 1),
        (9, prose(6, 30) + " " + shared + " " + prose(7, 60), "en", "a", 1),
        (9, prose(6, 30) + " " + shared + " " + prose(7, 60), "en", "a", 1),  # a repeated row
        (10, "one", "en", "a", 1), (10, "two words", "en", "a", 1),  # one id, two texts
        (None, prose(3, 120), "en", "a", 1), (None, None, None, None, None),
        (11, "Größe é ́ 🙂   x \x1c y \u0000", "de", "a", 1), (12, prose(3, 119) + " changed", "en", "a", 1),
    ]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    clashes = ["score", "row", "bits", "component_id", "hash", "words", "shard", "pos", "label", "length", "piece",
               "_label", "row_key", "item_id", "pattern", "own", "held_out", "doc_key", "part", "ids"]
    for name in clashes:
        frame = frame.withColumn(name, frame["lang"])
    return frame


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


def texts_of(frame) -> list[tuple[int | None, str]]:
    return [(r["doc_id"], r["text"] or "") for r in frame.select("doc_id", "text").collect()]


def words_of(text: str) -> list[str]:
    return BLANK.findall(text)


def rows_of(frame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


def oracle(sql: str, sf: str = SF):
    db = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return db.execute(sql).df()
