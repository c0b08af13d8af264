"""Substring deduplication with suffix automata of reference shards.

A word goes if it lies in a window of ``length`` words whose word sequence also starts in a document with a smaller
doc_id. The reference of a corpus against itself is the corpus, which no broadcast holds, so it is first cut down to
what is needed, in steps that lose no window:

1. *Copies.* Documents with the same words are one; all but the first lose everything.
2. *Anchors.* In every window the run of ``GRAM`` words with the smallest hash is its anchor, at the same place
   wherever the window stands. Only windows whose anchor stands in two documents go on (about one anchor per 18 words
   is shuffled, instead of every window).
3. *Owners.* Of these windows the hash and the document are grouped; the smallest document is the window's owner.
4. *Shards.* Owners are dealt into shards of bounded size; an owner's windows that others share are its shard's
   reference. Runs of windows in other documents are streamed against the shard of their owner, equal runs once. A
   shard that many runs ask for is handed to as many tasks.
5. *Automata.* A task builds the suffix automaton of its shard and takes the matching statistics of each run: how
   many words before each place stand in the reference. Maximal spans of ``length`` words and more are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_digest

from fieldtally.llm.common import bounded_batches, by_keys, byte_words, map_texts, texts
from fieldtally.session import staged

LENGTH = 50
GRAM = 16
SHARD_WORDS = 200_000  # words of reference in one automaton, about
TASK_WORDS = 1_000_000  # words streamed against it in one task, about

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        with np.errstate(over="ignore"):
            held = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096), base)]), dtype=np.uint64)
        if n <= 1 << 20:
            _powers[int(base)] = held
    return held[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words that depends on the words only (a polynomial, mixed)."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * _power(BASE, len(hashes)), out=sums[1:])
        x = (sums[k:] - sums[:n]) * _power(BACK, n)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_anchors(hashes: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchor's hash of every window."""
    grams = run_hashes(hashes, gram)
    size = length - gram + 1
    if len(grams) < size:
        return np.zeros(0, np.uint64)
    return sliding_window_view(grams, size).min(1)


class SuffixAutomaton:
    """All runs of words of a reference, as the states of a suffix automaton."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[int]) -> None:
        """One more text of the reference; runs do not reach from one text into the next."""
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        moves, link, length = self.next, self.link, self.length
        known = moves[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._split(last, word, known)
        made, at = self._state(length[last] + 1, {}, 0), last
        while at >= 0 and word not in moves[at]:
            moves[at][word] = made
            at = link[at]
        if at >= 0:
            known = moves[at][word]
            link[made] = known if length[known] == length[at] + 1 else self._split(at, word, known)
        return made

    def _split(self, at: int, word: int, known: int) -> int:
        """A state for the shorter runs of ``known``, which also end elsewhere."""
        moves, link = self.next, self.link
        clone = self._state(self.length[at] + 1, dict(moves[known]), link[known])
        link[known] = clone
        while at >= 0 and moves[at].get(word) == known:
            moves[at][word] = clone
            at = link[at]
        return clone

    def matching_statistics(self, words: list[int]) -> list[int]:
        """For each place, the most words up to and with it that stand together in the reference."""
        moves, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for word in words:
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            if word in moves[state]:
                state = moves[state][word]
                matched += 1
            out.append(matched)
        return out


def spans(matched: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal spans (start, end) covered by matches of ``length`` words and more."""
    out: list[tuple[int, int]] = []
    for end, m in enumerate(matched, 1):
        if m >= length:
            start = end - m
            if out and start <= out[-1][1]:
                out[-1] = (min(out[-1][0], start), end)
            else:
                out.append((start, end))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows under a name of their content, so rows with one id and other texts are told apart."""
    return texts(docs).withColumn("row", F.xxhash64("doc_id", "text"))


def sketches(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """row, doc_id, n_words, the words' digests, and the anchors of every row."""
    schema = "row long, doc_id long, n_words long, content binary, whole binary, anchors array<long>"

    def rows(ids: list, bodies: list[str], batch: dict) -> dict[str, list]:
        out: dict[str, list] = {"n_words": [], "content": [], "whole": [], "anchors": []}
        for body in bodies:
            words = byte_words(body)
            joined = b" ".join(words)
            found = np.unique(window_anchors(word_hashes(words), length, gram))
            for column, value in zip(
                out.values(),
                (len(words), xxh128_digest(joined), hashlib.sha256(joined).digest(), found.view(np.int64)),
            ):
                column.append(value)
        return {"row": batch["row"], "doc_id": ids, **out}

    return map_texts(_keyed(docs), rows, schema, "row")


def _visited(docs: DataFrame, first: DataFrame) -> DataFrame:
    """row, doc_id, text and shared anchors of the documents that share an anchor with another one."""
    anchors = first.select("row", "doc_id", F.explode("anchors").alias("anchor"))
    # written before it is joined, here and below: a join of two plain shuffles is one whose hot keys can be split
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    shared = staged(shared.select("anchor"), "substring-shared")
    lists = staged(
        anchors.join(shared, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("shared")),
        "substring-anchors",
    )
    kept = by_keys(_keyed(docs), lists.select("row"), "row", "left_semi").dropDuplicates(["row"])
    return staged(kept.join(lists, "row"), "substring-visited")


def _windows(visited: DataFrame, length: int, gram: int) -> DataFrame:
    """hash, doc_id, row and place of every window with a shared anchor."""
    schema = "hash long, doc_id long, row long, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hashes = word_hashes(byte_words(r["text"]))
                shared = np.array(r["shared"], np.int64).view(np.uint64)
                at = np.nonzero(np.isin(window_anchors(hashes, length, gram), shared))[0]
                found = run_hashes(hashes, length)[at].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found), pa.array(np.full(len(at), r["doc_id"], np.int64)),
                     pa.array(np.full(len(at), r["row"], np.int64)), pa.array(at.astype(np.int32))],
                    names=["hash", "doc_id", "row", "pos"],
                )

    return visited.select("row", "doc_id", "text", "shared").mapInArrow(run, schema)


def _runs(visited: DataFrame, hits: DataFrame, length: int) -> DataFrame:
    """Maximal runs of windows of one owner: owner, row, start, words (hashes) and whether they are the owner's own."""
    schema = "owner long, row long, start int, n int, own boolean, words binary, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                hashes = word_hashes(byte_words(r["text"]))
                places = np.array([(h["pos"], h["owner"]) for h in r["hits"]], np.int64)
                places = places[np.argsort(places[:, 0], kind="stable")]
                cut = np.nonzero((np.diff(places[:, 0]) != 1) | (np.diff(places[:, 1]) != 0))[0] + 1
                parts = [p for p in np.split(places, cut) if len(p)]
                words = [hashes[p[0, 0] : p[-1, 0] + length].tobytes() for p in parts]
                owners = [int(p[0, 1]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(owners, pa.int64()), pa.array([r["row"]] * len(parts), pa.int64()),
                        pa.array([int(p[0, 0]) for p in parts], pa.int32()),
                        pa.array([len(w) // 8 for w in words], pa.int32()),
                        pa.array([o == r["doc_id"] for o in owners], pa.bool_()),
                        pa.array(words, pa.binary()), pa.array([xxh128_digest(w) for w in words], pa.binary()),
                    ],
                    names=["owner", "row", "start", "n", "own", "words", "content"],
                )

    joined = visited.select("row", "doc_id", "text").join(hits, "row")
    return staged(joined.mapInArrow(run, schema), "substring-runs")


def _matched(runs: DataFrame, length: int) -> DataFrame:
    """shard, content and spans (within the run) of every different run that the reference of its owner covers."""
    words = runs.where("own").agg(F.sum("n")).first()[0] or 0
    shard = F.pmod(F.xxhash64("owner"), F.lit(max(-(-int(words) // SHARD_WORDS), 1))).cast("int")
    dealt = runs.withColumn("shard", shard)
    asked = dealt.where("not own").dropDuplicates(["shard", "content"]).select("shard", "content", "words", "n")
    tasks = asked.groupBy("shard").agg(F.ceil(F.sum("n") / TASK_WORDS).cast("int").alias("tasks"))
    asked = asked.join(tasks, "shard").withColumn(
        "task", F.pmod(F.xxhash64("content"), F.col("tasks")).cast("int")
    )
    held = dealt.where("own").dropDuplicates(["shard", "content"]).select("shard", "words").join(tasks, "shard")
    held = held.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).select(
        F.col("shard").alias("of_shard"), F.col("task").alias("of_task"), F.col("words").alias("reference")
    )

    def match(reference: pd.DataFrame, streamed: pd.DataFrame) -> pd.DataFrame:
        automaton = SuffixAutomaton()
        for text in reference["reference"]:
            automaton.add(np.frombuffer(text, np.uint64).tolist())
        found = [
            spans(automaton.matching_statistics(np.frombuffer(text, np.uint64).tolist()), length)
            for text in streamed["words"]
        ]
        return pd.DataFrame({
            "shard": streamed["shard"], "content": streamed["content"],
            "starts": pd.Series([[a for a, _ in f] for f in found], streamed.index, object),
            "ends": pd.Series([[b for _, b in f] for f in found], streamed.index, object),
        })

    schema = "shard int, content binary, starts array<int>, ends array<int>"
    verdicts = (
        held.groupBy("of_shard", "of_task").cogroup(asked.groupBy("shard", "task")).applyInPandas(match, schema)
    )
    return dealt.where("not own").select("row", "start", "shard", "content").join(
        verdicts.where(F.size("starts") > 0), ["shard", "content"]
    ).groupBy("row").agg(F.collect_list(F.struct("start", "starts", "ends")).alias("found"))


def _without(visited: DataFrame, found: DataFrame) -> DataFrame:
    """row, n_removed and the digest of what is kept, of every row that loses words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                words = byte_words(r["text"])
                gone = np.zeros(len(words), bool)
                for f in r["found"]:
                    for a, b in zip(f["starts"], f["ends"]):
                        gone[f["start"] + a : f["start"] + b] = True
                kept = b" ".join(words[i] for i in np.nonzero(~gone)[0])
                out.append((r["row"], int(gone.sum()), hashlib.sha256(kept).digest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                 pa.array([o[2] for o in out], pa.binary())],
                names=["row", "gone", "left"],
            )

    return visited.select("row", "text").join(found, "row").mapInArrow(run, "row long, gone long, left binary")


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``.

    NULL texts have no words. Rows without a doc_id are neither smaller nor larger than others: they lose nothing and
    nobody loses words for them. Rows with the same doc_id lose nothing for each other; repeated rows are judged alike.
    Texts under ``length`` words lose nothing; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    all_rows = staged(sketches(docs, length, gram), "substring-sketches")
    named = all_rows.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= length))
    first = staged(named.groupBy("content").agg(F.min("doc_id").alias("first")), "substring-first")
    marked = named.select("row", "doc_id", "content").distinct().join(first, "content")
    copies = marked.where("doc_id > first").select("row", F.lit(True).alias("copy"))
    originals = named.dropDuplicates(["row"]).join(marked.where("doc_id = first").select("row"), "row")
    visited = _visited(docs, originals)
    windows = _windows(visited, length, gram)
    owners = windows.groupBy("hash").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    owners = staged(owners.where("owner < last").select("hash", "owner"), "substring-owners")
    owned = windows.join(owners, "hash")
    hits = owned.groupBy("row").agg(F.collect_list(F.struct("pos", "owner")).alias("hits"))
    lost = _without(visited, _matched(_runs(visited, hits, length), length))
    nothing = F.lit(hashlib.sha256(b"").digest())
    judged = (
        all_rows.drop("anchors", "content").join(copies.distinct(), "row", "left").join(lost, "row", "left")
    )
    return judged.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(F.col("copy"), nothing).otherwise(F.coalesce("left", "whole")))).alias("kept_sha256"),
    )
