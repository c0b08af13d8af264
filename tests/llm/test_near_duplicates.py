"""Fingerprints, links and components, and substring removal, against all-pairs versions."""

import hashlib

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from fieldtally.llm import simhash, substrings
from fieldtally.llm.queries import QUERIES
from fieldtally.llm.simhash import forest, links
from fieldtally.llm.substrings import SuffixAutomaton, run_hashes, spans
from tests.llm.fixtures import DOCUMENTS, SF, awkward, empty, prose, rows_of, texts_of, words_of


def plain_fingerprint(text: str) -> int:
    words = [w.encode().lower() for w in words_of(text)]
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels_of(close: np.ndarray) -> np.ndarray:
    label = np.arange(len(close))
    while True:
        new = np.array([label[row].min() for row in close])
        if (new == label).all():
            return label
        label = new


def plain_components(docs):
    marks = np.array([plain_fingerprint(t) for _, t in docs], np.uint64)
    label = labels_of(np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 3)
    least = {}
    for (doc_id, _), group in zip(docs, label):
        if doc_id is not None:
            least[group] = min(least.get(group, doc_id), doc_id)
    return [(d, f"{int(m):016x}", least.get(g)) for (d, _), m, g in zip(docs, marks, label)]


@pytest.mark.parametrize("n", [40, 700, 3500])
def test_tiles_find_the_components_of_all_pairs(n):
    rng = np.random.default_rng(n)
    bits = rng.integers(0, 2**63, n, dtype=np.uint64)
    for k in range(n // 2):  # chains of near copies
        flips = np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 63, 1 + k % 4))))
        bits[rng.integers(n)] = bits[rng.integers(n)] ^ flips
    bits = np.unique(bits)
    label = np.arange(len(bits))
    found = links(bits, None)
    label[found[:, 0]] = found[:, 1]
    expected = labels_of(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3)
    assert (label == expected).all()
    half = len(bits) // 2  # dealt into two blocks: within, within, across
    edges = np.concatenate([links(bits[:half], None), links(bits[half:], None) + half, links(bits[:half], bits[half:])])
    label = np.arange(len(bits))
    joined = forest(edges, len(bits))
    label[joined[:, 0]] = joined[:, 1]
    assert (label == expected).all()


def test_a_dense_group_is_joined_without_all_its_pairs():
    rng = np.random.default_rng(9)
    near = np.unique([sum(1 << int(b) for b in set(rng.integers(0, 24, 2))) for _ in range(5000)]).astype(np.uint64)
    far = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    bits = np.unique(np.concatenate([near, far]))
    found = links(bits, None)
    label = np.arange(len(bits))
    label[found[:, 0]] = found[:, 1]
    assert len(found) < len(bits) and (label == labels_of(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3)).all()


def test_star_rounds_join_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 501), (501, 500)]
    found = simhash.components(spark.createDataFrame(edges, "u long, v long"))
    expected = {n: 0 for n in range(61)} | {n: 100 for n in range(100, 300)} | {500: 500, 501: 500}
    assert dict(map(tuple, found.distinct().collect())) == expected


def test_simhash_query(spark):
    docs = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    got = rows_of(QUERIES["op4_simhash"](spark, SF), "doc_id", "fingerprint", "component_id")
    assert got == sorted(plain_components(docs), key=repr)


def test_simhash_awkward_and_small_blocks(spark, monkeypatch):
    docs = awkward(spark)
    expected = sorted(plain_components(texts_of(docs)), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == expected
    assert simhash.near_duplicates(empty(spark)).count() == 0
    classes = simhash.fingerprints(docs).select("bits").distinct()
    blocks = simhash.linked(classes.withColumn("least", classes["bits"]), block=3)  # many block pairs
    one = simhash.linked(classes.withColumn("least", classes["bits"]))
    assert sorted(map(tuple, simhash.components(blocks).collect())) == sorted(map(tuple, simhash.components(one).collect()))


def test_one_row_of_each_component_stays(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = plain_components(texts_of(docs))
    # the two texts of id 10 are two components of the same smallest id
    assert kept.count() == len({(component, mark if doc_id == 10 else "") for doc_id, mark, component in rows})
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*{c for *_, c in rows}, 10])
    plain = docs.where("doc_id NOT IN (9, 10)")
    assert sorted(r["doc_id"] for r in simhash.keep_one(plain).collect()) == sorted(
        {c for d, _, c in plain_components(texts_of(plain))}
    )


# -- substrings ---------------------------------------------------------------------------------
def plain_removal(docs, length=50):
    first = {}
    for doc_id, text in docs:
        words = words_of(text)
        for k in range(len(words) - length + 1):
            if doc_id is not None:
                run = tuple(words[k : k + length])
                first[run] = min(first.get(run, doc_id), doc_id)
    out = []
    for doc_id, text in docs:
        words = words_of(text)
        gone = [False] * len(words)
        for k in range(len(words) - length + 1):
            if doc_id is not None and first[tuple(words[k : k + length])] < doc_id:
                gone[k : k + length] = [True] * length
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_automaton_statistics():
    rng = np.random.default_rng(3)
    automaton, texts = SuffixAutomaton(), [rng.integers(0, 3, 30).tolist() for _ in range(4)]
    for text in texts:
        automaton.add(text)
    known = {tuple(t[i:j]) for t in texts for i in range(30) for j in range(i + 1, 31)}
    query = rng.integers(0, 3, 200).tolist()
    expected = [max((m for m in range(1, e + 1) if tuple(query[e - m : e]) in known), default=0) for e in range(1, 201)]
    assert automaton.matching_statistics(query) == expected
    assert spans([1, 2, 3, 1, 2, 3, 4], 3) == [(0, 7)] and spans([1, 2, 3, 1, 1, 2, 3], 3) == [(0, 3), (4, 7)]


def test_run_hashes_depend_on_the_run_only():
    words = np.arange(1, 40, dtype=np.uint64)
    both = np.concatenate([words, np.arange(90, 99, dtype=np.uint64), words])
    assert (run_hashes(both, 7)[:33] == run_hashes(words, 7)).all()
    assert (run_hashes(both, 7)[-33:] == run_hashes(words, 7)).all()
    assert len(np.unique(run_hashes(words, 7))) == 33


def test_substring_query(spark):
    docs = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    assert rows_of(QUERIES["op6_suffix_automata"](spark, SF), *COLUMNS) == plain_removal(docs)


def test_substring_awkward(spark, monkeypatch):
    docs = awkward(spark)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 60)
    monkeypatch.setattr(substrings, "TASK_WORDS", 100)
    assert rows_of(substrings.deduplicate(docs), *COLUMNS) == plain_removal(texts_of(docs))
    assert substrings.deduplicate(empty(spark)).count() == 0


def test_owners_of_one_window_in_other_contexts(spark):
    # a shares its anchor with b in another context; the window of c stands in b only
    base = prose(20, 60).split()
    rows = [(1, " ".join(base[:40] + prose(21, 40).split())), (2, " ".join(base)), (3, " ".join(prose(22, 9).split() + base[5:]))]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCUMENTS)
    assert rows_of(substrings.deduplicate(docs), *COLUMNS) == plain_removal(rows)
