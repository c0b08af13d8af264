"""Lexical search, conversation repair and cutting-stock packing against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldtally.llm import conversations, cutting_stock, lexical_search
from fieldtally.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import SF, awkward, empty, oracle, prose, texts_of

BYTE = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def same_as_sql(spark, name):
    frame, expected = QUERIES[name](spark, SF), oracle(ORACLES[name])
    columns = sorted(expected.columns)
    assert sorted(frame.columns) == columns
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert got == sorted((tuple(r) for r in expected[columns].astype(object).itertuples(index=False)), key=repr)


# ---------------------------------------------------------------- search


def plain_search(docs, items, top):
    terms = [(i, TERM.findall(t.translate(FOLD))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    total, count = sum(len(t) for _, t in terms), len(terms)
    df = Counter(w for _, t in terms for w in set(t))
    out = []
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(TERM.findall((text or "").translate(FOLD)))
    for item, words in wanted.items():
        scored = []
        for doc_id, t in terms:
            tf, m = Counter(t), 10 + (90 * len(t) * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 8 * m))
                        for w in words if tf[w])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def test_search_query(spark):
    same_as_sql(spark, "op11_lexical_search")


@pytest.mark.parametrize("block", [100_000, 8])
def test_search_awkward(spark, monkeypatch, block):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "CELLS", 300)
    words = prose(3, 25)
    items = [(1, words), (1, "Größe ONE"), (2, words + " x y"), (3, None), (4, ""), (None, "two words é"), (5, words.upper()), (5, words.upper()), (6, "...")]
    docs = awkward(spark)
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("score", lexical_search.F.lit("x"))
    found = [tuple(r) for r in lexical_search.search(docs, frame, 4).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(found, key=repr) == plain_search(texts_of(docs), items, 4)
    assert lexical_search.search(empty(spark), frame).count() == 0
    assert lexical_search.search(docs, frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_shared_sets_add_up_to_the_items(seed):
    rng = random.Random(seed)
    groups = [rng.sample(range(40), 6) for _ in range(4)]
    items = [frozenset(itertools.chain(rng.choice(groups), rng.choice(groups), rng.sample(range(40), 4))) for _ in range(15)]
    nodes, lists = lexical_search.share(items, 40)
    leaves: list[list[int]] = [[k] for k in range(40)]
    for left, right in nodes:
        assert max(left, right) < len(leaves)
        leaves.append(leaves[left] + leaves[right])
    assert [sorted(t for n in listed for t in leaves[n]) for listed in lists] == [sorted(i) for i in items]  # each term once
    assert len(nodes) + sum(max(len(x) - 1, 0) for x in lists) < sum(len(i) - 1 for i in items)  # fewer sums
    pairs = Counter(p for x in lists for p in itertools.combinations(x, 2))
    assert max(pairs.values(), default=0) < 2  # nothing is left to share


# ---------------------------------------------------------------- conversations

ROLES = ["system", "user", "assistant", "user", "assistant", "tool", ""]
LEGAL = re.compile("(s?(ua)+)?")


def plain_repair(rows):
    """Cheapest edits by trying all strings in order of cost (shortest path over (row, roles so far))."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, facts = set(), Counter()
    marks = []
    for _, role, text in rows:
        words = text.strip(" \t\n\r\x0b\x0c")
        kind = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        facts[kind] += 1
        marks.append(kind)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    best = {(0, ""): (0, "", [])}
    for n, (_, role, text) in enumerate(rows):
        grown = {}
        for (_, last), (cost, audit, lines) in list(inserted(best, n).items()):
            offers = [(last, cost + 4, audit + "D", lines)]
            if marks[n] in (None, "truncated"):
                more = 3 if marks[n] else 0
                for letter, new, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    if follows(last, new[:1]):
                        offers.append((new[:1], cost + price + more, audit + letter, [*lines, f"{new}:{text}"]))
            for to, *offer in offers:
                key = (n + 1, to)
                grown[key] = min(grown.get(key, (1 << 60,)), tuple(offer), key=lambda o: o[:2])
        best = grown
    final = [v for (_, last), v in inserted(best, len(rows)).items() if last in ("", "a")]
    cost, audit, lines = min(final, key=lambda o: o[:2]) if rows else (0, "", [])
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, facts["blank"], facts["duplicate"], facts["truncated"], illegal, cost, audit, sha


def follows(last, initial):
    return bool(initial) and last + initial in ("s", "u", "su", "ua", "au")


def inserted(best, n):
    out = dict(best)
    for _ in range(3):
        for (_, last), (cost, audit, lines) in list(out.items()):
            for role in ("user", "assistant"):
                if follows(last, role[0]):
                    offer = (cost + 3, audit + "I", [*lines, f"{role}:"])
                    out[n, role[0]] = min(out.get((n, role[0]), (1 << 60,)), offer, key=lambda o: o[:2])
    return out


def random_rows(seed, conversations_, most):
    rng = random.Random(seed)
    out = []
    for conv in [*range(conversations_), None]:
        for turn in range(rng.randint(0, most)):
            text = rng.choice(["", " \n", "Yes.", "No", "Why?", f"Line {rng.random()}.", f"line {rng.random()}", "é\x1c", "two\nlines."])
            out.append((conv, rng.choice([turn, turn + 1, turn + 40, None]), rng.choice(ROLES), text, rng.choice([1, 1, 1, 1, 2, 0])))
    return out


def expected_repairs(rows):
    held = defaultdict(list)
    for conv, turn, role, text, copies in rows:
        held[conv] += [(turn, role, text)] * copies
    return sorted(((c, *plain_repair(r)) for c, r in held.items()), key=repr)


@pytest.mark.parametrize("long_rows", [conversations.LONG_ROWS, 4])
def test_repair_of_random_conversations(spark, long_rows):
    rows = random_rows(5, 150, 14)
    frame = spark.createDataFrame(rows, conversations.DAMAGED).withColumn("part", conversations.F.lit("x")).repartition(7)
    got = conversations.repair(frame, long_rows)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_repairs(rows)
    laid = defaultdict(list)
    for r in sorted(conversations.repaired_rows(frame, long_rows).collect(), key=lambda r: (r["part"], r["place"])):
        laid[r["conv_id"]].append(r)
    audits = {r["conv_id"]: r["audit"] for r in got.collect()}
    for conv, lines in laid.items():
        assert LEGAL.fullmatch("".join(r["role"][0] for r in lines if r["role"] is not None))
        assert "".join(r["edits"] for r in lines) == audits[conv]


def test_repair_of_one_long_conversation(spark):
    """All rows under one NULL conv_id, and most of them equal."""
    rng = random.Random(8)
    rows = [(None, rng.choice([None, k // 3]), ROLES[k % 3], f"row {k % 90}" + rng.choice([".", ""]), 1) for k in range(700)]
    rows += [(None, 5, "user", "again.", 1)] * 600
    frame = spark.createDataFrame(rows, conversations.DAMAGED)
    got = [tuple(r) for r in conversations.repair(frame, 50).collect()]
    assert got == expected_repairs(rows) == [tuple(r) for r in conversations.repair(frame).collect()]


def test_repair_query(spark):
    same_as_sql(spark, "op12_conversation_repair")


def test_damage_and_awkward_conversations(spark):
    rows = [(c, t, "user", "Is it?! Yes.") for c in [1, None] for t in [*range(60), None]] + [(2, 0, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", conversations.F.lit("x"))
    damaged = conversations.damage(frame)
    for r in damaged.collect():
        kind = zlib.crc32(f"{' ' if r['conv_id'] is None else r['conv_id']}:{' ' if r['turn'] is None else r['turn']}".encode()) % 20
        assert r["copies"] == {0: 0, 3: 2}.get(kind, 1) and r["role"] and (kind != 1 or r["text"] == "")
        assert kind != 2 or r["text"] in ("Is it Yes", " ")
    found = conversations.repair(damaged)
    assert {r["conv_id"] for r in found.collect()} == {1, 2, None}
    gone = spark.createDataFrame([(7, None, "", "", 0)], conversations.DAMAGED)
    for long_rows in (100, 0):
        assert [tuple(r) for r in conversations.repair(gone, long_rows).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.repair(gone.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_least_paths_against_all_paths(seed):
    """Ranks by doubling against the least of all letter strings, on random graphs with several ends."""
    rng = random.Random(seed)
    n = 24
    arcs = np.full((n, 4), -1)
    for v in range(n - 3):
        for letter in rng.sample(range(4), rng.randint(1, 3)):
            arcs[v, letter] = rng.randint(v + 1, min(v + 5, n - 1))

    def least(v):
        return min(("DIKR"[x] + least(int(w)) for x, w in enumerate(arcs[v]) if w >= 0), default="")

    for v in range(n):
        _, letters = conversations.least_paths(arcs, np.array([v]))
        assert "".join("DIKR"[x] for x in letters) == least(v)
    rank, _ = conversations.ranks(arcs)
    if all((a >= 0).sum() <= 1 for a in arcs):
        assert [least(v) for v in np.argsort(rank, kind="stable")] == sorted(map(least, range(n)))


# ---------------------------------------------------------------- cutting stock


def check_cut(rows, docs, capacity=1024):
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.encode_special_tokens = True
    expected = Counter()
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected[doc_id, len(ids)] += len(ids)
    got, places = Counter(), defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["doc_tokens"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == expected
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= capacity and end & (end - 1) == 0  # a power of two is not padded
    return places


def test_cutting_query_keeps_every_id(spark):
    docs = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = QUERIES["op13_cutting_stock"](spark, SF).collect()
    check_cut(rows, docs)
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.encode_special_tokens = True
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in docs}
    end = Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == end[r["doc_id"]]
        end[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())


def test_cutting_awkward(spark):
    docs = awkward(spark)
    check_cut(cutting_stock.pack(docs, BYTE, 0).collect(), texts_of(docs))
    check_cut(cutting_stock.pack(docs, BYTE, 0, 64).collect(), texts_of(docs), 64)
    assert cutting_stock.pack(empty(spark), BYTE, 0).count() == 0


@pytest.mark.parametrize("n", [1, 3, 60, 2000])
@pytest.mark.parametrize("spread", [0.3, 1.2])
def test_patterns_hold_no_more_than_there_is(n, spread):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(4.5, spread, n).astype(int), 1, 256)
    histogram = dict(zip(*(a.tolist() for a in np.unique(lengths, return_counts=True))))
    used = Counter()
    for times, uses in cutting_stock.patterns(histogram, 256):
        total = sum(length * k for length, k in uses.items())
        assert times > 0 and total <= 256 and total & (total - 1) == 0
        used.update({length: times * k for length, k in uses.items()})
    assert all(used[length] <= histogram[length] for length in used)
    rows, sequences, over, line = cutting_stock.plan(histogram, 256)
    assert line == sum((histogram[length] - used[length]) * length for length in histogram)
    if n == 2000 and spread > 1:
        assert line < 0.03 * lengths.sum()  # nearly all stay whole


def test_program_reaches_the_optimum_of_small_cases():
    """Sixteen pieces of 6 and of 10 fill sequences of 16; with only pieces of 6 nothing fits and all stay over."""
    found = cutting_stock.solve([6, 10], [16, 16], 16)
    assert [(c.tolist(), round(t, 6)) for c, t in found] == [[[1.0, 1.0], 16.0]] or sum(t for _, t in found) == pytest.approx(16)
    assert cutting_stock.patterns({6: 5}, 16) == []
    assert cutting_stock.cuts(16 * 3 + 13, 16).tolist() == [56, 60, 61]
