"""Fitted operators: held-out accuracy, bounds, and awkward rows; base counts against plain versions."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest

from fieldtally.llm import quality_gam, rules, toxicity
from fieldtally.llm.common import repeated_words, text_facts
from fieldtally.llm.queries import QUERIES
from tests.llm.fixtures import DOCUMENTS, SF, awkward, empty, prose, rows_of, texts_of, words_of

SF_LARGER = "/root/testdata/sf0.01"


def corpus(spark, spoil, field):
    """400 texts, a third of them spoilt, and their labels; ids 0-399."""
    rng = random.Random(5)
    bad = [rng.random() < 0.33 for _ in range(400)]
    rows = [(i, spoil(prose(i, 60 + i % 90), rng) if b else prose(i, 60 + i % 90), "en", "s", 1) for i, b in enumerate(bad)]
    labels = [(i, int(b) if field == "toxic" else int(not b)) for i, b in enumerate(bad)]
    labels += [(7777, 1), (None, 1), (3, None)]
    return spark.createDataFrame(rows, DOCUMENTS), spark.createDataFrame(labels, f"doc_id long, {field} int"), dict(labels[:400])


def held(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


# -- quality ----------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark, lambda t, r: " ".join(w + "***" for w in t.split()), "quality")
    scored = {r["doc_id"]: r for r in quality_gam.score(docs, quality_gam.train(docs, labels)).collect()}
    judged = [scored[i]["predicted"] == y for i, y in truth.items() if held(i, 4, 2)]
    assert len(judged) > 50 and np.mean(judged) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in scored.values())


def test_held_out_labels_do_not_matter(spark):
    docs, labels, truth = corpus(spark, lambda t, r: t.upper(), "quality")
    turned = spark.createDataFrame(
        [(i, 1 - y if held(i, 4, 2) else y) for i, y in truth.items()], "doc_id long, quality int"
    )
    for one, two in zip(quality_gam.train(docs, labels).tables, quality_gam.train(docs, turned).tables):
        assert np.array_equal(one, two)


def test_additive_scores_are_sums_of_bins():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)  # no single number tells, a pair does
    model = quality_gam.fit(x, y)
    assert (0, 1) in model.pairs and np.mean((model.score(x) > 0.5) == y) > 0.9
    at = model.bins(x[:5])
    by_hand = [model.intercept + sum(t[at[k, j]] for j, t in enumerate(model.tables)) + sum(
        t[at[k, i] * 8 // 32, at[k, j] * 8 // 32] for (i, j), t in zip(model.pairs, model.pair_tables)) for k in range(5)]
    assert np.allclose(model.raw(x[:5]), by_hand)


def test_quality_query_and_awkward(spark):
    got = QUERIES["op10_quality_gam"](spark, SF_LARGER).toPandas()
    assert len(got) == 1000 and got["held_out"].tolist() == [held(i, 4, 2) for i in got["doc_id"]]
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id").query("held_out")
    assert (both["predicted"] == both["quality"]).mean() > 0.9
    docs, labels, _ = corpus(spark, lambda t, r: t.upper(), "quality")
    model = quality_gam.train(docs, labels)
    rows = quality_gam.score(awkward(spark), model).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality_gam.keep_good(awkward(spark), model)
    assert kept.columns == awkward(spark).columns
    assert kept.count() == sum(r["predicted"] for r in rows)
    assert quality_gam.score(empty(spark), model).count() == 0
    nothing = quality_gam.train(empty(spark), labels)
    assert {r["score"] for r in quality_gam.score(docs, nothing).collect()} == {0.5}


# -- rules ------------------------------------------------------------------------------------------
def plain_base(text):
    words = words_of(text)
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)} if len(words) < 5000 else None
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    repeats = len(covered) if covered is not None else None
    return len(words), sum(map(len, words)), symbols, dup, repeats


def test_base_counts(spark):
    got = QUERIES["op3_weak_supervision"](spark, SF).collect()
    texts = dict(texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    for r in got:
        n, chars, symbols, dup, repeats = plain_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (n, chars, symbols, dup)
        assert repeats is None or r["n_repeat_words"] == repeats
        assert r["base_failed"] == (n < 50 or 100 * r["n_repeat_words"] > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_repeated_words():
    assert repeated_words(b"a b c a b c d".split()) == 6
    assert repeated_words(b"x x x x".split()) == 4
    assert repeated_words(b"a b c d".split()) == repeated_words([]) == 0


def test_estimation_finds_the_accuracies():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    true = np.array([0.999, 0.999, 0.9985, 0.999, 0.9995]), np.array([0.9, 0.5, 0.7, 0.8, 0.3])
    right = np.where(good[:, None], rng.random((20_000, 5)) < true[0], rng.random((20_000, 5)) < true[1])
    ballots = np.where(right, 1, -1) * np.where(good, 1, -1)[:, None] * (rng.random((20_000, 5)) < 0.9)
    patterns, counts = np.unique([rules.pattern(b) for b in ballots], return_counts=True)
    accuracy, share = rules.estimate(patterns, counts.astype(float), 5)
    assert abs(share - 0.8) < 0.03 and np.abs(accuracy[1] - true[1]).max() < 0.08
    kept = rules.posterior(rules.ballots(np.array([rules.pattern(b) for b in ballots]), 5), accuracy, share) >= 0.5
    assert np.mean(kept == good) > 0.97


@pytest.mark.parametrize("false_alarms", [0.02, 0.05, 0.1])
def test_a_rule_with_false_alarms_does_not_drop_good_texts(false_alarms):
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.85
    wrong = np.array([0.001] * 4 + [false_alarms] + [0.001] * 6)
    ballots = np.where(np.where(good[:, None], rng.random((20_000, 11)) < wrong, rng.random((20_000, 11)) < 0.3), -1, 1)
    each = np.array([rules.pattern(b) for b in ballots])
    patterns, counts = np.unique(each, return_counts=True)
    accuracy, share = rules.estimate(patterns, counts.astype(float))
    assert abs(accuracy[0][4] - (1 - false_alarms)) < 0.01 and abs(share - 0.85) < 0.02
    kept = rules.posterior(rules.ballots(each), accuracy, share) >= 0.5
    assert kept[good & (ballots[:, 4] == -1) & ((ballots == -1).sum(1) == 1)].all()
    assert kept[good].mean() > 0.98 and kept[~good].mean() < 0.06


def test_rules_keep_clean_texts_and_drop_junk(spark):
    got = QUERIES["op3_weak_supervision"](spark, SF_LARGER).toPandas()
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id").query("not base_failed")
    assert both.query("quality == 1")["kept"].mean() > 0.98
    assert rows_of(rules.judge(empty(spark)), "doc_id") == []
    rows = rules.judge(awkward(spark)).collect()
    assert len(rows) == awkward(spark).count()
    assert all(not r["kept"] and r["base_failed"] for r in rows if r["n_words"] == 0)


def test_facts_of_odd_texts():
    facts = text_facts("Ä b\n\n!!! *x*\nÄ b")
    assert (facts["n_words"], facts["word_chars"], facts["n_symbols"], facts["n_dup_lines"]) == (6, 10, 2, 1)
    assert not any(v for v in text_facts("").values())


# -- toxicity -----------------------------------------------------------------------------------------
INSULTS = ("scoundrel", "blockhead", "dimwit")


def disguise(word, rng):
    kind = rng.randrange(4)
    if kind == 0:
        return word
    if kind == 1:
        return "".join({"o": "0", "i": "1", "e": "3", "a": "4", "s": "$"}.get(c, c) for c in word)
    if kind == 2:
        return " ".join(word)
    return "".join(c * (4 if k == 2 else 1) for k, c in enumerate(word))


def insult(text, rng):
    words = text.split()
    for _ in range(3):
        words.insert(rng.randrange(len(words)), disguise(rng.choice(INSULTS), rng))
    return " ".join(words)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = corpus(spark, insult, "toxic")
    model = toxicity.train(docs, labels)
    assert {w.encode() for w in INSULTS} <= set(model.weights)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    judged = [scored[i]["predicted"] == y for i, y in truth.items() if held(i, 3, 1)]
    assert len(judged) > 80 and np.mean(judged) > 0.95


def test_decoding():
    text = ("the scoundrel and the blockhead met a dimwit near the river in the morning " * 40).encode()
    c = toxicity.CLASS[np.frombuffer(b"\n\n\n" + text, np.uint8)].astype(int)
    counts = np.bincount(((c[:-3] * 28 + c[1:-2]) * 28 + c[2:-1]) * 28 + c[3:], minlength=28**4).reshape((28,) * 4)
    restorer = toxicity.Restorer(toxicity.log_model(counts), bound=5)
    for shown, word in (("sc0undr3l", "scoundrel"), ("$coundrel!!", "scoundrel"), ("b l o c k h e a d", "blockhead"),
                        ("d.i.m.w.i.t", "dimwit"), ("diiiimwit", "dimwit"), ("d 1 m w 1 t", "dimwit"), ("D!MWIT", "dimwit")):
        assert word.encode() in restorer.words(f"you {shown} there"), shown
    assert restorer.words("plain words 2024") == {b"plain", b"words"}
    assert restorer.words("") == set()


def test_decoding_of_heavy_disguises():
    text = ("an idiot said shit to a stupid asshole and the idiot went home in a fit, a bit late, he saw it " * 40).encode()
    c = toxicity.CLASS[np.frombuffer(b"\n\n\n" + text, np.uint8)].astype(int)
    counts = np.bincount(((c[:-3] * 28 + c[1:-2]) * 28 + c[2:-1]) * 28 + c[3:], minlength=28**4).reshape((28,) * 4)
    restorer = toxicity.Restorer(toxicity.log_model(counts))
    for shown, word in (("id|ot", "idiot"), ("1d107", "idiot"), ("5h17", "shit"), ("idio+", "idiot"), ("a$$$hole", "asshole"),
                        ("sh!+!!", "shit"), ("i d i o +", "idiot"), ("s" + "t" + "u" * 3 + "p" + "1" * 23 + "d", "stupid")):
        assert word.encode() in restorer.words(shown) and word.encode() in restorer.words(f"you {shown} there"), shown
    assert b"stoopid" in restorer.words("st" + "0" * 23 + "pid") or b"stopid" in restorer.words("st" + "0" * 23 + "pid")
    for number in ("455", "2024", "in 1907", "10 11 12", "+1 743 555"):
        assert restorer.words(number) <= {b"in"}, number
    assert restorer.words("saw it! $$$ || +++") == {b"saw", b"it"}
    assert toxicity.Restorer._disguised("äää".encode()) and not toxicity.Restorer._disguised("ää öö".encode())
    assert len(toxicity.decode("a1" * 20_000, restorer.model)) == 40_000


def test_toxicity_query_and_awkward(spark):
    got = QUERIES["op5_noisy_channel_toxicity"](spark, SF_LARGER).toPandas()
    assert len(got) == 1000 and got["held_out"].tolist() == [held(i, 3, 1) for i in got["doc_id"]]
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet").toPandas()
    clean = got.merge(labels, on="doc_id").query("toxic == 0")
    assert (clean["predicted"] == 0).mean() > 0.98
    docs, labels, _ = corpus(spark, insult, "toxic")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(awkward(spark), model).collect()
    assert len(rows) == awkward(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty(spark), model).count() == 0
    alone = toxicity.train(empty(spark), labels)
    assert {round(r["score"], 6) for r in toxicity.score(docs, alone).collect()} == {0.5}


def test_character_counts_see_every_text(spark):
    docs = awkward(spark)
    total = toxicity.character_counts(docs).sum()
    assert total == sum(len(t.encode()) + 3 for _, t in texts_of(docs)) or math.isclose(
        total, sum(len(t.encode()) + 3 for _, t in texts_of(docs)), rel_tol=1e-3
    )


@pytest.mark.parametrize("sample", [10, 40])
def test_the_sample_is_bounded(spark, sample):
    docs, labels, _ = corpus(spark, insult, "quality")
    from fieldtally.llm.common import training_labels

    chosen = training_labels(labels, "quality", 4, 2, sample).collect()
    assert len(chosen) == sample and not any(held(r["label_id"], 4, 2) for r in chosen)


def test_decoder_equals_enumeration():
    """On random small lattices the decoded reading is one that no other path beats."""
    rng = random.Random(11)
    model = np.log(np.random.default_rng(4).dirichlet(np.ones(28), (28,) * 3)).astype(np.float32)

    def worth(readings):
        at, total = (0, 0, 0), sum(cost for _, cost in readings)
        for c in [toxicity._class(x) for letters, _ in readings for x in letters] + [0]:
            total += float(model[(*at, c)])
            at = (*at[1:], c)
        return total

    for _ in range(300):
        spaced = rng.random() < 0.3
        stretch = "".join(rng.choice("abio013457@$!|+é" + " ._-" * spaced) * rng.choice((1, 1, 1, 2, 3)) for _ in range(rng.randint(1, 4)))
        best: dict[str, float] = {}
        for path in itertools.product(*toxicity.lattice(stretch, spaced)):
            text = "".join(letters for letters, _ in path)
            best[text] = max(best.get(text, -np.inf), worth(path))
        assert best[toxicity.decode(stretch, model, spaced)] >= max(best.values()) - 1e-3, stretch
