"""Base patterns against the regular expressions themselves; what the field adds and what it leaves alone."""

import hashlib
import random
import re

import numpy as np
import pytest

from fieldtally.llm import pii_crf
from fieldtally.llm.pii_crf import CLIP, KINDS, LABELS, Field, all_spans, base_spans, edges, luhn, masked, nodes, written
from fieldtally.llm.queries import QUERIES
from tests.llm.fixtures import DOCUMENTS, SF, awkward, empty, texts_of


def plain(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
               if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
                 if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15],
    }


@pytest.mark.parametrize("signs", ["a.@-b1 ", "0123456789. -", "+1234 ().-5", "a1@.+- (2", "4 4-", "٣4.\n+5"])
def test_base_spans_are_the_patterns(signs):
    rng = random.Random(signs)
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert base_spans(text) == plain(text), repr(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1 " * 100_000, "a@" * 200_000):
        base_spans(text)


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def trained(agree=5.0):
    """A field that has never seen the shapes of bare numbers as personal data."""
    return Field({}, np.zeros((len(LABELS), len(LABELS))), agree)


def added(text, field):
    [(base, spans)] = list(all_spans([text], field))
    return {k: [text[a:b] for a, b in spans[k] if (a, b) not in base[k]] for k in KINDS if spans[k] != base[k]}


def test_a_repeated_number_takes_the_label_of_its_base_span():
    text = "call +1 (743) 555-3824 now, later 7435553824 or (743) 555-3824; not 9998887777 nor 1234567"
    assert added(text, trained()) == {"phone": ["7435553824", "(743) 555-3824"]}
    assert added(text.replace("+", ""), trained()) == {}  # without evidence nothing is added
    assert added("write a.b@x.org or a.b [at] x [dot] org, not c.d [at] y [dot] org", trained()) == {
        "email": ["a.b [at] x [dot] org"]
    }


@pytest.mark.parametrize("beside", [
    "call {}. 555 987 6543", "555 987 6543 {}", "on 2024-05-01 {}", "10.0.0.1 {}", "12 {}", "{} {}", "{} 12 2024-05-01",
    "a 7 {} 2 {} 3", "{}, 555 987 6543 555 987 6544 {}", "4111111111111111 {}", "id 123456789012 {}",
])
def test_a_known_number_beside_other_numbers(beside):
    for shown in ("555 123 4567", "(555) 123-4567", "5551234567", "1 555 123 4567"):
        text = "write to +1 555 123 4567; " + beside.replace("{}", shown)
        assert added(text, trained()) == {"phone": [shown] * beside.count("{}")}, text


def test_numbers_in_a_row_are_nodes():
    def parts(text):
        return [text[a:b] for a, b in nodes(text, base_spans(text)).spans]

    assert parts("call 555 123 4567. 555 987 6543") == ["555 123 4567", "555 987 6543"]
    assert parts("on 2024-05-01 555 123 4567") == ["2024-05-01", "555 123 4567"]
    assert parts("10.0.0.1 555 123 4567") == ["10.0.0.1", "555 123 4567"]
    for text in ("1 " * 50_000, "555 123 4567 " * 20_000, "+1 555 123 4567, " + "555 123 4567 " * 20_000):
        nodes(text, base_spans(text))


def test_texts_of_a_batch_do_not_touch():
    one, two = "call +1 743 555 3824", "number 17435553824 here"
    spans = [s for _, s in all_spans([one, two], trained())]
    assert written(spans[0]) == "phone:5:20" and written(spans[1]) == ""


def test_skip_edges_grow_with_the_occurrences_only():
    n = nodes("7435553824 " * 500, base_spans("7435553824 " * 500))
    chain, skip = edges(n)
    assert len(n.spans) == 500 and len(skip) < 1000 and len(chain) == 499


def test_messages_against_all_labellings():
    field = Field({"a": np.array([0, -1.0, 0.5, 0.2, -2]), "b": np.array([0, 0.4, 0.1, -0.3, 0.6])}, np.zeros((5, 5)), 1.5)
    field.chain[1, 2] = 0.8
    n = pii_crf.Nodes([(0, 5), (100, 105)], ["a", "b"], ["k", "k"], [0, 0])  # one skip edge: no loop, so exact
    score = field.weights(["a", "b"])
    joint = score[0][:, None] + score[1][None, :] + 1.5 * np.eye(5)
    weight = np.exp(joint)
    assert pii_crf.infer([n], field) == [[int(weight.sum(1).argmax()), int(weight.sum(0).argmax())]]


def test_training_counts(spark):
    rows = [(i, f"card 4111111111111111 again 4111111111111111 plain {1000000 + i} text", "en", "a", 1) for i in range(30)]
    field = pii_crf.train(spark.createDataFrame(rows, DOCUMENTS))
    assert field.own["16|"][3] == CLIP and field.own["7|"].argmax() == 0
    assert 3.0 <= field.agree <= 6.0


def test_query(spark):
    got = {r["doc_id"]: r for r in QUERIES["op1_skip_chain_pii"](spark, SF).collect()}
    docs = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(got) == len(docs)
    for doc_id, text in docs:
        base, row = plain(text), got[doc_id]
        assert [row[f"n_{k}"] for k in KINDS] == [len(base[k]) for k in KINDS]
        assert row["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        spans = row["spans"].split(",") if row["spans"] else []
        assert set(written(base).split(",")) - {""} <= set(spans)
        assert len(spans) == row["n_added"] + sum(map(len, base.values()))


def test_redaction(spark):
    docs = awkward(spark)
    field = pii_crf.train(docs)
    out = pii_crf.redact(docs, field)
    assert out.columns == docs.columns and out.count() == docs.count()
    plainly = spark.createDataFrame(
        [(90, "mail a.b@x.org now 10.0.0.1 é🙂 +1 743 555 3824", "en", "a", 5), (91, None, None, None, None)], DOCUMENTS
    )
    rows = {r["doc_id"]: r for r in pii_crf.redact(plainly, field).collect()}
    assert rows[90]["text"] == "mail <EMAIL> now <IP> é🙂 <PHONE>" and rows[90]["n_chars"] == len(rows[90]["text"])
    assert rows[91]["text"] is None and rows[91]["n_chars"] is None
    assert pii_crf.redact(empty(spark), field).count() == 0
    assert pii_crf.find(empty(spark), pii_crf.train(empty(spark))).count() == 0
    assert len(pii_crf.find(awkward(spark), field).collect()) == awkward(spark).count()


def test_masking_overlaps():
    assert masked("0123456789", {"email": [(2, 5)], "ip": [(4, 7)], "card": [], "phone": [(8, 9)]}) == "01<EMAIL>7<PHONE>9"


def test_a_number_that_runs_on_into_an_address(spark):
    """The base match from the + on has too many digits and is dropped; the field adds the number, which the pipeline masks."""
    rows = [(n, f"call +1 (826) 555-40{n:02d} today") for n in range(40)]
    odd = {100: "call +1 (826) 555-4081 190.137.223.204 now", 101: "at 10.0.0.1 +1 (826) 555-4082 10.0.0.2 +1 (826) 555-4083", 102: "+1 2 3 4 5"}
    docs = spark.createDataFrame(rows + list(odd.items()), "doc_id long, text string")
    field = pii_crf.train(docs)
    found = {r["doc_id"]: r for r in pii_crf.find(docs, field).collect()}
    assert found[100]["n_phone"] == 0 and found[100]["n_ip"] == 1 and found[100]["n_added"] == 1
    assert set(found[100]["spans"].split(",")) == {"ip:23:38", "phone:5:22"}
    clean = {r["doc_id"]: r["text"] for r in pii_crf.redact(docs, field).collect()}
    assert "555" not in clean[100] and "555" not in clean[101] and clean[102] == odd[102]
