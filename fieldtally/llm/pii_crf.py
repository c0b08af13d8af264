"""Personal data by patterns and a skip-chain conditional random field.

*Base.* Emails, IP addresses, cards and phones are found by fixed patterns; these spans always stand.

*Field.* The nodes of a text are its base spans and what else could be personal data: the digit groups of a number that
a base span of the text shows, too, long digit runs, spaced digit groups, and addresses with ``at`` and ``dot`` spelt
out. Labels are O and the four kinds. Three potentials, trained on
all documents with the base spans as labels, are log-odds of counts and clipped:

* a node's own: how often nodes of its shape have each label;
* a chain edge between neighbours that stand close together;
* a *skip* edge between distant nodes of one text with the same digits or the same letters, which favours equal labels
  as strongly as repeated base spans agree.

Loopy message passing over all nodes of a batch (texts do not touch) runs until the beliefs stand still. So a
number that is a phone in one place of a text is one where its ``+`` is missing, too. Skip edges tie each occurrence to
the next one and to the first, so a number that occurs k times has fewer than 2k of them.

Training is one pass that sends counts of shapes and label pairs, a few hundred rows; inference is one pass.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import map_texts, texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
CLIP = 4.0  # bound of a node's own log-odds against O
SKIP_CLIP = 6.0  # bound of a skip edge's log-odds for agreement
NEAR = 40  # characters between neighbours of a chain edge, at most
ROUNDS = 20
DAMPING = 0.5

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
BARE = re.compile(r"[0-9](?:[().\-/:]?[0-9]){6,}")
GROUPS = re.compile(r"\(?[0-9]{2,}[).\- ][0-9().\- ]{2,}[0-9]")
SPELT = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({](?:dot|DOT)[\])}]) ?[A-Za-z0-9-]{1,63}){1,8}"
)
RUN = re.compile(r"[0-9](?:[().\-/: ]*[0-9])*")  # all that may be one number or several side by side
NUMBER = re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4})(?![0-9])")  # in a row
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Addresses, leftmost and not overlapping: each @ takes the name before it that is still free."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[Span]:
    """Dotted quads: of a chain of dotted numbers every four from the left, with parts up to 255."""
    found = []
    for chain in DOTTED.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts = chain[0].split(".")
        start = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((start, end))
            start = end + 1
    return found


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind by the fixed patterns; matches that fail their test are dropped, not tried again."""
    if not DIGIT.search(text):
        return {"email": emails(text), "ip": [], "card": [], "phone": []}
    cards = [(m.span(), _digits(m[0])) for m in CARD.finditer(text) if m.end() - m.start() >= 16]
    phones = PHONE.finditer(text) if "+" in text else ()
    return {
        "email": emails(text), "ip": addresses(text),
        "card": [span for span, d in cards if 16 <= len(d) <= 19 and luhn(d)],
        "phone": [m.span() for m in phones if 8 <= len(_digits(m[0])) <= 15],
    }


@dataclass
class Nodes:
    """The nodes of one text in order: spans, shapes, keys of skip edges, base labels (0: none)."""

    spans: list[Span]
    shapes: list[str]
    keys: list[str]
    labels: list[int]


def shape(text: str) -> str:
    """What a node looks like: digits by number, and which marks it has."""
    if "@" in text or SPELT.match(text):
        return "address"
    n = len(_digits(text))
    marks = "".join(m for m in "+(.-/: " if m in text)
    return f"{'<7' if n < 7 else n if n < 20 else '20+'}|{marks}"


def key(text: str) -> str:
    """Equal for similar nodes: an address without its spelling, else the last nine digits."""
    if "@" in text or SPELT.match(text):
        plain = re.sub(r" ?[\[({]at[\])}] ?", "@", text.lower())
        return re.sub(r" ?(?:\.|[\[({]dot[\])}]) ?", ".", plain)
    return _digits(text)[-9:]


def nodes(text: str, base: dict[str, list[Span]]) -> Nodes:
    """Base spans and further candidates that overlap neither these nor each other."""
    taken = sorted((a, b, 1 + k) for k, kind in enumerate(KINDS) for a, b in base[kind])
    found = list(taken)
    if DIGIT.search(text):
        found += _known(text, base["card"] + base["phone"], found)
        if "+" in text:  # a number whose base match ran on into an address or another number
            found += _between(PHONE, text, found, 8, 15)
        found += _between(GROUPS, text, found, 7, 15)
        found += _between(BARE, text, found, 7)
    if "(" in text or "[" in text or "{" in text:
        found += _free(SPELT, text, found)
    found.sort()
    parts = [text[a:b] for a, b, _ in found]
    return Nodes([(a, b) for a, b, _ in found], [shape(p) for p in parts], [key(p) for p in parts],
                 [label for *_, label in found])


def _gaps(text: str, taken: list) -> Iterator[Span]:
    """The stretches between the spans in ``taken``."""
    at = 0
    for a, b, *_ in sorted(taken):
        if a > at:
            yield at, a
        at = max(at, b)
    if at < len(text):
        yield at, len(text)


def _known(text: str, spans: list[Span], taken: list) -> list:
    """Runs of whole digit groups outside ``taken`` that end in the last nine digits of one of ``spans``.

    Of several starts the one with most digits of the known number is taken, else the one with fewest digits.
    """
    numbers: dict[str, set[str]] = {}
    for a, b in spans:
        digits = _digits(text[a:b])
        numbers.setdefault(digits[-9:], set()).add(digits)
    out = []
    lengths = {len(k) for k in numbers}
    for lo, hi in _gaps(text, taken) if numbers else ():
        for run in RUN.finditer(text, lo, hi):
            groups = [g.span() for g in DIGITS.finditer(text, *run.span())]
            free = 0
            for j, (_, end) in enumerate(groups):
                digits, best = "", None
                for i in range(j, free - 1, -1):
                    digits = text[slice(*groups[i])] + digits
                    if len(digits) > 19:
                        break
                    for n in lengths:
                        full = numbers.get(digits[-n:], ()) if len(digits) >= n else ()
                        whole = any(f.endswith(digits) for f in full)
                        if full and (best is None or whole):
                            best = i
                if best is not None:
                    start = groups[best][0]
                    start -= start > lo and text[start - 1] == "("
                    if not _cut(text, start, end):
                        out.append((start, end, 0))
                        free = j + 1
    return out


def _cut(text: str, start: int, end: int) -> bool:
    """Whether a span begins or ends inside a digit group."""
    before, after = text[max(start - 1, 0) : start + 1], text[end - 1 : end + 1]
    return (start > 0 and bool(DIGITS.fullmatch(before))) or (end < len(text) and bool(DIGITS.fullmatch(after)))


def _between(pattern: re.Pattern, text: str, taken: list, least: int, most: int = 1 << 30) -> list:
    """Matches in the gaps of ``taken`` with a fitting number of digits; of a longer match the numbers inside it."""
    out = []
    for lo, hi in _gaps(text, taken):
        for m in pattern.finditer(text, lo, hi):
            n = len(_digits(m[0]))
            inside = [m] if n <= most else NUMBER.finditer(text, *m.span())
            out += [(*x.span(), 0) for x in inside if n >= least and not _cut(text, *x.span())]
    return out


def _free(pattern: re.Pattern, text: str, taken: list, least: int = 0, most: int = 1 << 30) -> list:
    """Matches that overlap nothing in ``taken`` and have a fitting number of digits."""
    taken, at, out = sorted(taken), 0, []
    for m in pattern.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if (at == len(taken) or taken[at][0] >= m.end()) and least <= len(_digits(m[0])) <= most:
            out.append((*m.span(), 0))
    return out


def edges(n: Nodes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain edges, skip edges) by index."""
    chain = [(i, i + 1) for i in range(len(n.spans) - 1) if n.spans[i + 1][0] - n.spans[i][1] <= NEAR]
    first: dict[str, int] = {}
    last: dict[str, int] = {}
    skip = []
    for i, k in enumerate(n.keys):
        if k in last:
            skip.append((last[k], i))
            if first[k] != last[k]:
                skip.append((first[k], i))
        first.setdefault(k, i)
        last[k] = i
    return chain, skip


@dataclass
class Field:
    """Potentials: of shapes (label weights against O), of chain edges, and the reward of agreement on skip edges."""

    own: dict[str, np.ndarray]
    chain: np.ndarray
    agree: float

    def weights(self, shapes: list[str]) -> np.ndarray:
        unknown = np.array([0.0] + [-CLIP] * len(KINDS))
        return np.array([self.own.get(s, unknown) for s in shapes]).reshape(len(shapes), len(LABELS))


def train(docs: DataFrame) -> Field:
    """Count shapes, neighbours and repeated base spans over all documents; the counts become log-odds.

    NULL and empty texts count nothing, repeated rows as often as they stand, texts of any length whole; an empty table gives the
    weights of no evidence.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                n = nodes(text, base_spans(text))
                seen.update(("own", s, y) for s, y in zip(n.shapes, n.labels))
                chain, skip = edges(n)
                seen.update(("chain", str(n.labels[i]), n.labels[j]) for i, j in chain)
                # a repeated node that no pattern knows tells nothing about agreement
                seen.update(("skip", "", int(n.labels[i] == n.labels[j])) for i, j in skip if n.labels[i] and n.labels[j])
        rows = [(*k, v) for k, v in seen.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())],
            names=["part", "name", "label", "n"],
        )

    rows = (
        texts(docs).mapInArrow(count, "part string, name string, label int, n long")
        .groupBy("part", "name", "label").agg(F.sum("n").alias("n")).collect()  # shapes: at most a few hundred
    )
    own: dict[str, np.ndarray] = {}
    chain, agree = np.ones((len(LABELS), len(LABELS))), np.ones(2)
    for part, name, label, n in rows:
        if part == "own":
            own.setdefault(name, np.full(len(LABELS), 0.5))[label] += n
        elif part == "chain":
            chain[int(name), label] += n
        else:
            agree[label] += n
    joint = chain / chain.sum()
    lift = np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
    return Field(
        {s: np.clip(np.log(c / c[0]), -CLIP, CLIP) for s, c in own.items()},
        np.clip(lift, -1, 1), float(np.clip(np.log(agree[1] / agree[0]), 0.5 * SKIP_CLIP, SKIP_CLIP)),
    )


def infer(found: list[Nodes], field: Field) -> list[list[int]]:
    """The likeliest label of every node of every text, by damped loopy sum-product messages."""
    sizes = [len(n.spans) for n in found]
    if not sum(sizes):
        return [[] for _ in found]
    labels, at, source, target, tables = len(LABELS), 0, [], [], []
    agree = np.zeros((labels, labels))
    np.fill_diagonal(agree, field.agree)
    for n in found:
        if len(n.spans) > 1:
            for pairs, table in zip(edges(n), (field.chain, agree)):
                for i, j in pairs:
                    source += [at + i, at + j]
                    target += [at + j, at + i]
                    tables += [table, table.T]
        at += len(n.spans)
    own = np.concatenate([field.weights(n.shapes) for n in found if n.spans])
    base = np.concatenate([n.labels for n in found if n.spans]).astype(int)
    known = np.nonzero(base)[0]
    own[known] = -1e3  # base spans are given
    own[known, base[known]] = 0.0
    belief = own
    if source:
        source, target, tables = np.array(source), np.array(target), np.array(tables)
        back = np.arange(len(source)) ^ 1  # the two directions of an edge stand side by side
        message = np.zeros((len(source), labels))
        for _ in range(ROUNDS):
            total = own.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            new = _log_sum(out[:, :, None] + tables)
            new -= new.max(1, keepdims=True)
            step = DAMPING * new + (1 - DAMPING) * message
            still = np.abs(step - message).max() < 1e-4
            message = step
            if still:
                break
        belief = own.copy()
        np.add.at(belief, target, message)
    best = belief.argmax(1)
    return [part.tolist() for part in np.split(best, np.cumsum(sizes)[:-1])]


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(1, keepdims=True)))[:, 0]


def all_spans(bodies: list[str], field: Field) -> Iterator[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """(base spans, all spans by kind) of each text of a batch."""
    bases = [base_spans(t) for t in bodies]
    found = [nodes(t, b) for t, b in zip(bodies, bases)]
    for base, n, labels in zip(bases, found, infer(found, field)):
        spans = {kind: list(base[kind]) for kind in KINDS}
        for span, given, label in zip(n.spans, n.labels, labels):
            if label and not given:
                spans[LABELS[label]].append(span)
        yield base, {kind: sorted(s) for kind, s in spans.items()}


def written(spans: dict[str, list[Span]]) -> str:
    """``kind:start:end`` by kind and start, comma-joined; code points, end exclusive."""
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans as text, and how many the field added.

    NULL and empty texts have none; the digest of no span is that of the empty string. Texts of any length are searched whole, a
    repeated row has a row of its own, a NULL doc_id stays NULL, and an empty table gives no rows.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

    def rows(ids: list, bodies: list[str]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("base_sha256", "spans", "n_added", *(f"n_{k}" for k in KINDS))}
        for base, spans in all_spans(bodies, field):
            for kind in KINDS:
                out[f"n_{kind}"].append(len(base[kind]))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(spans))
            out["n_added"].append(sum(len(spans[k]) - len(base[k]) for k in KINDS))
        return {"doc_id": ids, **out}

    return map_texts(docs, rows, schema)


def masked(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the union by the first kind."""
    parts, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind in KINDS for a, b in spans[kind]):
        if a >= at:
            parts += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with masked texts; all columns stay, ``n_chars`` (if there) follows the new text.

    A NULL text stays NULL and an empty one empty, texts of any length are masked whole, repeated rows are masked alike, and an empty
    table stays empty.
    """
    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        bodies = ["" if t is None else t for t in text]
        made = [masked(t, spans) for t, (_, spans) in zip(bodies, all_spans(bodies, field))]
        return pd.Series([None if t is None else m for t, m in zip(text, made)], dtype=object)

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out
