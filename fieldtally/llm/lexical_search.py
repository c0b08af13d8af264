"""Ranked lexical search for many items at once, with common term sets evaluated once.

Items share terms. What is shared is mined before any text is scored: the two parts that stand together in most items
become one node of a *sharing graph*, again and again, until no pair stands in two items. A node is the sum of its two
parts, an item the sum of the nodes that it still lists. A task then scores a block of documents at a time:

1. every term of the block gets its column of contributions (``weight * ((10^9 * tf) div (1000 * tf + 8 * m))``);
2. every node of the graph is materialised once, as the sum of two columns, whatever the number of items over it;
3. items add up their nodes and keep their best documents.

Texts are read once: the first pass leaves per document its length and the counts of the items' terms; document
frequencies, the number of documents and all lengths are summed up from there by Spark. Each task hands on at most
``top`` documents for an item, so no group grows with the corpus. Items are taken in blocks of about ``BLOCK`` terms, each
with its own graph, so the driver holds a bounded number of terms however many items there are.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import texts
from fieldtally.session import staged

TOP = 10
BLOCK = 100_000  # terms of the items in one pass, about; further items are a further pass over the documents
MINED = 256  # terms of one item whose pairs are counted together
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
CELLS = 2_000_000  # numbers in one block of accumulators, 16 MB
COUNTED = "doc_id long, n long, terms binary, counts binary"
BEST = "item int, score long, doc_id long"


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII digits and letters and of anything beyond ASCII; only A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


# ---------------------------------------------------------------- the sharing graph


def share(items: list[frozenset[int]], leaves: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Nodes ``(left, right)``, numbered on from ``leaves``, and for each item the numbers that it sums up.

    The pair that most items list together becomes a node that replaces both in all of them. A pair's count only falls
    while its parts are replaced, so counts are corrected when a pair comes up, not on every replacement.
    """
    holds: dict[int, set[int]] = defaultdict(set)
    for k, item in enumerate(items):
        for t in item:
            holds[t].add(k)
    lists = [set(item) for item in items]
    counts: Counter = Counter()
    for item in lists:
        own = sorted(t for t in item if len(holds[t]) > 1)
        for first in range(0, len(own), MINED):
            part = own[first : first + MINED]
            counts.update((a, b) for i, a in enumerate(part) for b in part[i + 1 :])
    queue = [(-n, pair) for pair, n in counts.items() if n > 1]
    heapq.heapify(queue)
    nodes: list[tuple[int, int]] = []
    while queue:
        known, (a, b) = heapq.heappop(queue)
        both = holds[a] & holds[b]
        if len(both) < 2:
            continue
        if len(both) < -known:
            heapq.heappush(queue, (-len(both), (a, b)))
            continue
        node = leaves + len(nodes)
        nodes.append((a, b))
        near: Counter = Counter()
        for k in both:
            lists[k] -= {a, b}
            near.update(t for t in lists[k] if len(holds[t]) > 1)
            lists[k].add(node)
        holds[a] -= both
        holds[b] -= both
        holds[node] = both
        for t, n in near.items():
            if n > 1:
                heapq.heappush(queue, (-n, (t, node) if t < node else (node, t)))
    return nodes, [sorted(item) for item in lists]


# ---------------------------------------------------------------- documents


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with a term: doc_id, n (its terms with repeats), and the items' terms in it with their counts (32-bit)."""
    known = vocabulary.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    counted = Counter(filter(known.__contains__, words))
                    numbers = np.fromiter((vocabulary[w] for w in counted), "<i4", len(counted))
                    times = np.fromiter(counted.values(), "<i4", len(counted))
                    rows.append((doc_id, len(words), numbers.tobytes(), times.tobytes()))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n", "terms", "counts"])

    return texts(docs).mapInArrow(run, COUNTED)


def frequencies(counted: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all their terms, and in how many documents each of the items' terms stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        documents = length = 0
        for batch in batches:
            documents += batch.num_rows
            length += int(batch.column("n").to_numpy().sum())
            numbers = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4")
            seen.update(dict(zip(*(a.tolist() for a in np.unique(numbers, return_counts=True)))))
        rows = [(-2, documents), (-1, length), *seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["term", "n"])

    found = counted.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    sums = {r["term"]: r["n"] for r in found.collect()}  # a row per term of the items
    return sums.pop(-2, 0), sums.pop(-1, 0), sums


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def best_documents(counted: DataFrame, items: list[frozenset[int]], weights: np.ndarray, documents: int, length: int, top: int) -> DataFrame:
    """Candidates (item, score, doc_id): of every task the ``top`` best documents of each item, with score above 0."""
    leaves = len(weights)
    nodes, sums = share(items, leaves)
    block = max(CELLS // max(leaves + len(nodes), 1), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[int, int, bool]]] = [[] for _ in sums]
        floor = np.zeros(len(sums), np.int64)  # a score must be at least this to be among the best of the task
        for batch in batches:
            for first in range(0, batch.num_rows, block):
                _block(batch.slice(first, block), kept, floor)
        rows = [(k, -score, doc_id) for k, best in enumerate(kept) for score, _, doc_id in best]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], names=["item", "score", "doc_id"]
        )

    def _block(batch: pa.RecordBatch, kept: list, floor: np.ndarray) -> None:
        ids, n = batch.column("doc_id").to_pylist(), batch.column("n").to_numpy()
        parts = batch.column("terms").to_pylist()
        numbers = np.frombuffer(b"".join(parts), "<i4")
        tf = np.frombuffer(b"".join(batch.column("counts").to_pylist()), "<i4").astype(np.int64)
        row = np.repeat(np.arange(len(ids)), [len(p) // 4 for p in parts])
        m = 10 + (90 * n * documents) // length
        sheet = np.zeros((leaves + len(nodes), len(ids)), np.int64)  # a row per term or node: partial accumulators
        sheet[numbers, row] = weights[numbers] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        for k, (left, right) in enumerate(nodes, leaves):
            np.add(sheet[left], sheet[right], out=sheet[k])
        for k, listed in enumerate(sums):
            if not listed:
                continue
            score = sheet[listed[0]].copy() if len(listed) == 1 else sheet[listed].sum(axis=0)
            near = np.flatnonzero((score > 0) & (score >= floor[k]))
            if len(near):
                if len(near) > top:  # equal scores at the border stay in
                    near = near[score[near] >= np.partition(score[near], -top)[-top]]
                best = sorted(kept[k] + [(-int(score[j]), ids[j] is None, ids[j]) for j in near], key=_order)[:top]
                kept[k] = best
                if len(best) == top:
                    floor[k] = -best[-1][0]

    return counted.mapInArrow(run, BEST)


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] or 0


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of each item: item_id, rank, doc_id, score; equal scores by ascending doc_id, NULL last.

    Rows of one item_id (also NULL) are one item with the terms of all of them. A NULL or empty item or document has no
    term: such an item has no row, such a document is in none. Repeated rows of documents are ranked each on its own,
    whole texts of any length are counted, and an empty table gives no rows.
    """
    listed = staged(_item_terms(items), "search-items")
    blocks = max(-(-(listed.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK), 1)
    out = None
    for block in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id").collect()
        if rows:
            found = _search_block(docs, [r["item_id"] for r in rows], [frozenset(map(bytes, r["terms"])) for r in rows], top)
            out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _search_block(docs: DataFrame, names: list, items: list[frozenset[bytes]], top: int) -> DataFrame:
    vocabulary = {term: k for k, term in enumerate(sorted(frozenset().union(*items)))}
    counted = staged(count_terms(docs, vocabulary), "search-counts")
    documents, length, df = frequencies(counted)
    weights = np.array([weight(documents, df.get(k, 0)) for k in range(len(vocabulary))], np.int64)
    found = best_documents(counted, [frozenset(vocabulary[t] for t in item) for item in items], weights, documents, max(length, 1), top)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    named = docs.sparkSession.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return (
        found.withColumn("rank", rank).where(F.col("rank") <= top)
        .join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")
    )


def _item_terms(items: DataFrame) -> DataFrame:
    """Per item_id with a term its distinct terms."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t) for i, text in zip(*(c.to_pylist() for c in batch.columns)) for t in set(terms_of(text or ""))]
            columns = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["item_id", "term"])

    return rows.mapInArrow(run, "item_id long, term binary").groupBy("item_id").agg(F.collect_set("term").alias("terms"))


ORACLE = """
WITH held AS (
  SELECT row_number() OVER () AS row, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
),
whole AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM held WHERE len(terms) > 0),
one AS (SELECT row, id, len(terms) AS n, unnest(terms) AS term FROM held),
tf AS (SELECT row, id, n, term, count(*)::BIGINT AS tf FROM one WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term
),
parts AS (
  SELECT row, id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part
  FROM tf JOIN weights USING (term), whole
),
scored AS (
  SELECT item_id, row, id AS doc_id, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN parts USING (term)
  GROUP BY item_id, row, id HAVING sum(part) > 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10
"""
