"""What the operators share: whole texts in bounded Arrow batches, words, and word statistics.

Rows are read by name (``doc_id``, ``text``), so further columns of any name are ignored. A NULL text is an
empty text, a NULL doc_id stays NULL, and a repeated row is judged as often as it stands there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = b" \t\n\r\x0b\x0c"  # what bytes.split() takes for blank, the word rule of every operator here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, with Arrow batches kept small enough for very long texts."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """At most 2,000 rows or 16 MB in one Arrow batch, so one batch of long texts fits a small worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long) and text (never NULL) of every row, and nothing else unless named."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def map_texts(
    docs: DataFrame, rows: Callable[[list, list[str]], dict[str, list]], schema: str, *more: str
) -> DataFrame:
    """Apply ``rows(doc_ids, texts)`` to each batch; it returns the columns of ``schema``."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], schema)
    arrow = _arrow_schema(empty)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.to_pydict() if more else None
            ids, bodies = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            made = rows(ids, bodies, named) if more else rows(ids, bodies)
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return texts(docs, *more).mapInArrow(run, empty.schema)


def _arrow_schema(frame: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(frame.schema)


def bucket(expression: Column, modulus: int) -> Column:
    """crc32 of a value as text, modulo: the rule that holds rows out of training."""
    return F.pmod(F.crc32(expression.cast("string").cast("binary")), F.lit(modulus))


def training_labels(labels: DataFrame, field: str, modulus: int, held_out: int, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids (``label_id``, ``label``), never one whose remainder is ``held_out``.

    Rows without an id or a label are no labels; of contradictory labels of one id the smaller one counts. Which ids
    are taken when there are more than ``bound`` is decided by a hash of the id, so it is the same in every run.
    """
    return (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(field).cast("int").alias("label"))
        .where(F.col("label_id").isNotNull() & F.col("label").isin(0, 1))
        .where(bucket(F.col("label_id"), modulus) != held_out)
        .groupBy("label_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(bound)
    )


def byte_words(text: str) -> list[bytes]:
    """Words of a text: runs of anything but the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """How many words lie in a window that stands twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    codes = ids[:n].copy()
    for k in range(1, window):
        if k > 1 and len(number) > 1 << 20:  # keep the product below 2^63
            codes = np.unique(codes, return_inverse=True)[1]
        codes = codes * len(number) + ids[k : n + k]
    order = np.argsort(codes, kind="stable")
    same = np.diff(codes[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : n + k] |= twice[:n]
    return int(covered.sum())


def duplicate_lines(body: bytes) -> tuple[int, int]:
    """(lines with a word, those of them that equal an earlier line)."""
    lines = [x for x in body.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


SYMBOLS = b"#*$%&|<>"
LETTERS_OUT = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))
LETTERLIKE_OUT = bytes(c for c in LETTERS_OUT if c < 0xC0)  # a character beyond ASCII counts by its first byte
NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
NOT_SYMBOL = bytes(c for c in range(256) if c not in SYMBOLS)
CONTINUED = bytes(range(0x80, 0xC0))


def text_facts(text: str) -> dict[str, float]:
    """Counts over one whole text; every quality operator starts from them."""
    body = text.encode("utf-8", "surrogatepass")
    words = body.split()
    n_lines, n_dup = duplicate_lines(body)
    common = Counter(words)
    joined = b"".join(words)
    return {
        "n_words": len(words),
        "word_chars": len(joined.translate(None, CONTINUED)),
        "n_symbols": len(joined.translate(None, NOT_SYMBOL)),
        "n_dup_lines": n_dup,
        "n_lines": n_lines,
        "n_repeat_words": repeated_words(words),
        "n_distinct": len(common),
        "top_word": max(common.values(), default=0),
        "n_letters": len(joined.translate(None, LETTERS_OUT)),
        "n_letterlike": len(joined.translate(None, LETTERLIKE_OUT)),
        "n_upper": len(joined.translate(None, NOT_UPPER)),
        "n_digits": len(joined.translate(None, NOT_DIGIT)),
        "n_shouts": body.count(b"!"),
        "n_pipes": body.count(b"|"),
        "n_stops": body.count(b".") + body.count(b"?"),
        "n_commas": body.count(b","),
        "n_bytes": len(body),
        "longest": max(map(len, common), default=0),
    }


MAX_KEYS = 1_000_000  # 64-bit keys that are broadcast at most, about 16 MB


def by_keys(frame: DataFrame, keys: DataFrame, key: str | Column, how: str) -> DataFrame:
    """Rows of ``frame`` whose key is (``left_semi``) or is not (``left_anti``) in the one column of ``keys``.

    Up to ``MAX_KEYS`` keys are broadcast, so the wide rows stay where they are; more are joined by shuffle.
    """
    column = keys.columns[0]
    named = keys.select(F.col(column).alias("_by_key"))
    if named.count() <= MAX_KEYS:
        named = F.broadcast(named)
    own = F.col(key) if isinstance(key, str) else key
    return frame.join(named, own == F.col("_by_key"), how)
