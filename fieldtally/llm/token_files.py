"""Token ids as flat unsigned-integer files with 64-bit document offsets, read back by memory map.

Documents are range-partitioned by doc_id. Every task writes its range as two files:

* ``<part>.bin``: the ids of its documents one after the other, ``uint16`` or ``uint32``, nothing else;
* ``<part>.idx``: ``int64`` triples (doc_id, start, end) per document, in ids from the beginning of the part.

and returns one row (part, documents, ids). The *prefix sum* of the parts' ids gives each part's base, so a document's
place in the whole corpus is its part's base plus its own offset; no task has to wait for another. Files are
written under a temporary name and renamed, so a repeated or speculative task leaves a whole file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import bounded_batches, texts
from fieldtally.llm.tokens import encoder
from fieldtally.session import scratch_path

PARTS = "part int, documents long, ids long"
BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"
NULL_ID = np.iinfo(np.int64).min  # how a NULL doc_id is written; NULLs come first


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors share (file, hdfs, s3a and the like)."""
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1)) if "://" in folder else (
        (pafs.LocalFileSystem(), folder.removeprefix("file:")))


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, dtype: str = "uint16") -> DataFrame:
    """Write all documents in ascending doc_id order; returns the parts with their bases (part, documents, ids, base).

    NULL texts are empty, NULL ids stand first, repeated rows are written as often as they stand, an empty table
    writes no document. ``dtype`` must hold the largest id of the vocabulary (checked on write).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # texts are no range key: the bounds are sampled on the driver
    ordered = texts(docs).repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    limit = np.iinfo(dtype).max

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, attempt = f"{root}/{part:06d}", f"{root}/_{part:06d}-{uuid.uuid4().hex}"
        encode, end = encoder(vocabulary).encode, np.uint32(end_id).tobytes()
        documents = at = 0
        with store.open_output_stream(attempt + ".bin") as ids_file, store.open_output_stream(attempt + ".idx") as index:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids = np.frombuffer(encode(text) + end, "<u4")
                    if ids.max() > limit:
                        raise ValueError(f"{dtype} cannot hold every id of this vocabulary")
                    ids_file.write(ids.astype(np.dtype(dtype).newbyteorder("<")).tobytes())
                    rows.append((NULL_ID if doc_id is None else doc_id, at, at + len(ids)))
                    at += len(ids)
                index.write(np.asarray(rows, "<i8").tobytes())
                documents += len(rows)
        for kind in (".bin", ".idx"):
            store.move(attempt + kind, name + kind)
        yield pa.RecordBatch.from_pydict(
            {"part": pa.array([part], pa.int32()), "documents": [documents], "ids": [at]}
        )

    parts = sorted(ordered.mapInArrow(write, PARTS).collect())  # one row per partition
    base, rows = 0, []
    for part, documents, ids in parts:
        rows.append((part, documents, ids, base))
        base += ids
    return spark.createDataFrame(rows, "part int, documents long, ids long, base long")


def read_tokens(parts: DataFrame, folder: str, dtype: str = "uint16") -> DataFrame:
    """Per document, from the files: doc_id, start in the whole corpus, n_tokens, crc32 of its ids as 32-bit integers."""
    spark = parts.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                if row["documents"]:
                    yield from _documents(store, f"{root}/{row['part']:06d}", row["base"], dtype)

    count = max(parts.count(), 1)  # one row per partition of the writer
    return parts.repartitionByRange(count, "part").mapInArrow(read, BACK)


def _documents(store: pafs.FileSystem, name: str, base: int, dtype: str) -> Iterator[pa.RecordBatch]:
    kind = np.dtype(dtype).newbyteorder("<")
    if isinstance(store, pafs.LocalFileSystem):
        ids, index = np.memmap(name + ".bin", kind, "r"), np.memmap(name + ".idx", "<i8", "r").reshape(-1, 3)
    else:  # a store without memory maps: the part is read once
        with store.open_input_stream(name + ".bin") as file:
            ids = np.frombuffer(file.read(), kind)
        with store.open_input_stream(name + ".idx") as file:
            index = np.frombuffer(file.read(), "<i8").reshape(-1, 3)
    for first in range(0, len(index), 4096):
        rows = np.array(index[first : first + 4096])
        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for _, a, b in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[:, 0], pa.int64(), mask=rows[:, 0] == NULL_ID),
                pa.array(rows[:, 1] + base), pa.array(rows[:, 2] - rows[:, 1]), pa.array(crc, pa.int64()),
            ],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def tokens_round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write the documents below the shared folder and read the files back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_tokens(write_tokens(docs, folder, vocabulary, end_id), folder)
