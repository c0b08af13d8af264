"""Near-duplicates by SimHash: all fingerprints against all, in tiles, with exclusive-or and bit counts.

Equal fingerprints are one class before anything is compared, so a group of copies costs one comparison. The distinct
fingerprints are dealt into ``g`` blocks by hash; a task gets one pair of blocks, so its input is bounded by the block
size. Inside a task the fingerprints are sorted into tiles of equal population counts. Two fingerprints within the
radius differ by at most the radius in the population count, and so do the counts of their parts summed over the
parts; every pair of tiles whose counts lie further apart is skipped, the others are compared exactly.

A task returns a spanning forest of the links it found, never all pairs of a group. The forests are joined by
rounds of large-star and small-star steps, each written to the shared folder.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fieldtally.llm.common import by_keys, map_texts
from fieldtally.session import staged

SHINGLE = 3
RADIUS = 3
SEED = 42
BLOCK = 150_000  # distinct fingerprints in a block; a task holds two blocks
TILE = 1024  # fingerprints of one side compared in one step
EDGES = 1 << 17  # links held before they are reduced to a forest


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half the hashes of the word shingles; no word: 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    total = np.zeros(64, np.int64)
    for first in range(0, n, 1 << 16):
        hashes = np.fromiter(map(xxh64_intdigest, _take(runs, 1 << 16), repeat(SEED)), ">u8")
        total += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _take(items, count: int):
    return (item for _, item in zip(range(count), items))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its fingerprint as a signed long (``bits``). A NULL text has no word."""

    def rows(ids: list, texts: list[str]) -> dict[str, list]:
        found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        return {"doc_id": ids, "bits": found.view(np.int64).tolist()}

    return map_texts(docs, rows, "doc_id long, bits long")


def part_counts(bits: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of ``parts`` equal parts of each fingerprint."""
    width = 64 // parts
    mask = np.uint64((1 << width) - 1) if width < 64 else np.uint64(2**64 - 1)
    return np.stack([np.bitwise_count((bits >> np.uint64(width * k)) & mask) for k in range(parts)], 1).astype(np.int16)


class _Tiles:
    """Fingerprints in order of their part counts; ``first`` and ``last`` bound the tile of each row of ``counts``."""

    def __init__(self, bits: np.ndarray, parts: int):
        counts = part_counts(bits, parts)
        order = np.lexsort(counts.T[::-1])
        self.order, self.bits = order, bits[order]
        self.counts, self.first = np.unique(counts[order], axis=0, return_index=True)
        self.last = np.append(self.first[1:], len(bits))


def links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """A spanning forest (rows of two indices) of all pairs within the radius.

    Indices count ``left`` and then ``right``; without ``right`` all pairs within ``left`` are compared.
    """
    n = len(left) + (0 if right is None else len(right))
    parts = 1 if n < 3000 else 2 if n < 60_000 else 4
    a = _Tiles(left, parts)
    b = a if right is None else _Tiles(right, parts)
    shift = 0 if right is None else len(left)
    held, size, label = [], 0, np.arange(n)
    for t in range(len(a.counts)):
        apart = np.abs(b.counts - a.counts[t]).sum(1)
        near = np.nonzero(apart <= radius)[0]
        if right is None:
            near = near[near >= t]
        if not len(near):
            continue
        spans = [np.arange(b.first[u], b.last[u]) for u in near]
        others = np.concatenate(spans)
        for low in range(a.first[t], a.last[t], TILE):
            rows = np.arange(low, min(low + TILE, a.last[t]))
            for at in range(0, len(others), 4 * TILE):
                columns = others[at : at + 4 * TILE]
                close = np.bitwise_count(a.bits[rows][:, None] ^ b.bits[columns][None, :]) <= radius
                i, j = np.nonzero(close)
                i, j = rows[i], columns[j]
                if right is None:
                    i, j = i[i < j], j[i < j]
                i, j = a.order[i], b.order[j] + shift
                new = label[i] != label[j]  # a dense group is joined after a few of its links
                if new.any():
                    held.append(np.stack([i[new], j[new]], 1))
                    size += int(new.sum())
                if size > EDGES:
                    held = [forest(np.concatenate(held), n)]
                    label[held[0][:, 0]] = held[0][:, 1]
                    size = 0
    return forest(np.concatenate(held), n) if held else np.zeros((0, 2), np.int64)


def forest(edges: np.ndarray, n: int) -> np.ndarray:
    """Edges (node, smallest node of its component) with the same components as ``edges``."""
    label = np.arange(n)
    u, v = edges[:, 0], edges[:, 1]
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    joined = np.nonzero(label != np.arange(n))[0]
    return np.stack([joined, label[joined]], 1)


def linked(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (``u``, ``v``) that join the classes (``bits``, ``least``) within the radius, forests by block pair.

    ``classes`` holds each fingerprint once; ``least`` names its class.
    """
    spark = classes.sparkSession
    total = classes.count()
    if not total:
        return spark.createDataFrame([], "u long, v long")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = max(-(-total // block), 1)
    if total > 20_000:  # enough block pairs to keep every core busy
        g = max(g, int((2 * min(wide, 24)) ** 0.5) + 1)
    own = F.pmod(F.xxhash64("bits"), F.lit(g)).cast("int")
    dealt = (
        classes.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        inside = rows["low"].iloc[0] == rows["high"].iloc[0]
        first = np.full(len(rows), True) if inside else (rows["own"] == rows["low"]).to_numpy()
        bits, least = rows["bits"].to_numpy(np.int64).view(np.uint64), rows["least"].to_numpy(np.int64)
        names = np.concatenate([least[first], least[~first]])
        found = links(bits[first], None if inside else bits[~first], radius)
        return pd.DataFrame({"u": names[found[:, 0]], "v": names[found[:, 1]]})

    return dealt.groupBy("low", "high").applyInPandas(compare, "u long, v long")


def components(edges: DataFrame, label: str = "simhash-links") -> DataFrame:
    """(``node``, ``root``): each node that has a link, and the smallest node reachable from it.

    Alternating star steps halve the depth of every tree; minima are combined before the shuffle, and a node with very
    many links meets them in a join that adaptive execution can split. A round is written to the shared folder.
    """
    edges = staged(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label
    )
    before = None
    while before != (now := _digest(edges)):  # edges are distinct, so an equal digest is an equal set
        before = now
        edges = staged(_small_star(_large_star(edges)), label)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v"), F.col("v")).distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and two sums over their hashes, the same in any order."""
    one, two = F.xxhash64("u", "v"), F.xxhash64("v", "u", F.lit(1))
    sums = [F.sum(h.cast("decimal(38,0)")) for h in (one, two)]
    return tuple(edges.agg(F.count("*"), *sums).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node itself)."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    # written before it is joined: a join of two plain shuffles is one whose hot keys can be split
    least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "simhash-least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m"))).where("u <> v").distinct()


def classified(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """(doc_id and ``bits`` of every row, ``root`` of every distinct ``bits``)."""
    marked = staged(fingerprints(docs, shingle), "simhash-fingerprints")
    # classes are compared under their fingerprint: it is unique where a doc_id need not be
    classes = staged(marked.select("bits").distinct(), "simhash-classes")
    found = components(linked(classes.withColumn("least", F.col("bits")), radius))
    roots = classes.join(found, classes["bits"] == found["node"], "left").select(
        "bits", F.coalesce("root", "bits").alias("root")
    )
    return marked, staged(roots, "simhash-roots")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id, the smallest doc_id reachable.

    Texts without a word have fingerprint zero and are linked like any other; rows with the same doc_id and other
    texts are judged on their own and may lie in several components; rows without a doc_id get a fingerprint, and a
    component_id only where a row with a doc_id lies in their component; an empty table has no rows.
    """
    marked, roots = classified(docs, shingle, radius)
    least = marked.groupBy("bits").agg(F.min("doc_id").alias("least"))  # before the join: copies are one row
    smallest = (
        roots.join(least, "bits").groupBy("root").agg(F.min("least").alias("component_id"))
    )
    membership = staged(roots.join(smallest, "root").select("bits", "component_id"), "simhash-membership")
    return marked.join(membership, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, all columns unchanged: that of the smallest doc_id (rows without one come last).

    Where rows share a doc_id, the one of the component's smallest fingerprint stays, of equal texts one.
    """
    marked, roots = classified(docs, shingle, radius)
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "bits")
    least = marked.groupBy("bits").agg(F.min(own).alias("own"))
    stay = staged(
        roots.join(least, "bits").groupBy("root").agg(F.min("own").alias("own"))
        .select("own.doc_id", F.col("own.bits").alias("_bits")),
        "simhash-stay",
    )
    shared = staged(
        marked.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-shared"
    )
    number = F.col("doc_id").cast("long")
    if not shared.limit(1).count() and not marked.where("doc_id IS NULL").limit(1).count():
        return by_keys(docs, stay.select("doc_id"), number, "left_semi")

    @F.pandas_udf("long")
    def bits(text: pd.Series) -> pd.Series:
        found = np.array([fingerprint("" if t is None else t, shingle) for t in text], np.uint64)
        return pd.Series(found.view(np.int64))

    named = by_keys(docs.where(number.isNotNull()), shared, number, "left_anti")
    named = by_keys(named, stay.where("doc_id IS NOT NULL").select("doc_id"), number, "left_semi")
    others = by_keys(docs.where(number.isNotNull()), shared, number, "left_semi").unionByName(docs.where(number.isNull()))
    marks = ["_own_bits", "_own_rank", "_stay_id", "_stay_bits"]
    others = others.withColumn("_own_bits", bits(F.col("text").cast("string")))
    kept = stay.toDF("_stay_id", "_stay_bits")
    others = others.join(kept, number.eqNullSafe(F.col("_stay_id")) & (F.col("_own_bits") == F.col("_stay_bits")))
    order = Window.partitionBy(number, "_own_bits").orderBy(F.xxhash64(*docs.columns))
    others = others.withColumn("_own_rank", F.row_number().over(order)).where("_own_rank = 1").drop(*marks)
    return named.unionByName(others)
