"""Best-fit packing of documents into sequences of a fixed capacity, by linear grouping.

Lengths are whole numbers up to the capacity, so what the driver plans with is a histogram of at most ``capacity``
rows, however many documents there are:

1. *Linear grouping.* Large lengths are sorted and cut into groups of equal cardinality; each is rounded up to the
   largest of its group, which leaves few sizes.
2. *Few-size configurations.* The cutting-stock program over these sizes is solved by column generation: a price
   per size, a knapsack for the best configuration at these prices, a pivot. Whole multiples of the configurations
   are used, what is left over joins the next step.
3. *Substitution.* The j-th place of a group takes the j-th longest document of that group, so every bin gets the
   room that rounding had set aside back.
4. *Best fit.* Small documents, longest first, go where the least room is left that still holds them.

Bins are planned in runs of equal bins. The plan says for each length: the pieces ranked a..b go to sequences s,
s+1, ... at offset o. Its rows are bounded by the capacity and the number of configurations, not by the data. Spark
ranks the pieces of each length (range partitions on length, doc_id and piece, so a length that a third of all
pieces share spreads over tasks) and joins the plan by length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm.common import map_texts
from fieldtally.llm.tokens import encoder
from fieldtally.session import staged

CAPACITY = 4096
LARGE = 1 / 8  # a length above this share of the capacity is large
GROUPS = 48  # distinct sizes after rounding up
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Token pieces of every document: its ids and ``end_id``, cut every ``capacity`` ids.

    A NULL text gives the one id ``end_id``. Ids are little-endian 32-bit integers.
    """
    end = np.uint32(end_id).tobytes()

    def cut(ids: list, texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        encode = encoder(vocabulary).encode
        for doc_id, text in zip(ids, texts):
            body = encode(text) + end
            for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                part = body[at : at + 4 * capacity]
                row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                for column, value in zip(out.values(), row):
                    column.append(value)
        return out

    return map_texts(docs, cut, PIECES)


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Whole multiples of configurations (items of each size in one bin) that together place no more than ``counts``.

    ``sizes`` are distinct. The relaxed program is solved by column generation from bins of a single size.
    """
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)  # a column per configuration
    need = np.asarray(counts, float)
    most = capacity // min(sizes)
    for _ in range(rounds):
        price = np.linalg.solve(basis.T, np.ones(k))
        found, worth = _best_configuration(sizes, price, capacity, most)
        if worth <= 1 + 1e-9:
            break
        uses, into = np.linalg.solve(basis, need), np.linalg.solve(basis, found)
        rising = into > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, np.maximum(uses, 0) / np.where(rising, into, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = found
    uses = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-9).astype(int)
    return [(basis[:, j].round().astype(int).tolist(), int(n)) for j, n in enumerate(uses) if n]


def _best_configuration(sizes: list[int], price: np.ndarray, capacity: int, most: int) -> tuple[np.ndarray, float]:
    """The configuration of highest price: a knapsack by number of items, over all capacities at once."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(most):
        further, pick = best.copy(), np.full(capacity + 1, -1)
        for i, size in enumerate(sizes):
            if price[i] > 0:
                worth = best[: capacity + 1 - size] + price[i]
                better = worth > further[size:] + 1e-12
                further[size:][better] = worth[better]
                pick[size:][better] = i
        picks.append(pick)
        if np.array_equal(further, best):
            break
        best = further
    found, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            found[pick[room]] += 1
            room -= sizes[pick[room]]
    return found, float(found @ price)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS):
    """Assignments ``(length, rank_from, rank_to, sequence_from, offset)`` and the number of sequences.

    Pieces of a length with ranks ``rank_from <= r < rank_to`` go to sequence ``sequence_from + r - rank_from``.
    """
    runs = _large_runs(histogram, capacity, large, groups)
    small = {n: c for n, c in histogram.items() if n <= capacity * large}
    placed = {n: c for n, c in histogram.items() if n > capacity * large}
    for bins, items in runs:
        for n in items:
            placed[n] -= bins
    left = dict(sorted(((n, c) for n, c in (placed | small).items() if c), reverse=True))
    runs = _best_fit(runs, left, capacity)
    rank: dict[int, int] = dict.fromkeys(histogram, 0)
    out, sequence = [], 0
    for bins, items in runs:
        offset = 0
        for n in items:
            out.append((n, rank[n], rank[n] + bins, sequence, offset))
            rank[n] += bins
            offset += n
        sequence += bins
    return out, sequence


def _large_runs(histogram, capacity, large, groups) -> list[tuple[int, tuple[int, ...]]]:
    """Runs ``(bins, lengths)`` of the large pieces, with real lengths in the places of the rounded ones."""
    lengths = sorted((n for n in histogram if n > capacity * large and histogram[n]), reverse=True)
    if not lengths:
        return []
    ends = np.cumsum([histogram[n] for n in lengths])  # the longest pieces come first
    size, total = -(-int(ends[-1]) // groups), int(ends[-1])
    members, first = [], 0
    for start in range(0, total, size):
        stop, parts = min(start + size, total), []
        while first < len(lengths):
            low = int(ends[first]) - histogram[lengths[first]]
            taken = min(stop, int(ends[first])) - max(start, low)
            if taken > 0:
                parts.append([lengths[first], taken])
            if ends[first] > stop:
                break
            first += 1
        members.append(parts)
    merged: dict[int, list] = {}
    for parts in members:  # groups of one rounded size are one
        merged.setdefault(parts[0][0], []).extend(parts)
    sizes = list(merged)
    counts = [sum(c for _, c in merged[s]) for s in sizes]
    runs = []
    for config, bins in configurations(sizes, counts, capacity):
        places = [i for i, n in enumerate(config) for _ in range(n)]
        while bins:
            step, items = _step(places, merged, sizes, bins)
            runs.append((step, tuple(items)))
            bins -= step
    return runs


def _step(places, merged, sizes, bins) -> tuple[int, list[int]]:
    """As many equal bins as the longest unplaced pieces of each group allow: the lengths in one, taken from the groups."""
    wanted = {i: places.count(i) for i in set(places)}
    step = bins
    for i, n in wanted.items():
        step = min(step, merged[sizes[i]][0][1] // n)
    items = []
    for i, n in wanted.items():
        queue = merged[sizes[i]]
        for _ in range(n):
            items.append(queue[0][0])
            queue[0][1] -= max(step, 1)  # no whole bin out of one length: a bin across two lengths
            if not queue[0][1]:
                queue.pop(0)
    return max(step, 1), items


def _best_fit(runs, left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Place the remaining lengths, longest first, into the least room that holds them; new bins only where none does."""
    by_room: dict[int, list] = {}
    rooms: list[int] = []

    def put(room: int, run) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(run)

    for bins, items in runs:
        put(capacity - sum(items), (bins, items))
    for length, count in left.items():
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # no room left: as many new bins as the count fills
                fits = capacity // length
                full, rest = divmod(count, fits)
                if full:
                    put(capacity - fits * length, (full, (length,) * fits))
                if rest:
                    put(capacity - rest * length, (1, (length,) * rest))
                break
            room = rooms[at]
            bins, items = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            fits = room // length  # the same bin stays the best fit for this length until it is full
            take = min(bins, count // fits)
            if take:
                put(room - fits * length, (take, items + (length,) * fits))
                count -= take * fits
            elif bins:
                put(room - count * length, (1, items + (length,) * count))
                take, count = 1, 0
            if bins > take:
                put(room, (bins - take, items))
    return [run for room in rooms for run in by_room[room]]


def ranked(cut: DataFrame) -> DataFrame:
    """Pieces with their rank (from 0) among the pieces of the same length, in order of doc_id and piece."""
    spark = cut.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["length", "doc_id", "piece", "ids_crc32"]
    ordered = staged(
        cut.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("_row", F.monotonically_increasing_id()),
        "packing-ranked",
    )
    part, row = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    counts = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).agg(F.count("*")).collect()}  # a row per partition
    histogram = {r[0]: r[1] for r in ordered.groupBy("length").agg(F.count("*")).collect()}  # a row per length
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    shorter, total = {}, 0
    for n in sorted(histogram):
        shorter[n], total = total, total + histogram[n]
    parts_at = spark.createDataFrame(list(before.items()), "_part long, _before long")
    lengths_at = spark.createDataFrame(list(shorter.items()), "length long, _shorter long")
    return histogram, (
        ordered.withColumn("_part", part)
        .join(F.broadcast(parts_at), "_part").join(F.broadcast(lengths_at), "length")
        .withColumn("_rank", F.col("_before") + row - F.col("_shorter")).drop("_part", "_before", "_shorter", "_row")
    )


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Place every document's pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    NULL and empty texts are one piece of one id, repeated rows are packed as often as they stand, pieces of equal
    length are placed in order of doc_id and piece, and an empty table packs into no sequence.
    """
    spark: SparkSession = docs.sparkSession
    cut = pieces(docs, vocabulary, end_id, capacity, with_ids)
    # written first: range partitioning looks at its input twice, and texts shall be encoded once
    histogram, rows = ranked(staged(cut if with_ids else cut.drop("ids"), "packing-pieces"))
    assignments, _ = plan(histogram, capacity)
    places = spark.createDataFrame(
        assignments, "length long, _from long, _to long, _sequence long, _offset long"
    )
    return _placed(rows, places, spark)


def _placed(rows: DataFrame, places: DataFrame, spark: SparkSession) -> DataFrame:
    """Each piece finds its row of the plan by length and rank; the plan of a length is an array that is searched."""
    by_length = places.groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("_from", "_sequence", "_offset"))).alias("_plan")
    )
    at = "cast(array_size(filter(_plan, x -> x._from <= _rank)) as int)"
    found = rows.join(F.broadcast(by_length), "length").withColumn("_at", F.expr(f"element_at(_plan, {at})"))
    return found.withColumn(
        "sequence_id", F.col("_at._sequence") + F.col("_rank") - F.col("_at._from")
    ).withColumn("offset", F.col("_at._offset")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset",
        *[c for c in ("ids",) if c in rows.columns],
    )
