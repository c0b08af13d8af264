"""Packing by cutting-stock column generation: whole documents in sequences without padding, cuts only where none fits.

A sequence is padded to the capacity unless its length is a power of two, so a *pattern* (lengths that share a
sequence) is worth having when its sum is a power of two up to the capacity. What the driver plans with is the
histogram of piece lengths, at most ``capacity`` rows however many documents there are:

1. *Linear program.* Choose how often each pattern is used so that the fewest tokens stay over. Tokens that stay over
   are joined and cut every ``capacity`` ids, so they cost a cut per ``capacity``; a sequence below the capacity costs
   ``SHORT`` of what it lacks.
2. *Column generation.* A knapsack over all capacities prices patterns with the duals of the program: for each power of
   two the dearest pattern of exactly that sum. The first basis takes patterns, long pieces first, while any fits.
3. *Rounding.* Patterns are used a whole number of times, rounded down; the pieces left are few (bounded by lengths and
   patterns, not by documents) and get patterns by the same knapsack with the pieces' numbers as bounds.
4. *Assignment.* Spark ranks the pieces of each length; the plan says which ranks go to which run of sequences.

What no pattern takes is laid end to end by length and rank, which is arithmetic on the rank, and cut at multiples of
the capacity; the last stretch is cut into powers of two. So no sequence is padded, whatever the lengths are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import MAX_KEYS, map_texts
from fieldtally.llm.tokens import encoder
from fieldtally.session import staged

CAPACITY = 1024
SHORT = 0.25  # what a sequence below the capacity costs, as a share of what it lacks
GAP = 1e-3  # the program ends when its bound is this close, in sequences' worth of cut tokens per sequence
ROUNDS = 800  # pivots at most; what is not planned by then is cut, so the result stays whole
WIDTH = 2  # columns from one pricing
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PLACED = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, stream long"
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids and ``end_id``: full pieces of ``capacity`` ids and what remains (with its ids, 32-bit)."""
    end = np.uint32(end_id).tobytes()

    def cut(doc_ids: list, texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
        encode = encoder(vocabulary).encode
        for doc_id, text in zip(doc_ids, texts):
            body = encode(text) + end
            for at in range(0, len(body), 4 * capacity):
                part = body[at : at + 4 * capacity]
                whole = len(part) == 4 * capacity
                row = (doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(body) // 4, None if whole else part)
                for column, value in zip(out.values(), row):
                    column.append(value)
        return out

    return map_texts(docs, cut, PIECES)


# ---------------------------------------------------------------- patterns


def _sums(capacity: int) -> list[int]:
    """Sequence lengths without padding: powers of two below the capacity, and the capacity."""
    return [1 << k for k in range(capacity.bit_length()) if 1 << k < capacity] + [capacity]


def _cost(total: int, capacity: int) -> float:
    return SHORT * (1 - total / capacity)


def _dearest(sizes: np.ndarray, price: np.ndarray, capacity: int, most: int) -> list[tuple[float, np.ndarray]]:
    """Patterns worth more than they cost at these prices, dearest first: (gain, number of each size), at most ``most``.

    The knapsack knows the dearest pattern of exactly every sum; of the sums without padding it gives those that end in
    different sizes.
    """
    by_length = np.full(capacity + 1, -np.inf)
    by_length[sizes] = price
    place = np.zeros(capacity + 1, int)
    place[sizes] = np.arange(len(sizes))
    best = np.full(capacity + 1, -np.inf)
    best[0] = 0.0
    last = np.zeros(capacity + 1, int)
    for total in range(1, capacity + 1):
        worth = by_length[1 : total + 1] + best[total - 1 :: -1] if total > 1 else by_length[1:2] + best[:1]
        last[total] = i = int(worth.argmax()) + 1
        best[total] = worth[i - 1]
    found = []
    for total in _sums(capacity):
        fits = sizes[sizes <= total]
        gain = best[total - fits] + price[: len(fits)] - _cost(total, capacity)
        found += [(float(gain[k]), total, int(fits[k])) for k in np.argsort(-gain, kind="stable")[:most] if gain[k] > 1e-9]
    out, seen = [], set()
    for gain, total, n in sorted(found, reverse=True)[:most]:
        uses, room = np.zeros(len(sizes)), total
        while room:
            uses[place[n]] += 1
            room -= n
            n = int(last[room])
        if (key := uses.tobytes()) not in seen:
            seen.add(key)
            out.append((gain, uses))
    return out


def solve(sizes: list[int], counts: list[int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """The relaxed program: patterns (number of each size) and how often each is used; ``sizes`` ascend.

    Minimises (tokens that stay over) / capacity + the cost of short sequences, subject to no more pieces of a size than
    there are. Revised simplex with an explicit inverse over columns that the knapsack prices; every column of a pricing
    is taken in while it still gains at the prices that the one before it left.
    """
    size, need = np.asarray(sizes), np.asarray(counts, float)
    m = len(size)
    stays = size / capacity  # what a piece that stays over costs
    uses, cost, inverse = need.copy(), stays.copy(), np.eye(m)
    basis: list[np.ndarray | int] = list(range(m))  # a pattern, or the size whose pieces stay over

    def prices() -> np.ndarray:  # einsum: one thread, which a driver beside its JVM can rely on
        return np.einsum("i,ij->j", cost, inverse)

    def take(column: np.ndarray, own: float, what) -> bool:
        held = np.flatnonzero(column)
        into = np.einsum("ij,j->i", inverse[:, held], column[held])
        rising = np.flatnonzero(into > 1e-9)
        if not len(rising):
            return False
        ratio = np.maximum(uses[rising], 0) / into[rising]
        out, theta = int(rising[ratio.argmin()]), float(ratio.min())
        pivot, touched = inverse[out] / into[out], np.flatnonzero(into)
        inverse[touched] -= np.outer(into[touched], pivot)
        inverse[out] = pivot
        uses[:] -= theta * into
        uses[out], cost[out], basis[out] = theta, own, what
        return True

    def unused() -> np.ndarray:
        return np.array([int(max(u, 0) + 1e-9) if isinstance(what, int) else 0 for u, what in zip(uses, basis)])

    # a first basis: each pattern uses up one size, which none after it has
    while (first := _exact(size, unused(), capacity)) is not None and take(first.astype(float), 0.0, first.astype(float)):
        pass
    pivots = 0
    sequences = float(need @ size) / capacity
    while pivots < rounds:
        price = prices()
        found = _dearest(size, price, capacity, WIDTH)
        back = price - stays  # pieces of a size may come to stay over again
        best = max(found[0][0] if found else 0.0, float(back.max()))
        # no pattern saves more than the best, and there are no more sequences than tokens fill
        if best <= 1e-9 or best * sequences <= GAP * sequences + float(need @ price - uses @ cost):
            break
        before = pivots
        for i in np.argsort(-back)[:WIDTH]:
            if prices()[i] - stays[i] > 1e-9:
                unit = np.zeros(m)
                unit[i] = 1
                pivots += take(unit, float(stays[i]), int(i))
        for _, column in found:
            own = _cost(int(column @ size), capacity)
            if prices() @ column - own > 1e-9:
                pivots += take(column, own, column)
        if pivots == before:
            break
    return [(what, float(n)) for what, n in zip(basis, uses) if not isinstance(what, int) and n > 1e-9]


def _exact(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray | None:
    """A pattern of exactly ``capacity`` with no more pieces of a size than are left, long pieces first."""
    reach = np.zeros(capacity + 1, bool)
    reach[0] = True
    first = []  # the state before each size was looked at
    order = [i for i in np.argsort(-sizes) if left[i]]
    for i in order:
        first.append(reach.copy())
        s = int(sizes[i])
        for _ in range(min(int(left[i]), capacity // s)):
            grown = reach.copy()
            grown[s:] |= reach[:-s]
            if np.array_equal(grown, reach):
                break
            reach = grown
        if reach[capacity]:
            break
    if not reach[capacity]:
        return None
    uses, room = np.zeros(len(sizes), int), capacity
    for i, before in zip(reversed(order[: len(first)]), reversed(first)):
        s = int(sizes[i])
        while not before[room]:
            uses[i] += 1
            room -= s
    return uses


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {length: pieces in each}) of all patterns in use; what they leave over stays to be cut."""
    runs = [(histogram[n], {n: 1}) for n in (capacity,) if histogram.get(n)]
    sizes = np.array(sorted(n for n, c in histogram.items() if c and n < capacity), int)
    if not len(sizes):
        return runs
    left = np.array([histogram[int(n)] for n in sizes])
    relaxed = solve(sizes.tolist(), left.tolist(), capacity)
    rounded: list[tuple[int, np.ndarray]] = []
    for column, times in relaxed:
        once = column.astype(int)
        whole = min(int(times + 1e-6), int((left[once > 0] // once[once > 0]).min()))
        if whole > 0:
            rounded.append((whole, once))
            left -= whole * once
    for column, times in sorted(relaxed, key=lambda c: c[1] % 1, reverse=True):  # then once more while pieces last
        once = column.astype(int)
        if (once <= left).all():
            rounded.append((1, once))
            left -= once
    while (once := _exact(sizes, left, capacity)) is not None:
        times = int((left[once > 0] // once[once > 0]).min())
        rounded.append((times, once))
        left -= times * once
    return runs + [(times, {int(sizes[i]): int(n) for i, n in enumerate(uses) if n}) for times, uses in rounded]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int, dict[int, tuple[int, int]], int]:
    """``(length, rank_from, sequence_from, offset)`` rows, the sequences they fill, and per length (first rank that
    stays over, where its stretch begins in the line of what stays over), and the length of that line."""
    rank = dict.fromkeys(histogram, 0)
    rows, sequence = [], 0
    for times, uses in patterns(histogram, capacity):
        offset = 0
        for n in sorted(uses, reverse=True):
            for _ in range(uses[n]):
                rows.append((n, rank[n], sequence, offset))
                rank[n] += times
                offset += n
        sequence += times
    over, line = {}, 0
    for n in sorted(histogram):
        over[n] = (rank[n], line)
        line += n * (histogram[n] - rank[n])
    return rows, sequence, over, line


def cuts(line: int, capacity: int) -> np.ndarray:
    """Where the last, partial stretch of the line is cut: into powers of two, longest first. Ends with ``line``."""
    at = line - line % capacity
    ends = []
    for k in reversed(range(capacity.bit_length())):
        if (line % capacity) >> k & 1:
            at += 1 << k
            ends.append(at)
    return np.asarray(ends, np.int64)


# ---------------------------------------------------------------- Spark


def ranked(cut: DataFrame) -> tuple[dict[int, int], DataFrame]:
    """The histogram of lengths, and the pieces with their rank (from 0) among those of the same length."""
    spark = cut.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ["length", "doc_id", "row"]  # the row makes the key unique, so a length with a third of all pieces is split
    ordered = staged(
        cut.drop("ids").repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()),
        "cutting-ranked",
    )
    part = F.shiftright("_at", 33)
    found = ordered.groupBy("length", part.alias("p")).agg(F.count("*").alias("n")).collect()  # lengths + partitions rows
    histogram: dict[int, int] = {}
    per_part: dict[int, int] = {}
    for length, p, n in found:
        histogram[length] = histogram.get(length, 0) + n
        per_part[p] = per_part.get(p, 0) + n
    before, total = {}, 0
    for p in sorted(per_part):
        before[p], total = total, total + per_part[p]
    shorter, total = {}, 0
    for n in sorted(histogram):
        shorter[n], total = total, total + histogram[n]
    parts_at = spark.createDataFrame(list(before.items()), "_part long, _before long")
    lengths_at = spark.createDataFrame(list(shorter.items()), "_length long, _shorter long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) - F.col("_shorter")
    return histogram, (
        ordered.join(F.broadcast(parts_at), part == F.col("_part")).join(F.broadcast(lengths_at), F.col("length") == F.col("_length"))
        .select("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", rank.alias("rank"))
    )


def _places(rows: DataFrame, plan_rows: list, over: dict[int, tuple[int, int]]) -> DataFrame:
    """Each piece's sequence and offset, or its place in the line of what stays over; the plan is searched by (length, rank)."""
    table = np.asarray(sorted(plan_rows), np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 48) + table[:, 1]
    first = np.zeros(max(over, default=0) + 1, np.int64)
    line = first.copy()
    for n, (rank, at) in over.items():
        first[n], line[n] = rank, at

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            stays = rank >= first[length]
            at = np.maximum(np.searchsorted(keys, (length << 48) + rank, side="right") - 1, 0)
            found = table[at] if len(table) else np.zeros((len(length), 4), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [
                    pa.array(found[:, 2] + rank - found[:, 1], mask=stays), pa.array(found[:, 3], mask=stays),
                    pa.array(line[length] + (rank - first[length]) * length, mask=~stays),
                ],
                names=["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "stream"],
            )

    return rows.mapInArrow(place, PLACED)


def _cut_line(over: DataFrame, line: int, first_sequence: int, capacity: int) -> DataFrame:
    """Pieces that stay over (with their ids), cut where the line is cut."""
    whole, tail = line - line % capacity, cuts(line, capacity)

    def bounds(at: int) -> tuple[int, int, int]:
        """(sequence, begin, end) of the stretch that holds place ``at``."""
        if at < whole:
            return at // capacity, at - at % capacity, at - at % capacity + capacity
        k = int(np.searchsorted(tail, at, side="right"))
        return whole // capacity + k, int(tail[k - 1]) if k else whole, int(tail[k])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r in batch.to_pylist():
                done = 0
                while done < r["length"]:
                    sequence, begin, end = bounds(r["stream"] + done)
                    offset = r["stream"] + done - begin
                    n = min(r["length"] - done, end - begin - offset)
                    crc = zlib.crc32(r["ids"][4 * done : 4 * (done + n)])
                    made.append((r["doc_id"], r["start"] + done, n, crc, r["doc_tokens"], first_sequence + sequence, offset))
                    done += n
            columns = list(zip(*made)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in RESULT.split(", ")])

    return over.mapInArrow(cut, RESULT)


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Place all ids of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    Documents beyond the capacity are cut into full sequences and a remainder; remainders share sequences whose sum is
    a power of two, uncut where a pattern takes them. No sequence needs padding if the capacity is a power of two.
    NULL and empty texts are one id, repeated rows are packed as often as they stand, pieces of equal length are ranked
    by doc_id (NULL first), further columns are ignored, and an empty table packs into no sequence.
    """
    held = staged(
        pieces(docs, vocabulary, end_id, capacity).withColumn("row", F.monotonically_increasing_id()), "cutting-pieces"
    )
    histogram, rows = ranked(held)
    plan_rows, sequences, over, line = plan(histogram, capacity)
    placed = _places(rows, plan_rows, over)
    columns = [f.split()[0] for f in RESULT.split(", ")]
    planned = placed.where("stream IS NULL").select(*columns)
    if not line:
        return planned
    stays = placed.where("stream IS NOT NULL")
    if sum(n - over[length][0] for length, n in histogram.items()) <= MAX_KEYS // 8:  # 64 bytes a row
        stays = F.broadcast(stays)
    with_ids = held.where("ids IS NOT NULL").select("row", "ids").join(stays, "row")
    return planned.unionByName(_cut_line(with_ids, line, sequences, capacity).select(*columns))
