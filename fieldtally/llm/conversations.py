"""Conversation structure repair: the cheapest edits that give a legal order of roles, and of those the least audit.

Legal is an optional ``system`` row and then ``user``, ``assistant`` in turns, up to an ``assistant``; nothing at all is legal,
too. A row is kept (K), given the role that is due (R) or deleted (D); a row with the role that is due may be inserted (I).
The *audit* is the string of these letters.

1. *Cost program.* Nodes are (row, what came last: nothing, s, u, a). Backwards over the rows, each node learns its cost to the
   end; the arcs that keep it are optimal. In one node a letter leads to one node.
2. *Prefix doubling.* Nodes are ranked by the least audit of one letter from them, then of 2, 4, 8, ... letters: the rank of
   twice the length is the pair (own rank, rank of the node that the pointer reaches), and the pointer of twice the length is
   the pointer's pointer. All conversations of a batch are ranked together.
3. *Path.* At each node the optimal arc with the least (letter, rank behind it) is taken; the path is laid out by pointers of
   halved lengths, so no step waits for the one before it.

Ordinary conversations are hashed to tasks whole. One of more than ``LONG_ROWS`` rows or ``LONG_CHARS`` characters (a NULL
conv_id can hold a third of all rows) is cut into pieces by ranges of its order: a piece is a 4 x 4 matrix of costs, matrices
give each piece its costs to the end, and the pieces are solved side by side. Only the hash of a whole text has no parallel
form: the repaired lines of such a conversation are streamed through one task in their order, never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.session import staged

DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
LONG_ROWS, LONG_CHARS = 100_000, 64 << 20
BLANKS = " \t\n\x0b\x0c\r"
LETTERS = "DIKR"
DUE = (2, 2, 3, 2)  # after nothing, s, u, a: the state that an inserted or changed row leads to
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))  # by state and the row's initial (s, u, a, other)
ROLE = ("", "", "user", "assistant")
NEVER = 1 << 60
DAMAGED = "conv_id long, turn long, role string, text string, copies int"
FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
RESULT = f"conv_id long, {FACTS}, audit string, repaired_sha256 string"
LINES = "conv_id long, part long, place long, edits string, role string, text string"


def damage(conversations: DataFrame) -> DataFrame:
    """Damage rows by crc32 of ``conv_id:turn`` modulo 20: conv_id, turn, role, text, copies (0: dropped, 2: repeated).

    A NULL counts as one blank, in the key and in role and text; rows with equal conv_id and turn share their damage.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("kind"),
    )
    kind = F.col("kind")
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


# ---------------------------------------------------------------- one batch of conversations


class Batch:
    """Rows of several conversations (or pieces of them), one after the other, and their cheapest edits."""

    def __init__(self) -> None:
        self.first: list[int] = []  # per conversation its first row
        self.initial: list[int] = []
        self.bad: list[bool] = []
        self.cut_off: list[bool] = []

    def begin(self) -> None:
        self.first.append(len(self.initial))

    def add(self, role: str, bad: bool, cut_off: bool) -> None:
        self.initial.append("sua".find(role[0]) if role and role[0] in "sua" else 3)
        self.bad.append(bad)
        self.cut_off.append(cut_off)

    def rows(self, k: int) -> range:
        return range(self.first[k], self.first[k + 1] if k + 1 < len(self.first) else len(self.initial))

    def _layer(self, row: int, later: list[int]) -> list[int]:
        """Costs to the end from before a row, without inserts, given those from behind it."""
        extra = CUT_OFF if self.cut_off[row] else 0
        if self.bad[row]:
            return [DELETE + c for c in later]
        kept = KEPT
        own = self.initial[row]
        return [
            min(DELETE + later[q], REROLE + extra + later[DUE[q]], extra + later[kept[q][own]] if kept[q][own] >= 0 else NEVER)
            for q in range(4)
        ]

    @staticmethod
    def _inserts(costs: list[int]) -> list[int]:
        costs[2] = min(costs[2], INSERT + costs[3])
        costs[3] = min(costs[3], INSERT + costs[2])
        return [min(costs[0], INSERT + costs[2]), min(costs[1], INSERT + costs[2]), costs[2], costs[3]]

    def costs(self, k: int, end: list[int]) -> list[int]:
        """Costs from before the first row of a piece, by state, if ``end`` are those behind its last."""
        for row in reversed(self.rows(k)):
            end = self._inserts(self._layer(row, end))
        return end

    def matrix(self, k: int) -> list[list[int]]:
        """Costs from each state before the piece (column) to each state behind it (row)."""
        return [self.costs(k, [0 if q == e else NEVER for q in range(4)]) for e in range(4)]

    def solve(self, ends: list[list[int] | None]) -> tuple[list[int], np.ndarray, list[int]]:
        """Costs before the first row of all pieces, the optimal arcs, and where each piece's nodes begin.

        ``ends`` are the costs behind each piece; None is the end of a conversation, where rows may still be inserted.
        Arcs are four places a node (D, I, K, R) with the node they lead to, or -1.
        """
        arcs: list[tuple[int, int, int, int]] = []
        whole, base = [], []
        for k, end in enumerate(ends):
            layers = [[0, NEVER, NEVER, 0] if end is None else list(end)]
            if end is None:
                layers[0] = self._inserts(layers[0])
            span = self.rows(k)
            for row in reversed(span):
                layers.append(self._inserts(self._layer(row, layers[-1])))
            layers.reverse()
            at = len(arcs)
            base.append(at)
            whole += layers[0]
            for n, row in enumerate(span):
                arcs += self._arcs(row, layers[n], layers[n + 1], at + 4 * n)
            last = layers[-1]
            here = at + 4 * len(span)
            for q in range(4):
                more = end is None and last[q] < NEVER and last[q] == INSERT + last[DUE[q]]
                arcs.append((-1, here + DUE[q] if more else -1, -1, -1))
        return whole, np.asarray(arcs, np.int64).reshape(-1, 4), base

    def _arcs(self, row: int, now: list[int], later: list[int], here: int) -> list[tuple[int, int, int, int]]:
        extra = CUT_OFF if self.cut_off[row] else 0
        free, own, behind = not self.bad[row], self.initial[row], here + 4
        out = []
        for q in range(4):
            c, due, kept = now[q], DUE[q], KEPT[q][own]
            if c >= NEVER:
                out.append((-1, -1, -1, -1))
                continue
            out.append((
                behind + q if DELETE + later[q] == c else -1,
                here + due if INSERT + now[due] == c else -1,
                behind + kept if free and kept >= 0 and extra + later[kept] == c else -1,
                behind + due if free and REROLE + extra + later[due] == c else -1,
            ))
        return out


def ranks(arcs: np.ndarray) -> tuple[np.ndarray, int]:
    """Every node's rank among all by the least audit from it to the end, and how often lengths were doubled."""
    nodes = np.arange(len(arcs))
    optimal = arcs >= 0
    rank = np.where(optimal.any(1), optimal.argmax(1) + 1, 0)  # by one letter; 0 is the end
    pointer = np.where(rank > 0, arcs[nodes, np.maximum(rank - 1, 0)], nodes)
    done, levels = rank == 0, 0
    while not done[pointer].all():
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        pointer, levels = pointer[pointer], levels + 1
    rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
    return rank, levels + 1


def _least(arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Per node whether it is an end, the letter to take and where that leads; and how often to double."""
    nodes = np.arange(len(arcs))
    rank, levels = ranks(arcs)
    optimal = arcs >= 0
    ended = ~optimal.any(1)
    letter = np.where(optimal, np.arange(4) * (rank.max(initial=0) + 1) + rank[arcs], NEVER).argmin(1)
    return ended, letter, np.where(ended, nodes, arcs[nodes, letter]), levels


def least_paths(arcs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (ends left out) and letters of the least paths from all ``starts``, one path after the other."""
    ended, letter, pointer, levels = _least(arcs)
    pointers = [pointer]
    for _ in range(levels):
        pointers.append(pointers[-1][pointers[-1]])
    path = starts[~ended[starts]]
    for pointer in reversed(pointers):
        path = np.column_stack([path, pointer[path]]).ravel()
        path = path[~ended[path]]
    return path, letter[path]


def exits(arcs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The end nodes that the least paths from ``starts`` reach."""
    _, _, pointer, levels = _least(arcs)
    for _ in range(levels + 1):
        pointer = pointer[pointer]
    return pointer[starts]


class Counts:
    """Faults of a conversation's rows, taken in order."""

    def __init__(self) -> None:
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.role: str | None = None
        self.head: str | None = None
        self.head_turn = None

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> tuple[bool, bool]:
        """Count a row; returns whether it has to go and whether its text is cut off."""
        if turn is not None:
            if self.turn != turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        initial = role[:1]
        if self.role is None:
            self.head = initial
        elif self.role + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = initial
        words = text.strip(BLANKS)
        blank = not words
        duplicate = not blank and seen
        cut_off = not blank and not duplicate and words[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut_off
        return blank or duplicate, cut_off

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _edited(batch: Batch, base: list[int], path: np.ndarray, letters: np.ndarray, rows: list[tuple]) -> Iterator[tuple[int, str, str | None, str | None]]:
    """(conversation, letter, role, text) of every edit in order; a deleted row has no role."""
    owner = np.searchsorted(base, path, side="right") - 1
    for k, node, letter in zip(owner.tolist(), path.tolist(), letters.tolist()):
        n, q = divmod(node - base[k], 4)
        if letter == 1:
            yield k, "I", ROLE[DUE[q]], ""
        else:
            role, text = rows[batch.first[k] + n]
            yield (k, "D", None, None) if letter == 0 else (k, "K", role, text) if letter == 2 else (k, "R", ROLE[DUE[q]], text)


# ---------------------------------------------------------------- Spark


def _conversations(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows that come sorted by ``keys``, conversation by conversation, whatever batch they came in."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    return groupby(rows(), key=lambda r: tuple(r[k] for k in keys))


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Counts, int, list[tuple]]]:
    """(conv_id, counts, cost, edits) of conversations that a task holds whole, some thousand rows at a time."""
    batch, rows, held, size = Batch(), [], [], 0

    def flush():
        whole, arcs, base = batch.solve([None] * len(held))
        path, letters = least_paths(arcs, np.asarray(base, np.int64))
        made: list[list] = [[] for _ in held]
        for k, *edit in _edited(batch, base, path, letters, rows):
            made[k].append(edit)
        for k, (conv_id, counts) in enumerate(held):
            yield conv_id, counts, whole[4 * k], made[k]

    for (conv_id,), group in _conversations(batches, "conv_id"):
        counts, seen = Counts(), set()
        batch.begin()
        for r in group:
            for _ in range(r["copies"]):
                own = (r["role"], r["text"])
                batch.add(r["role"], *counts.add(r["turn"], *own, own in seen))
                seen.add(own)
                rows.append(own)
                size += len(own[1])
        held.append((conv_id, counts))
        if len(rows) > 4000 or size > 16 << 20 or len(held) > 4000:
            yield from flush()
            batch, rows, held, size = Batch(), [], [], 0
    if held:
        yield from flush()


def _split(damaged: DataFrame, long_rows: int, long_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Ordinary conversations, and those that are too long for one task (None without any)."""
    sizes = damaged.groupBy(F.col("conv_id").alias("_long")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    long = sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select("_long")
    names = [r[0] for r in long.collect()]  # at most a row per long_rows rows or long_chars characters
    if not names:
        return damaged, None
    listed = F.broadcast(damaged.sparkSession.createDataFrame([(n,) for n in names], "_long long"))
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    return damaged.join(listed, same, "left_anti"), damaged.join(listed, same, "left_semi")


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def repair(damaged: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """Per conversation its faults, the cost and audit of the cheapest repair, and the hash of the repaired text.

    Takes conv_id, turn, role, text and copies (how often the row stands there; 0 only names the conversation). Rows are in order
    of turn (NULL first), those of one turn in order of role, then text. Rows with a NULL conv_id are one conversation, a role or
    text is never NULL here (``damage`` gives a blank), repeated rows are duplicates, an empty table gives no rows, further
    columns are ignored, and texts and conversations of any length are repaired whole.
    """
    rows = damaged.select("conv_id", "turn", "role", "text", "copies")
    ordinary, long = _split(rows, long_rows, long_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for conv_id, c, cost, edits in _repair_whole(batches):
            text = "\n".join(f"{role}:{text}" for _, role, text in edits if role is not None)
            made.append((conv_id, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost, "".join(e[0] for e in edits), _sha(text)))
            if len(made) >= 4000:
                yield _rows(made, RESULT)
                made = []
        yield _rows(made, RESULT)

    found = ordinary.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).mapInArrow(run, RESULT)
    if long is None:
        return found
    facts, lines = _repair_long(long)
    return found.unionByName(_joined(lines, facts))


def repaired_rows(damaged: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """The rows of all repaired conversations: conv_id, part, place (ordered within conv_id), edits (the letters since the row
    before, this row's last), role, text; deletions behind the last row come with a NULL role. Cases as in ``repair``."""
    rows = damaged.select("conv_id", "turn", "role", "text", "copies")
    ordinary, long = _split(rows, long_rows, long_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, _, _, edits in _repair_whole(batches):
            yield _rows(list(_lines(conv_id, 0, edits)), LINES)

    found = ordinary.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).mapInArrow(run, LINES)
    return found if long is None else found.unionByName(_repair_long(long)[1])


def _lines(conv_id: int | None, part: int, edits) -> Iterator[tuple]:
    waiting, place = "", 0
    for letter, role, text in edits:
        waiting += letter
        if role is not None:
            yield conv_id, part, place, waiting, role, text
            waiting, place = "", place + 1
    if waiting:
        yield conv_id, part, place, waiting, None, None


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f[1]]) for c, f in zip(columns, fields)], names=[f[0] for f in fields])


# ---------------------------------------------------------------- conversations beyond one task

PIECE = ("conv_id long, part long, low long, high long, turns long, head string, tail string, "
         + "blank long, duplicate long, truncated long, illegal long, " + ", ".join(f"m{k} long" for k in range(16)))


def _repair_long(long: DataFrame) -> tuple[list[tuple], DataFrame]:
    """Facts of each long conversation, and its repaired lines by piece."""
    spark = long.sparkSession
    runs = staged(  # equal rows meet as counts
        long.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "repair-runs"
    )
    there = runs.where("copies > 0")
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    firsts = (
        there.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("text").alias("_text"))
        .agg(F.min(turn).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    seen = F.coalesce(turn > F.col("_first"), F.lit(False))
    flagged = there.join(firsts, same, "left").select("conv_id", "turn", "role", "text", "copies", seen.alias("seen"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranges = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.left("text", F.lit(200)).asc()]
    pieces = staged(
        staged(flagged, "repair-rows").repartitionByRange(parts, *ranges).withColumn("part", F.spark_partition_id().cast("long")),
        "repair-pieces",
    )
    in_order = pieces.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", *_order())

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv_id, part), group in _conversations(batches, "conv_id", "part"):
            batch, counts, _ = _piece(group)
            matrix = [c for line in batch.matrix(0) for c in line]
            yield _rows([(conv_id, part, counts.low, counts.high, counts.turns, counts.head, counts.role,
                          counts.blank, counts.duplicate, counts.truncated, counts.illegal, *(min(c, NEVER) for c in matrix))], PIECE)

    known: dict = {}
    names = {r[0] for r in runs.select("conv_id").distinct().collect()}  # long conversations only
    for r in sorted(in_order.mapInArrow(summarise, PIECE).collect(), key=lambda r: r["part"]):  # a row per conversation and partition
        known.setdefault(r["conv_id"], []).append(r)
    facts, plan = [], {}
    for conv_id in names:
        own = known.get(conv_id, [])
        end = None
        for r in reversed(own):
            plan[conv_id, r["part"]] = end
            behind = Batch._inserts([0, NEVER, NEVER, 0]) if end is None else end
            end = [min(r[f"m{4 * e + q}"] + behind[e] for e in range(4)) for q in range(4)]
        facts.append((conv_id, *_total(own), end[0] if end else 0))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv_id, part), group in _conversations(batches, "conv_id", "part"):
            batch, _, _ = _piece(group)
            _, arcs, base = batch.solve([plan[conv_id, part]])
            found = (exits(arcs, np.arange(4)) % 4).tolist()
            yield _rows([(conv_id, part, *found)], "conv_id long, part long, e0 long, e1 long, e2 long, e3 long")

    leads = {(r[0], r[1]): r[2:] for r in in_order.mapInArrow(reach, "conv_id long, part long, e0 long, e1 long, e2 long, e3 long").collect()}
    entry = {}
    for conv_id, own in known.items():
        state = 0
        for r in own:
            entry[conv_id, r["part"]] = state
            state = leads[conv_id, r["part"]][state]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv_id, part), group in _conversations(batches, "conv_id", "part"):
            batch, _, rows = _piece(group, True)
            _, arcs, base = batch.solve([plan[conv_id, part]])
            path, letters = least_paths(arcs, np.asarray([entry[conv_id, part]]))
            made: list[tuple] = []
            for line in _lines(conv_id, part, (edit[1:] for edit in _edited(batch, base, path, letters, rows))):
                made.append(line)
                if len(made) >= 2000:
                    yield _rows(made, LINES)
                    made = []
            yield _rows(made, LINES)

    return facts, in_order.mapInArrow(lay, LINES)


def _piece(group: Iterator[dict], with_rows: bool = False) -> tuple[Batch, Counts, list[tuple]]:
    batch, counts, rows = Batch(), Counts(), []
    batch.begin()
    for r in group:
        for copy in range(r["copies"]):
            batch.add(r["role"], *counts.add(r["turn"], r["role"], r["text"], r["seen"] or copy > 0))
            if with_rows:
                rows.append((r["role"], r["text"]))
    return batch, counts, rows


def _total(pieces: list) -> tuple[int, int, int, int, int]:
    """Gaps, blank, duplicate, truncated and illegal over the pieces of a conversation, in order."""
    illegal = sum(r["illegal"] for r in pieces)
    for a, b in zip(pieces, pieces[1:]):
        illegal += a["tail"] + b["head"] not in ("su", "ua", "au")
    dated = [r for r in pieces if r["low"] is not None]
    turns = sum(r["turns"] for r in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
    gaps = dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0
    return gaps, *(sum(r[c] for r in pieces) for c in ("blank", "duplicate", "truncated")), illegal


def _joined(lines: DataFrame, facts: list[tuple]) -> DataFrame:
    """The result rows of long conversations: their lines are streamed in order through one hash each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv_id,), group in _conversations(batches, "conv_id"):
            digest, audit, first = hashlib.sha256(), [], True
            for r in group:
                audit.append(r["edits"])
                if r["role"] is not None:
                    digest.update(("" if first else "\n").encode() + f"{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
                    first = False
            yield _rows([(conv_id, "".join(audit), digest.hexdigest())], "conv_id long, audit string, repaired_sha256 string")

    hashed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(
        run, "conv_id long, audit string, repaired_sha256 string")
    known = lines.sparkSession.createDataFrame(
        facts, "_conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    joined = F.broadcast(known).join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select(
        F.col("_conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_sha(""))).alias("repaired_sha256"),
    )


ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations
),
kinds AS (  -- crc32, a byte and then a bit at a time
  SELECT *, xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda d, z: xor(d >> 1, (d & 1) * 3988292384::BIGINT)))) % 20 AS kind
  FROM keyed
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank
  FROM damaged
),
marked AS (
  SELECT *, NOT is_blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS is_dup,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed
),
judged AS (
  SELECT *, NOT is_blank AND NOT is_dup
    AND regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') AS is_cut
  FROM marked
),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_dup) AS duplicate, count(*) FILTER (is_cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
),
states(q, due, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
kept(q, initial, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(q, z, cost, letters, lines) AS (
  SELECT q, q, 0, '', []::VARCHAR[] FROM states
  UNION ALL SELECT q, due, 3, 'I', [role || ':'] FROM states
  UNION ALL SELECT a.q, b.due, 6, 'II', [a.role || ':', b.role || ':'] FROM states a JOIN states b ON a.due = b.q
),
steps(conv_id, pos, q, best) AS (
  SELECT conv_id, 0::BIGINT, z, {'cost': cost, 'audit': letters, 'lines': lines} FROM counted, inserts WHERE inserts.q = 0
  UNION ALL
  SELECT conv_id, pos, q, min(best) FROM (
    SELECT e.conv_id, e.pos, i.z AS q, {'cost': e.cost + i.cost, 'audit': e.audit || i.letters, 'lines': list_concat(e.lines, i.lines)} AS best
    FROM (
      SELECT s.conv_id, r.pos, s.q, s.best.cost + 4 AS cost, s.best.audit || 'D' AS audit, s.best.lines AS lines
      FROM steps s JOIN judged r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos + 1
      UNION ALL
      SELECT s.conv_id, r.pos, k.z, s.best.cost + CASE WHEN is_cut THEN 3 ELSE 0 END, s.best.audit || 'K',
        list_append(s.best.lines, r.role || ':' || r.text)
      FROM steps s JOIN judged r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos + 1 AND NOT is_blank AND NOT is_dup
      JOIN kept k ON k.q = s.q AND k.initial = r.initial
      UNION ALL
      SELECT s.conv_id, r.pos, t.due, s.best.cost + 3 + CASE WHEN is_cut THEN 3 ELSE 0 END, s.best.audit || 'R',
        list_append(s.best.lines, t.role || ':' || r.text)
      FROM steps s JOIN judged r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos + 1 AND NOT is_blank AND NOT is_dup
      JOIN states t ON t.q = s.q
    ) e JOIN inserts i ON i.q = e.q
  ) GROUP BY conv_id, pos, q
),
finished AS (
  SELECT s.conv_id, min(s.best) AS best FROM steps s JOIN counted c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.pos
  WHERE s.q IN (0, 3) GROUP BY s.conv_id
)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
  coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(f.best.cost, 0)::BIGINT AS cost,
  coalesce(f.best.audit, '') AS audit, sha256(coalesce(array_to_string(f.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN finished f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""
