"""Measures: ``count``, ``count_unique``, ``sum`` and ``percent`` over one table, by lanes.

A *lane* is the whole table or one breakdown column. All measures of a table are computed together, in
one scan:

1. each row is reduced to its categories, one bit mask per id field (a bit per condition it meets) and the
   numbers to add up;
2. it is unfolded into one narrow record per lane and id field;
3. records are grouped by (lane, category, id) with ``bit_or`` - combined before the shuffle, and spread
   by id, so neither a dominant category nor an id with a third of the rows lands in one task;
4. a second grouping by (lane, category) counts the bits.

Several ``count(DISTINCT ...)`` in one query would instead multiply every full row by the number of
distinct sets. Conditions are never used to drop rows, so a category whose rows all fail still appears
with zero.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.errors import NotComputable
from fieldtally.functions.categories import category_key
from fieldtally.functions.columns import col, families, sql_text
from fieldtally.functions.numbers import to_number
from fieldtally.operators.filters import NEXT_STEP, SEE_COLUMNS, Membership, compile_filter, with_memberships

BITS = 62  # conditions held by one bigint mask
LANE, CATEGORY = "__lane", "__category"
ZERO_DENOMINATOR = "the denominator is 0: there is nothing to divide by"


@dataclass(frozen=True)
class Rows:
    """Rows that pass the filter; with a field, only those where it has a value."""

    field: str | None
    where: str | None


@dataclass(frozen=True)
class Distinct:
    """Distinct non-missing values of a field among the rows that pass the filter."""

    field: str
    where: str | None


@dataclass(frozen=True)
class Total:
    """Sum of a field, with the number of its non-numeric values."""

    field: str
    where: str | None


Part = Rows | Distinct | Total


@dataclass(frozen=True)
class Result:
    """SQL expressions over one row of the counts: the value, and why there is none."""

    value: str
    reason: str


class Conditions:
    """The filters of one table, each compiled once."""

    def __init__(self, df: DataFrame, pii: Sequence[str]) -> None:
        self.df, self.pii = df, pii
        self._known: dict[str | None, tuple[Column, list[Membership]]] = {}

    def __getitem__(self, where: str | None) -> tuple[Column, list[Membership]]:
        if where not in self._known:
            within = (F.col(LANE), F.col(CATEGORY))
            self._known[where] = compile_filter(
                self.df, where, self.pii, within, f"__in_{len(self._known)}"
            )
        return self._known[where]


def check_column(df: DataFrame, column: object, pii: Sequence[str]) -> str:
    """The column's exact name, or the reason why a report cannot use it."""
    if not column or not isinstance(column, str):
        raise NotComputable("a column name is missing")
    usable = column in df.columns and column not in pii
    if not usable:
        why = f"holds personal data, which no report may use; {NEXT_STEP}" if column in pii else f"is no column of the dataset ({SEE_COLUMNS})"
        raise NotComputable(f"{column!r} {why}")
    return column


def parts_of(measure: Mapping, conditions: Conditions) -> tuple[Part, ...]:
    """What has to be counted for a measure, its columns and filters checked; no job runs."""
    df, pii = conditions.df, conditions.pii
    aggregation = measure.get("aggregation")
    if aggregation == "percent":
        parts = []
        for key in ("numerator", "denominator"):
            block = measure.get(key)
            if not isinstance(block, Mapping):
                raise NotComputable(f"a percentage without its {key}")
            parts.append(Distinct(check_column(df, block.get("field"), pii), block.get("filter") or None))
    else:
        field, where = measure.get("field"), measure.get("filter") or None
        if field is not None:
            field = check_column(df, field, pii)
        if aggregation == "count":
            parts = [Rows(field, where)]
        elif aggregation not in ("count_unique", "sum"):
            conditions[where]
            raise NotComputable(f"{aggregation!r} is no aggregation")
        elif field is None:
            raise NotComputable(f"{aggregation} is of one column, and none is named")
        else:
            parts = [Distinct(field, where) if aggregation == "count_unique" else Total(field, where)]
    for part in parts:
        conditions[part.where]
    return tuple(parts)


class Tally:
    """The counts of a set of parts per lane and category, and how to read them."""

    def __init__(
        self,
        conditions: Conditions,
        lanes: Sequence[str | None],
        parts: Mapping[str | None, Iterable[Part]],
    ) -> None:
        self.lanes = list(lanes)
        self._bits: dict[Distinct, tuple[int, int]] = {}
        self._sums: dict[Part, int] = {}
        self._slots: dict[tuple[str, int], int] = {}
        for part in dict.fromkeys(p for lane in self.lanes for p in parts.get(lane, ())):
            if isinstance(part, Distinct):
                earlier = sum(p.field == part.field for p in self._bits)
                slot = self._slots.setdefault((part.field, earlier // BITS), len(self._slots))
                self._bits[part] = (slot, earlier % BITS)
            else:
                self._sums[part] = len(self._sums)
        self._order = list(self._bits)
        wanted = {
            number: {self._bits[p][0] for p in parts.get(lane, ()) if p in self._bits}
            for number, lane in enumerate(self.lanes)
        }
        self.frame = self._counted(self._unfolded(conditions, wanted))

    # -- the plan -------------------------------------------------------------------------
    def _unfolded(self, conditions: Conditions, wanted: Mapping[int, set[int]]) -> DataFrame:
        df = conditions.df
        lanes = F.array(*(
            F.struct(
                F.lit(n).alias(LANE),
                (F.lit(None).cast("string") if lane is None else category_key(col(lane))).alias(CATEGORY),
            )
            for n, lane in enumerate(self.lanes)
        ))
        parts = [*self._bits, *self._sums]
        needed = [m for where in dict.fromkeys(p.where for p in parts) for m in conditions[where][1]]
        if needed:
            # membership is decided within each lane and category, so lanes come first
            df = with_memberships(df.select("*", F.inline(lanes)), needed)
            narrow = df.select(LANE, CATEGORY, *self._facts(conditions))
        else:
            narrow = df.select(lanes.alias("__lanes"), *self._facts(conditions))
            kept = [F.col(c) for c in narrow.columns if c != "__lanes"]
            narrow = narrow.select(F.inline("__lanes"), *kept)
        sums = self._sum_names()
        if not self._slots:
            return narrow.select(LANE, CATEGORY, *sums)
        id_type = next(f.dataType for f in narrow.schema.fields if f.name == "id0")
        none = F.lit(None).cast(id_type)
        slots = [F.struct(F.lit(-1).alias("slot"), none.alias("id"), F.lit(0).cast("bigint").alias("mask"))]
        slots += [
            F.struct(F.lit(n).alias("slot"), F.col(f"id{n}").alias("id"), F.col(f"mask{n}").alias("mask"))
            for n in self._slots.values()
        ]
        rows = narrow.select(LANE, CATEGORY, F.inline(F.array(*slots)), *sums)
        if any(len(found) < len(self._slots) for found in wanted.values()):
            used = [
                (F.col(LANE) == lane) & F.col("slot").isin(*sorted(found))
                for lane, found in wanted.items() if found
            ]
            rows = rows.filter(reduce(operator.or_, used, F.col("slot") == -1))
        # a row that meets no condition shares one group per category instead of carrying its id
        return rows.select(
            LANE, CATEGORY, "slot", F.when(F.col("mask") != 0, F.col("id")).alias("id"), "mask",
            *(F.when(F.col("slot") == -1, F.col(name)).alias(name) for name in sums),
        )

    def _facts(self, conditions: Conditions) -> list[Column]:
        """Per row: id and condition mask of every slot, and the numbers to add."""
        df, kinds = conditions.df, families(conditions.df)
        one_type = len({df.schema[p.field].dataType for p in self._bits}) <= 1
        facts = []
        for (field, _), slot in self._slots.items():
            bits = [
                F.when(conditions[p.where][0], F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint")
                for p, (at, bit) in self._bits.items() if at == slot
            ]
            value = col(field) if one_type else col(field).cast("string")
            mask = F.when(col(field).isNotNull(), reduce(operator.add, bits))
            facts += [value.alias(f"id{slot}"), F.coalesce(mask, F.lit(0)).alias(f"mask{slot}")]
        for part, n in self._sums.items():
            passes = conditions[part.where][0]
            if isinstance(part, Rows):
                if part.field is not None:
                    passes = passes & col(part.field).isNotNull()
                facts.append(F.when(passes, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias(f"s{n}"))
                continue
            number = to_number(col(part.field), kinds[part.field])
            facts.append(F.when(passes, number).alias(f"s{n}"))
            if kinds[part.field] in ("whole", "real", "bool"):
                facts.append(F.lit(0).cast("bigint").alias(f"bad{n}"))
            else:
                bad = passes & col(part.field).isNotNull() & number.isNull()
                facts.append(F.when(bad, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias(f"bad{n}"))
        return facts

    def _counted(self, rows: DataFrame) -> DataFrame:
        sums = self._sum_names()
        if self._slots:
            rows = rows.groupBy(LANE, CATEGORY, "slot", "id").agg(
                F.bit_or("mask").alias("mask"), *(F.sum(name).alias(name) for name in sums)
            )
        if self.lanes[0] is None:
            # the whole-table lane reports zero even for a table without rows
            empty = {LANE: F.lit(0), "slot": F.lit(-1), "mask": F.lit(0).cast("bigint")}
            seed = rows.sparkSession.range(1).select(*(
                empty.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema.fields
            ))
            rows = rows.unionByName(seed)
        counts = [
            F.expr(f"count_if(slot = {slot} AND mask & {1 << bit}L != 0) AS d{n}")
            for n, (slot, bit) in enumerate(self._bits.values())
        ]
        totals = [F.expr(f"coalesce(sum({name}), 0) AS {name}") for name in sums]
        keys = rows.groupBy(LANE, CATEGORY)
        return keys.agg(*counts, *totals) if counts or totals else rows.select(LANE, CATEGORY).distinct()

    def _sum_names(self) -> list[str]:
        return [
            name
            for part, n in self._sums.items()
            for name in ((f"s{n}", f"bad{n}") if isinstance(part, Total) else (f"s{n}",))
        ]

    # -- reading it -------------------------------------------------------------------------
    def lane_number(self, lane: str | None) -> int:
        return self.lanes.index(lane)

    def result(self, measure: Mapping, parts: Sequence[Part]) -> Result:
        """Value and reason of a measure on one (lane, category) row of ``frame``."""
        none = "CAST(NULL AS STRING)"
        if measure["aggregation"] == "percent":
            top, bottom = (f"d{self._order.index(p)}" for p in parts)
            return Result(
                f"CASE WHEN {bottom} > 0 THEN 100.0D * {top} / {bottom} END",
                f"CASE WHEN {bottom} = 0 THEN {sql_text(ZERO_DENOMINATOR)} END",
            )
        (part,) = parts
        if isinstance(part, Distinct):
            return Result(f"CAST(d{self._order.index(part)} AS DOUBLE)", none)
        number = self._sums[part]
        if isinstance(part, Rows):
            return Result(f"CAST(s{number} AS DOUBLE)", none)
        has, unfit = sql_text(f"column {part.field!r} has "), sql_text(" non-numeric values: it cannot be summed")
        return Result(
            f"CASE WHEN bad{number} = 0 THEN CAST(s{number} AS DOUBLE) END",
            f"CASE WHEN bad{number} > 0 THEN concat({has}, bad{number}, {unfit}) END",
        )


def evaluate_measure(df: DataFrame, measure: Mapping, pii: Sequence[str] = ()) -> DataFrame:
    """One row ``(value, reason)`` for one measure over the whole table."""
    conditions = Conditions(df, pii)
    parts = parts_of(measure, conditions)
    tally = Tally(conditions, [None], {None: parts})
    result = tally.result(measure, parts)
    return tally.frame.select(F.expr(result.value).alias("value"), F.expr(result.reason).alias("reason"))
