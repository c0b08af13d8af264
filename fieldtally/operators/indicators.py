"""Indicators of one table: headline values, progress, and breakdowns, from one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.errors import NotComputable
from fieldtally.functions.columns import sql_number, sql_text
from fieldtally.operators.measures import (
    CATEGORY, LANE, Conditions, Part, Result, Tally, check_column, parts_of,
)

COMPUTED, NOT_COMPUTABLE = "computed", "not_computable"
BREAKDOWN_SCHEMA = (
    "position int, code string, dimension string, category string, value double, reason string"
)


@dataclass
class Entry:
    """One registry item and what is already known about it before any job."""

    position: int
    item: Mapping
    dataset: str | None = None
    reason: str | None = None
    parts: tuple[Part, ...] = ()
    dimensions: list[str] = field(default_factory=list)
    refused: dict[str, str] = field(default_factory=dict)


def entry_for(position: int, item: Mapping, conditions: Conditions, dataset: str) -> Entry:
    """Check the measure and every dimension; a bad dimension costs only its own breakdown."""
    entry = Entry(position, item, dataset)
    try:
        entry.parts = parts_of(item["measure"], conditions)
    except NotComputable as problem:
        entry.reason = problem.reason
        return entry
    for dimension in dict.fromkeys(item.get("disaggregation") or []):
        try:
            entry.dimensions.append(check_column(conditions.df, dimension, conditions.pii))
        except NotComputable as problem:
            entry.refused[dimension] = problem.reason
    return entry


def _record(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def _unfold(records: Sequence[str]) -> Column:
    return F.expr(f"inline(array({', '.join(records)}))")


def summary_record(entry: Entry, result: Result) -> str:
    """The summary record of one indicator."""
    target, name = entry.item.get("target") or {}, entry.item.get("name") or {}
    goal, actual = sql_number(target.get("value")), f"IF(({result.reason}) IS NULL, {result.value}, NULL)"
    return _record(
        position=str(entry.position),
        code=sql_text(entry.item.get("code")),
        name_uk=sql_text(name.get("uk")),
        name_en=sql_text(name.get("en")),
        dataset=sql_text(entry.dataset),
        target=goal,
        unit=sql_text(target.get("unit")),
        actual=actual,
        progress_pct=f"round(100.0D * {actual} / nullif({goal}, 0.0D), 1)",
        status=f"IF(({result.reason}) IS NULL, '{COMPUTED}', '{NOT_COMPUTABLE}')",
        reason=result.reason,
    )


def known_rows(spark: SparkSession, entries: Sequence[Entry]) -> DataFrame:
    """Summary rows of indicators that fail before any job; as many as the registry lists."""
    return spark.range(1).select(
        _unfold([summary_record(e, Result(sql_number(None), sql_text(e.reason))) for e in entries])
    )


class IndicatorRun:
    """All indicators of one table. ``counts`` is the one distributed result; the rest reads it."""

    def __init__(self, entries: Sequence[Entry], conditions: Conditions) -> None:
        self.spark = conditions.df.sparkSession
        self.failed = [e for e in entries if e.reason is not None]
        self.open = [e for e in entries if e.reason is None]
        lanes: list[str | None] = [None, *dict.fromkeys(d for e in self.open for d in e.dimensions)]
        parts: dict[str | None, list[Part]] = {lane: [] for lane in lanes}
        for entry in self.open:
            for lane in (None, *entry.dimensions):
                parts[lane] += entry.parts
        self.tally = Tally(conditions, lanes, parts) if self.open else None
        self.counts = self.tally.frame if self.tally else None

    def _result(self, entry: Entry) -> Result:
        return self.tally.result(entry.item["measure"], entry.parts)

    def summary(self) -> DataFrame:
        """``(position, code, name_uk, name_en, dataset, target, unit, actual, progress_pct, status, reason)``."""
        frames = []
        if self.open:
            totals = self.counts.filter(F.col(LANE) == 0)
            frames.append(totals.select(_unfold([summary_record(e, self._result(e)) for e in self.open])))
        if self.failed:
            frames.append(known_rows(self.spark, self.failed))
        return reduce(DataFrame.unionByName, frames)

    def breakdown(self) -> DataFrame:
        """``(position, code, dimension, category, value, reason)``, for computed indicators only.

        A dimension that cannot be used has one row with its reason and no category.
        """
        frames = []
        lanes = self.tally.lanes[1:] if self.tally else []
        if lanes:
            cases = []
            for lane in lanes:
                records = [
                    self._breakdown_record(e, lane, CATEGORY, self._result(e))
                    for e in self.open if lane in e.dimensions
                ]
                cases.append(f"WHEN {self.tally.lane_number(lane)} THEN array({', '.join(records)})")
            chosen = F.expr(f"inline(CASE {LANE} {' '.join(cases)} END)")
            frames.append(self.counts.filter(F.col(LANE) > 0).select(chosen))
        refusals = [
            self._breakdown_record(e, d, sql_text(None), Result(sql_number(None), sql_text(why)))
            for e in self.open for d, why in e.refused.items()
        ]
        if refusals:
            frames.append(self.spark.range(1).select(_unfold(refusals)))
        if not frames:
            return self.spark.createDataFrame([], BREAKDOWN_SCHEMA)
        out = reduce(DataFrame.unionByName, frames)
        if any(e.item["measure"]["aggregation"] in ("percent", "sum") for e in self.open):
            # these can still fail on the data; the summary has one row per registry item
            good = self.summary().filter(F.col("status") == COMPUTED).select("position")
            out = out.join(F.broadcast(good), "position", "left_semi")
        return out

    @staticmethod
    def _breakdown_record(entry: Entry, dimension: str, category: str, result: Result) -> str:
        return _record(
            position=str(entry.position),
            code=sql_text(entry.item["code"]),
            dimension=sql_text(dimension),
            category=category,
            value=f"IF(({result.reason}) IS NULL, {result.value}, NULL)",
            reason=result.reason,
        )


def evaluate_indicators(
    df: DataFrame, items: Sequence[Mapping], pii: Sequence[str] = (), dataset: str = "dataset"
) -> IndicatorRun:
    conditions = Conditions(df, pii)
    return IndicatorRun([entry_for(n, item, conditions, dataset) for n, item in enumerate(items)], conditions)
