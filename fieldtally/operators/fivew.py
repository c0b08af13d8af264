"""The Who-What-Where-When-Whom matrix: distinct beneficiaries per place, month and activity.

Rows are unfolded by activity and reduced once to the distinct (keys, id, categories), with the number of rows each
stands for. This reduction is spread by id, combined before the shuffle and written to the shared folder; labels,
matrix and reach read it there. The matrix groups it by (keys, id) into one bit per category and then counts ids
and bits per keys, which gives the wide table at once: no pivot, no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.errors import NotComputable, ReportError
from fieldtally.functions.categories import category_key, ordered_labels
from fieldtally.functions.columns import col, families
from fieldtally.functions.dates import month_bucket, parse_dates
from fieldtally.functions.text import split_activities
from fieldtally.operators.measures import check_column
from fieldtally.plans.specs import five_w_problems
from fieldtally.session import staged

BITS = 62  # categories held by one bigint mask


@dataclass(frozen=True)
class FiveWSpec:
    where: list[str]
    when: str
    monthly: bool
    what: str
    split: str | None
    id_field: str
    dimensions: list[str]
    fixed: dict[str, object] = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return [*self.where, *(["Period"] if self.monthly else []), "Activity"]

    @property
    def base_columns(self) -> list[str]:
        return [*self.fixed, *self.keys, "Beneficiaries"]


def read_spec(spec: Mapping) -> FiveWSpec:
    problems = five_w_problems(spec)
    if problems:
        raise ReportError("the 5W spec is invalid:\n" + "\n".join(f"- {p}" for p in problems))
    whom = spec["whom"]
    return FiveWSpec(
        where=list(spec["where"]),
        when=spec["when"]["field"],
        monthly=spec["when"].get("granularity", "month") == "month",
        what=spec["what"]["field"],
        split=spec["what"].get("split"),
        id_field=whom["id_field"],
        dimensions=list(whom.get("disaggregation") or []),
        fixed=dict(spec.get("fixed") or {}),
    )


def check_columns(df: DataFrame, spec: FiveWSpec, pii: Sequence[str]) -> None:
    for name in [*spec.where, spec.when, spec.what, spec.id_field, *spec.dimensions]:
        try:
            check_column(df, name, pii)
        except NotComputable as problem:
            raise ReportError(f"the 5W cannot be made: {problem.reason}") from None


def _keys(df: DataFrame, spec: FiveWSpec) -> list[Column]:
    kinds = families(df)
    places = [category_key(col(name)).alias(name) for name in spec.where]
    if spec.monthly:
        places.append(month_bucket(parse_dates(col(spec.when), kinds[spec.when])).alias("Period"))
    return places


def activities(df: DataFrame, spec: FiveWSpec) -> Column:
    return split_activities(col(spec.what), spec.split)


def reach(df: DataFrame, spec: FiveWSpec) -> DataFrame:
    """One row: distinct beneficiaries with an activity, and rows without any."""
    size = F.size(activities(df, spec))
    marked = df.select(F.when(size > 0, col(spec.id_field)).alias("id"), (size == 0).alias("none"))
    by_id = marked.groupBy("id").agg(F.count_if("none").alias("none"))
    return by_id.agg(
        F.count("id").alias("unique_reach"),
        F.coalesce(F.sum("none"), F.lit(0)).alias("rows_without_activity"),
    )


def reduced(df: DataFrame, spec: FiveWSpec) -> DataFrame:
    """Distinct ``(keys, __id, __c0, __c1, ..)`` with the number of rows behind each; no activity is a NULL one."""
    facts = df.select(
        *_keys(df, spec), col(spec.id_field).alias("__id"),
        *(category_key(col(name)).alias(f"__c{n}") for n, name in enumerate(spec.dimensions)),
        activities(df, spec).alias("__activities"),
    )
    kept = [col(name) for name in facts.columns if name != "__activities"]
    rows = facts.select(*kept, F.explode_outer("__activities").alias("Activity"))
    return rows.groupBy(*map(col, rows.columns)).agg(F.count(F.lit(1)).alias("__rows"))


def categories(once: DataFrame, spec: FiveWSpec) -> dict[str, list[str]]:
    """Category labels per dimension among the reduced rows with an activity; they become output columns."""
    if not spec.dimensions:
        return {}
    labels = F.array(*(
        F.struct(F.lit(n).alias("at"), F.col(f"__c{n}").alias("label")) for n in range(len(spec.dimensions))
    ))
    found = once.filter(F.col("Activity").isNotNull()).select(F.inline(labels)).distinct().collect()
    return {
        name: ordered_labels([row.label for row in found if row.at == n])
        for n, name in enumerate(spec.dimensions)
    }


def matrix(once: DataFrame, spec: FiveWSpec, labels: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row per key set, sorted, from the reduced rows; absent categories are zero; constants first."""
    masks: dict[str, Column] = {}
    bits: list[tuple[str, str, int]] = []
    for at, name in enumerate(spec.dimensions):
        for start in range(0, len(labels[name]), BITS):
            chunk, mask = list(labels[name][start : start + BITS]), f"__m{at}_{start}"
            # a label is found by hash, not by trying one after the other
            places = F.create_map(*(F.lit(v) for bit, label in enumerate(chunk) for v in (label, 1 << bit)))
            masks[mask] = F.coalesce(F.try_element_at(places, F.col(f"__c{at}")).cast("bigint"), F.lit(0).cast("bigint"))
            bits += [(f"{name}={label}", mask, bit) for bit, label in enumerate(chunk)]
    keys = [col(key) for key in spec.keys]
    rows = once.filter(F.col("Activity").isNotNull())
    per_id = rows.groupBy(*keys, F.col("__id")).agg(
        F.max("__rows").alias("__rows"), *(F.bit_or(value).alias(mask) for mask, value in masks.items())
    )
    has_id = F.col("__id").isNotNull()
    table = per_id.groupBy(*keys).agg(
        F.count("__id").alias("Beneficiaries"),
        *(
            F.count_if(has_id & (F.col(mask).bitwiseAND(F.lit(1 << bit)) != 0)).alias(label)
            for label, mask, bit in bits
        ),
    )
    return table.select(
        *(F.lit(value).alias(name) for name, value in spec.fixed.items()), *map(col, table.columns)
    ).orderBy(*keys)


def reach_of(once: DataFrame) -> DataFrame:
    """One row from the reduced rows: distinct beneficiaries with an activity, and rows without any."""
    has = F.col("Activity").isNotNull()
    by_id = once.groupBy(F.when(has, F.col("__id")).alias("id")).agg(F.sum(F.when(~has, F.col("__rows"))).alias("none"))
    return by_id.agg(
        F.count("id").alias("unique_reach"), F.coalesce(F.sum("none"), F.lit(0)).alias("rows_without_activity")
    )


def five_w_facts(df: DataFrame, spec: Mapping, pii: Sequence[str] = ()) -> DataFrame:
    """``(keys, dimension, category, __id)`` of every row and activity; the rows without a dimension are the totals."""
    plan = read_spec(spec)
    check_columns(df, plan, pii)
    none = F.lit(None).cast("string")
    lanes = [F.struct(none.alias("dimension"), none.alias("category"))]
    lanes += [
        F.struct(F.lit(name).alias("dimension"), category_key(col(name)).alias("category"))
        for name in plan.dimensions
    ]
    facts = df.select(
        *_keys(df, plan), col(plan.id_field).alias("__id"), F.array(*lanes).alias("__lanes"),
        activities(df, plan).alias("__activities"),
    )
    kept = [col(name) for name in facts.columns if not name.startswith("__")]
    rows = facts.select(*kept, "__id", "__lanes", F.explode("__activities").alias("Activity"))
    return rows.select(*(col(key) for key in plan.keys), "__id", F.inline("__lanes"))


def five_w_long(df: DataFrame, spec: Mapping, pii: Sequence[str] = ()) -> DataFrame:
    """``(keys, dimension, category, beneficiaries)``: the same counts, any number of categories.

    The rows without a dimension are the totals. No label reaches the driver.
    """
    rows = five_w_facts(df, spec, pii).distinct()
    keys = [col(name) for name in rows.columns if name != "__id"]
    return rows.groupBy(*keys).agg(F.count("__id").alias("beneficiaries"))


@dataclass(frozen=True)
class FiveW:
    table: DataFrame
    summary: DataFrame


def five_w(
    df: DataFrame,
    spec: Mapping,
    pii: Sequence[str] = (),
    labels: Mapping[str, Sequence[str]] | None = None,
) -> FiveW:
    """The matrix, sorted by its keys, and its one-row summary.

    The source is read once: the reduced rows are written to the shared folder, and category labels (unless given),
    matrix and summary come from there.
    """
    plan = read_spec(spec)
    check_columns(df, plan, pii)
    once = staged(reduced(df, plan), "five-w")
    return FiveW(matrix(once, plan, categories(once, plan) if labels is None else labels), reach_of(once))
