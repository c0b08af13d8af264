"""Cleaning steps and the account of what each one changed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.categories import spelling_key
from fieldtally.functions.columns import col, families
from fieldtally.functions.dates import parse_dates
from fieldtally.operators.rowids import ROW_ID, derived_ids, keep_first, unique_id
from fieldtally.operators.variants import one_script, roots
from fieldtally.session import staged

BROADCAST_SPELLINGS = 100_000  # mapping rows that fit every executor with ease
MAX_SPELLING = 1_000  # characters; longer variants go through the shuffled join


def within(value: Column, low: object, high: object) -> Column:
    """True inside the bounds; an end given as None is open."""
    test = F.lit(True)
    if low is not None:
        test = test & (value >= F.lit(low))
    if high is not None:
        test = test & (value <= F.lit(high))
    return test


def impossible(name: str, bounds: Sequence) -> Column:
    """True where a value is present and outside its bounds."""
    return col(name).isNotNull() & ~within(col(name), *bounds)


def impossible_to_null(df: DataFrame, bounds: Mapping[str, Sequence]) -> DataFrame:
    return df.withColumns({
        name: F.when(within(col(name), *limits), col(name)) for name, limits in bounds.items()
    })


def implausible_date(df: DataFrame, name: str, bounds: Sequence) -> Column:
    """True where a date is present, readable and outside ``[first day, last day]``."""
    moment = parse_dates(col(name), families(df)[name])
    low, high = (None if b is None else F.lit(str(b)).cast("timestamp_ntz") for b in bounds)
    outside = F.lit(False)
    if low is not None:
        outside = outside | (moment < low)
    if high is not None:
        outside = outside | (moment >= high + F.expr("INTERVAL 1 DAY"))
    return F.coalesce(outside, F.lit(False))


def date_bounds(df: DataFrame, bounds: Mapping[str, Sequence]) -> DataFrame:
    """Set implausible dates to missing and keep a ``<column>_flagged`` mark."""
    flags = {name: implausible_date(df, name, limits) for name, limits in bounds.items()}
    changed = {f"{name}_flagged": flag for name, flag in flags.items()}
    changed |= {name: F.when(~flag, col(name)) for name, flag in flags.items()}
    return df.withColumns(changed)


def spelling_map(df: DataFrame, column: str, suffixes: Sequence[str] = (), slips: bool = False) -> DataFrame:
    """``(variant, dominant, affected)`` for every spelling that changes.

    Spellings are counted first, so only distinct texts are compared. The most frequent spelling of a key
    wins; the smallest text wins a tie. With ``slips`` a rare key that is one slip of the pen or one look-alike letter away from
    a common one counts as that one (``operators.variants``).
    """
    present = df.filter(col(column).isNotNull()).select(col(column).alias("variant"))
    counted = present.groupBy("variant").agg(F.count(F.lit(1)).alias("affected"))
    # a key that cannot be NULL keeps the join from testing it on every source row
    keyed = counted.withColumn("key", F.coalesce(spelling_key(F.col("variant"), suffixes), F.lit("")))
    if slips:
        keyed = staged(keyed.withColumn("key", one_script(F.col("key"))), "spelling-keys")
        mended = roots(keyed.groupBy("key").agg(F.sum("affected").alias("n")))
        keyed = keyed.join(mended, "key", "left").select("variant", "affected", F.coalesce("root", "key").alias("key"))
    best = keyed.groupBy("key").agg(
        F.min(F.struct((-F.col("affected")).alias("n"), F.col("variant").alias("text"))).alias("best")
    )
    changed = keyed.join(best, "key").filter(F.col("variant") != F.col("best.text"))
    return changed.select("variant", F.col("best.text").alias("dominant"), "affected")


def apply_spellings(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Replace each variant by its dominant spelling.

    The mapping is broadcast only after its size is known; past the bound the same join is shuffled, and
    the adaptive skew join splits a dominant category.
    """
    pairs = mapping.select(F.col("variant").alias("__variant"), F.col("dominant").alias("__dominant"))
    size = pairs.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.max(F.length("__variant") + F.length("__dominant")), F.lit(0)).alias("longest"),
    ).first()
    if size.rows == 0:
        return df
    if size.rows <= BROADCAST_SPELLINGS and size.longest <= 2 * MAX_SPELLING:
        pairs = F.broadcast(pairs)
    joined = df.join(pairs, col(column) == F.col("__variant"), "left")
    fixed = joined.withColumn(column, F.coalesce(F.col("__dominant"), col(column)))
    return fixed.select(*map(col, df.columns))


def category_normalize(
    df: DataFrame, column: str, suffixes: Sequence[str] = (), slips: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The frame with one spelling per category, and the mapping that was applied (``slips``: see ``spelling_map``).

    The mapping is written once to the shared folder: it is sized, joined and reported from there.
    """
    mapping = staged(spelling_map(df, column, suffixes, slips), "spellings")
    return apply_spellings(df, column, mapping), mapping


@dataclass(frozen=True)
class CleaningPlan:
    """What to clean: bounds are parameters, never the clock.

    ``order`` decides which copy of a record is the first; ``categories`` maps a column to the suffixes
    its spellings may carry; ``key_fields`` are those whose missing rate is reported; with ``slips`` rare misspellings
    of categories are mended, too.
    """

    order: Sequence[str]
    id_field: str | None = None
    bounds: Mapping[str, Sequence] = field(default_factory=dict)
    dates: Mapping[str, Sequence] = field(default_factory=dict)
    categories: Mapping[str, Sequence[str]] = field(default_factory=dict)
    key_fields: Sequence[str] = ()
    slips: bool = False


@dataclass(frozen=True)
class Cleaned:
    """The clean copy, and ``(step, action, column, detail, before, after, affected)``."""

    table: DataFrame
    report: DataFrame


def _cleaned(df: DataFrame, plan: CleaningPlan, name: str) -> Column:
    """A column after its bounds and dates, before spellings (which make nothing missing)."""
    value = col(name)
    if name in plan.bounds:
        value = F.when(within(col(name), *plan.bounds[name]), col(name))
    if name in plan.dates:
        value = F.when(~implausible_date(df, name, plan.dates[name]), value)
    return value.alias(name)


def clean_dataset(df: DataFrame, plan: CleaningPlan) -> Cleaned:
    """Ids, duplicates, impossible values, dates, spellings, missing rates - in that order.

    Every column stays, personal data included; the input is only read. Report and spelling maps read one narrow
    copy of the deduplicated columns they need, written once, so they agree on which record is the first (ties are
    settled by content); just the table itself shuffles whole rows, once. Missing values are counted after the steps.
    """
    id_field, created = plan.id_field, False
    source = df
    if id_field is None:
        id_field = unique_id(df)
        if id_field is None:
            source, id_field, created = derived_ids(df), ROW_ID, True
    unique = keep_first(source, id_field, [col(c) for c in plan.order])
    valid = impossible_to_null(unique, plan.bounds)
    flags = {name: implausible_date(valid, name, limits) for name, limits in plan.dates.items()}
    dated = valid.withColumns({n: F.when(~flag, col(n)) for n, flag in flags.items()}) if flags else valid
    needed = dict.fromkeys([*plan.bounds, *plan.dates, *plan.categories, *plan.key_fields])
    unique = staged(unique.select(*map(col, needed or [id_field])), "unique")
    clean, mappings = dated, {}
    for column, suffixes in plan.categories.items():
        mappings[column] = staged(spelling_map(unique.select(_cleaned(unique, plan, column)), column, suffixes, plan.slips), "spellings")
        clean = apply_spellings(clean, column, mappings[column])

    # one row of counts over the unique records
    counts = [F.count(F.lit(1)).alias("n")]
    counts += [F.count_if(impossible(c, b)).alias(f"b{i}") for i, (c, b) in enumerate(plan.bounds.items())]
    counts += [F.count(col(c)).alias(f"p{i}") for i, c in enumerate(plan.bounds)]
    counts += [
        F.count_if(implausible_date(unique, c, b)).alias(f"d{i}") for i, (c, b) in enumerate(plan.dates.items())
    ]
    counts += [F.count(col(c)).alias(f"q{i}") for i, c in enumerate(plan.dates)]
    counts += [F.count_if(_cleaned(unique, plan, c).isNull()).alias(f"m{i}") for i, c in enumerate(plan.key_fields)]
    after = unique.agg(*counts)

    def line(step, action, column, before, later, affected, detail=None):
        as_count = lambda value: F.lit(value).cast("bigint") if value is None else value.cast("bigint")
        return F.struct(
            F.lit(step).alias("step"), F.lit(action).alias("action"),
            F.lit(column).cast("string").alias("column"), F.lit(detail).cast("string").alias("detail"),
            as_count(before).alias("before"), as_count(later).alias("after"),
            as_count(affected).alias("affected"),
        )

    n = F.col("n")
    lines = [
        line(1, "row id created" if created else "row id kept", id_field, None, None, None),
        *(
            line(3, "impossible values set to missing", c, F.col(f"p{i}"), F.col(f"p{i}") - F.col(f"b{i}"), F.col(f"b{i}"))
            for i, c in enumerate(plan.bounds)
        ),
        *(
            line(4, "implausible dates set to missing", c, F.col(f"q{i}"), F.col(f"q{i}") - F.col(f"d{i}"), F.col(f"d{i}"))
            for i, c in enumerate(plan.dates)
        ),
        *(line(6, "missing values", c, n, n, F.col(f"m{i}")) for i, c in enumerate(plan.key_fields)),
    ]
    report = after.select(F.inline(F.array(*lines)))
    # both sides of this account are a single row
    rows = source.agg(F.count(F.lit(1)).alias("before")).select("before", F.lit(None).cast("bigint").alias("after"))
    rows = rows.unionByName(after.select(F.lit(None).cast("bigint").alias("before"), n.alias("after")))
    rows = rows.agg(F.max("before").alias("before"), F.max("after").alias("after"))
    report = report.unionByName(
        rows.select(F.inline(F.array(line(
            2, "duplicates dropped", id_field, F.col("before"), F.col("after"), F.col("before") - F.col("after")
        ))))
    )
    for column, mapping in mappings.items():
        report = report.unionByName(mapping.select(
            F.lit(5).alias("step"), F.lit("spelling replaced").alias("action"), F.lit(column).alias("column"),
            F.concat_ws(" -> ", "variant", "dominant").alias("detail"),
            F.col("affected").alias("before"), F.lit(0).cast("bigint").alias("after"), "affected",
        ))
    return Cleaned(clean, report.orderBy("step", "column", "detail"))
