"""Profiles: types, missing rates, short value lists or ranges. Never rows, never personal data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.columns import col, families, new_name
from fieldtally.operators.indicators import evaluate_indicators
from fieldtally.operators.period import Period, in_period
from fieldtally.operators.pii import pii_detect
from fieldtally.session import staged

# Fixed value: a column with more distinct values is not listed.
MAX_VALUES = 30
# The estimate below which a column is counted exactly. At 30 values the sketch is off by one or two, so
# a column near the limit is always counted; one above this is beyond 30 without doubt.
SCREEN = 2 * MAX_VALUES
RSD = 0.05


def null_rates(df: DataFrame) -> DataFrame:
    """``(column, null_rate)`` from one scan."""
    rates = df.agg(*(F.avg(col(c).isNull().cast("int")).alias(f"r{n}") for n, c in enumerate(df.columns)))
    pairs = [
        F.struct(F.lit(c).alias("column"), F.round(F.col(f"r{n}"), 4).alias("null_rate"))
        for n, c in enumerate(df.columns)
    ]
    return rates.select(F.inline(F.array(*pairs)))


def _value_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n_values, values)`` from one row of sets; only screened columns come here, so all are short."""
    sets = df.agg(*(F.collect_set(col(c).cast("string")).alias(f"v{n}") for n, c in enumerate(columns)))
    lists = [
        F.struct(
            F.lit(c).alias("column"), F.size(f"v{n}").cast("bigint").alias("n_values"),
            F.sort_array(f"v{n}").alias("values"),
        )
        for n, c in enumerate(columns)
    ]
    return sets.select(F.inline(F.array(*lists)))


def profile(df: DataFrame, pii: Sequence[str] | None = None) -> DataFrame:
    """One row per column: ``(column, dtype, n_rows, null_rate, pii, n_values, values, min, max, earliest, latest)``.

    ``n_rows`` is the number of rows of the dataset, the same in every row. Numbers have a range from ``min`` to ``max``, dates and times
    one from ``earliest`` to ``latest``, as text.

    First pass: missing rates, ranges and a distinct-count sketch of every column, one row in all. Second
    pass: exact distinct values of the columns the sketch shows to be near or under the limit.
    """
    spark, kinds = df.sparkSession, families(df)
    personal = set(pii_detect(df) if pii is None else pii)
    open_columns = [c for c in df.columns if c not in personal]
    numeric = [c for c in open_columns if kinds[c] in ("whole", "real", "bool")]
    dated = [c for c in open_columns if kinds[c] == "time"]
    spots = {c: n for n, c in enumerate(df.columns)}
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.avg(col(c).isNull().cast("int")).alias(f"null_{spots[c]}") for c in df.columns),
        *(F.approx_count_distinct(col(c), RSD).alias(f"near_{spots[c]}") for c in open_columns),
        *(F.min(col(c).cast("double")).alias(f"min_{spots[c]}") for c in numeric),
        *(F.max(col(c).cast("double")).alias(f"max_{spots[c]}") for c in numeric),
        *(F.min(col(c)).cast("string").alias(f"earliest_{spots[c]}") for c in dated),
        *(F.max(col(c)).cast("string").alias(f"latest_{spots[c]}") for c in dated),
    ).first().asDict()
    stats = []
    for c, n in spots.items():
        rate = row[f"null_{n}"]
        stats.append((
            n, c, df.schema[c].dataType.simpleString(), rate, c in personal,
            row.get(f"min_{n}"), row.get(f"max_{n}"), row.get(f"earliest_{n}"), row.get(f"latest_{n}"),
        ))
    base = spark.createDataFrame(
        stats, "at int, column string, dtype string, rate double, pii boolean, min double, max double, "
        "earliest string, latest string"
    )
    near = [c for c in open_columns if row[f"near_{spots[c]}"] <= SCREEN]
    if near:
        # both sides have at most one row per column of the table
        base = base.join(F.broadcast(_value_lists(df, near)), "column", "left")
    else:
        base = base.withColumns({
            "n_values": F.lit(None).cast("bigint"), "values": F.lit(None).cast("array<string>")
        })
    listed = F.col("n_values")
    short = F.coalesce(listed <= MAX_VALUES, F.lit(False)) & ~F.col("pii")
    return base.select(
        "column", "dtype", F.lit(row["n_rows"]).cast("bigint").alias("n_rows"), F.round("rate", 4).alias("null_rate"), "pii",
        F.when(short, listed).alias("n_values"),
        F.when(short, F.col("values")).alias("values"),
        F.when(~short, F.col("min")).alias("min"),
        F.when(~short, F.col("max")).alias("max"),
        "earliest", "latest",
        "at",
    ).orderBy("at").drop("at")


def group_counts(df: DataFrame, by: Sequence[str], id_field: str) -> DataFrame:
    """Per group: rows, and distinct ids. A big group is spread by id first."""
    keys = list(map(col, by))
    per_id = df.groupBy(*keys, col(id_field).alias("__id")).agg(F.count(F.lit(1)).alias("__n"))
    return per_id.groupBy(*keys).agg(F.sum("__n").alias("n_rows"), F.count("__id").alias("n_unique"))


def dup_report(df: DataFrame, id_field: str) -> DataFrame:
    """One row: rows, distinct ids, surplus copies, ids that repeat, rows without an id."""
    per_id = df.groupBy(col(id_field).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("id").alias("n_ids"),
        F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("n_duplicates"),
        F.count_if(F.col("id").isNotNull() & (F.col("n") > 1)).alias("n_repeated_ids"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_without_id"),
    )


def top_category(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value; the smallest text wins a tie."""
    present = df.filter(col(column).isNotNull()).select(col(column).cast("string").alias("category"))
    counted = present.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "category").limit(1)


def period_compare(
    df: DataFrame, id_field: str, first: Column, second: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Distinct ids in two periods side by side, with difference and ratio, from one scan."""
    keys = list(map(col, by))
    per_id = df.filter(first | second).groupBy(*keys, col(id_field).alias("__id")).agg(
        F.bool_or(F.coalesce(first, F.lit(False))).alias("__a"),
        F.bool_or(F.coalesce(second, F.lit(False))).alias("__b"),
    )
    has_id = F.col("__id").isNotNull()
    both = per_id.groupBy(*keys).agg(
        F.count_if(has_id & F.col("__a")).alias("first_value"),
        F.count_if(has_id & F.col("__b")).alias("second_value"),
    )
    return both.withColumns({
        "difference": F.col("second_value") - F.col("first_value"),
        "ratio": F.try_divide(F.col("second_value").cast("double"), F.col("first_value").cast("double")),
    })


def compare_measure(
    df: DataFrame, measure: Mapping, first: Period, second: Period, by: str | None = None, pii: Sequence[str] = ()
) -> DataFrame:
    """Any measure in two periods side by side: ``(category, first_value, second_value, difference, ratio)``.

    Without ``by`` there is one row and no category. A category that only one period has is missing in the other. The source is
    read once for both periods.
    """
    flags = {name: new_name(f"in_{name}", df.columns) for name in ("first", "second")}
    inside = {name: F.coalesce(in_period(df, period), F.lit(False)) for name, period in (("first", first), ("second", second))}
    rows = df.withColumns({flags[name]: inside[name] for name in flags}).where(F.col(flags["first"]) | F.col(flags["second"]))
    items = []
    for name, flag in flags.items():
        dimensions = [by] if by else []
        items.append({"code": name, "measure": {"dataset": "rows", **_within(measure, flag)}, "disaggregation": dimensions})
        there = {"dataset": "rows", "aggregation": "count", "filter": f"{flag} == True"}
        items.append({"code": f"there_{name}", "measure": there, "disaggregation": dimensions})
    run = evaluate_indicators(rows, items, pii, "rows")  # one pass: a period is a further condition of the measure
    if run.counts is not None:
        run.counts = staged(run.counts, "comparison")
    if by:
        found = run.breakdown().groupBy("category")
    else:
        found = run.summary().select(F.lit(None).cast("string").alias("category"), "code", F.col("actual").alias("value")).groupBy("category")
    value = {i["code"]: F.max(F.when(F.col("code") == i["code"], F.col("value"))) for i in items}
    both = found.agg(*(of.alias(code) for code, of in value.items()))
    shown = {name: F.when(F.col(f"there_{name}") > 0, F.col(name)) if by else F.col(name) for name in flags}
    both = both.select("category", *(shown[name].alias(f"{name}_value") for name in flags))
    return both.withColumns({
        "difference": F.col("second_value") - F.col("first_value"), "ratio": F.try_divide("second_value", "first_value"),
    })


def _within(measure: Mapping, flag: str) -> dict:
    """The measure over the rows of one period: each of its conditions, and the period's."""
    def cut(part: Mapping) -> dict:
        text = part.get("filter")
        return {**part, "filter": f"({text}) and {flag} == True" if text else f"{flag} == True"}

    if "numerator" in measure or "denominator" in measure:
        return {**measure, **{side: cut(measure[side]) for side in ("numerator", "denominator") if isinstance(measure.get(side), Mapping)}}
    return cut(measure)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column a frame lacks is missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
