"""Aggregations, indicators, 5W, joins, sorts and report shapes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions.categories import category_key, category_order
from fieldtally.functions.columns import col
from fieldtally.functions.dates import month_bucket
from fieldtally.functions.numbers import progress_pct
from fieldtally.operators.fivew import activities, five_w, five_w_long, reach, read_spec
from fieldtally.operators.indicators import evaluate_indicators
from fieldtally.operators.measures import evaluate_measure
from fieldtally.operators.mergeable import add_pull, five_w_pull, measure_facts, merged_counts
from fieldtally.operators.period import Period, in_period, source_info
from fieldtally.operators.places import with_place
from fieldtally.operators.profile import compare_measure, group_counts, period_compare
from fieldtally.plans.report import evaluate_registry, five_w_report, limit_preview, suppress_high_card
from fieldtally.session import scratch_path, staged
from fieldtally.sources.tables import Catalog
from fieldtally.workload.base import ACTIVITY, FIVE_W, SURVEY, landed_survey, query, segment_columns, survey, table

PERIOD = Period("visit_date", date(1996, 1, 1), date(1999, 12, 31))
IN_PERIOD = "visit_date >= TIMESTAMP '1996-01-01' AND visit_date < TIMESTAMP '2000-01-01'"


def _measured(name: str, measure: dict, expression: str) -> None:
    """A one-row measure over the whole survey."""

    @query(name, SURVEY + f"SELECT ({expression})::DOUBLE AS value, NULL::VARCHAR AS reason FROM survey")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = evaluate_measure(survey(spark, sf_dir), measure)
        return result.select(F.round("value", 2).alias("value"), "reason") if name == "agg_sum" else result


_measured("agg_count", {"aggregation": "count", "filter": "amount > 250000"},
          "count(*) FILTER (amount > 250000)")
_measured("agg_count_field", {"aggregation": "count", "field": "segment", "filter": "priority != '5-LOW'"},
          "count(segment) FILTER (priority <> '5-LOW')")
_measured("agg_count_unique",
          {"aggregation": "count_unique", "field": "household_id", "filter": "segment == 'BUILDING'"},
          "count(DISTINCT household_id) FILTER (segment = 'BUILDING')")
_measured("agg_sum", {"aggregation": "sum", "field": "amount", "filter": "region == 'ASIA'"},
          "round(coalesce(sum(amount) FILTER (region = 'ASIA'), 0), 2)")
_measured("agg_percent",
          {"aggregation": "percent", "numerator": {"field": "household_id", "filter": "amount > 400000"},
           "denominator": {"field": "household_id", "filter": "segment.notna()"}},
          "100.0 * count(DISTINCT household_id) FILTER (amount > 400000)"
          " / count(DISTINCT household_id) FILTER (segment IS NOT NULL)")


def _indicator(code: str, measure: dict, target: float | None = None, by: list[str] | None = None) -> dict:
    return {
        "code": code, "name": {"uk": f"Показник {code}", "en": f"Indicator {code}"}, "definition": "d",
        **({"target": {"value": target, "unit": "households"}} if target is not None else {}),
        "disaggregation": by or [], "measure": {"dataset": "survey", **measure},
    }


REACHED = {"aggregation": "count_unique", "field": "household_id"}
SHARE = {
    "aggregation": "percent",
    "numerator": {"field": "household_id", "filter": "priority in ['1-URGENT', '2-HIGH']"},
    "denominator": {"field": "household_id", "filter": "amount > 100000"},
}
VALUE = {"aggregation": "sum", "field": "amount", "filter": "segment.notna()"}
VISITS = {"aggregation": "count", "filter": "region not in ['ASIA'] and 50000 <= amount < 200000"}


@query("indicator_eval", SURVEY + """
SELECT '1.1' AS code, 'Indicator 1.1' AS name_en, 2500.0::DOUBLE AS target, 'households' AS unit,
       count(DISTINCT household_id)::DOUBLE AS actual, round(100.0 * count(DISTINCT household_id) / 2500, 1) AS progress_pct,
       'computed' AS status, NULL::VARCHAR AS reason FROM survey""")
def _indicator_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = evaluate_indicators(survey(spark, sf_dir), [_indicator("1.1", REACHED, 2500, ["region"])], [], "survey")
    return run.summary().select(
        "code", "name_en", "target", "unit", "actual", "progress_pct", "status", "reason"
    )


def _registry() -> dict:
    return {"indicators": [
        _indicator("1.1", REACHED, 2500, ["region", "segment"]),
        _indicator("1.2", SHARE, 55, ["region"]),
        _indicator("1.3", VALUE, None, ["segment"]),
        _indicator("1.4", VISITS, 0, ["country"]),
        {"code": "2.1", "name": {"uk": "Без", "en": "None"}, "definition": "d"},
        _indicator("2.2", {"aggregation": "count_unique", "field": "absent"}, 10),
    ]}


@query("indicator_registry", SURVEY + f""", scoped AS MATERIALIZED (SELECT * FROM survey WHERE {IN_PERIOD})
SELECT '1.1' AS code, 2500.0::DOUBLE AS target, count(DISTINCT household_id)::DOUBLE AS actual,
       round(100.0 * count(DISTINCT household_id) / 2500, 1) AS progress_pct, 'computed' AS status FROM scoped
UNION ALL SELECT '1.2', 55, round(p, 6), round(100.0 * p / 55, 1), 'computed' FROM (
  SELECT 100.0 * count(DISTINCT household_id) FILTER (priority IN ('1-URGENT', '2-HIGH'))
         / count(DISTINCT household_id) FILTER (amount > 100000) AS p FROM scoped)
UNION ALL SELECT '1.3', NULL, round(sum(amount) FILTER (segment IS NOT NULL), 2), NULL, 'computed' FROM scoped
UNION ALL SELECT '1.4', 0, count(*) FILTER (region <> 'ASIA' AND amount >= 50000 AND amount < 200000), NULL,
  'computed' FROM scoped
UNION ALL SELECT '2.1', NULL, NULL, NULL, 'not_computable'
UNION ALL SELECT '2.2', 10, NULL, NULL, 'not_computable'""")
def _indicator_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = evaluate_registry(spark, _registry(), landed_survey(spark, sf_dir), PERIOD)
    digits = F.when(F.col("code") == "1.3", F.round("actual", 2)).otherwise(F.round("actual", 6))
    return run.summary.select("code", "target", digits.alias("actual"), "progress_pct", "status")


def _broken_down(code: str, dimension: str, expression: str, source: str = "scoped") -> str:
    return (
        f"SELECT '{code}' AS code, '{dimension}' AS dimension, coalesce({dimension}, '(missing)') AS category, "
        f"({expression})::DOUBLE AS value, NULL::VARCHAR AS reason FROM {source} GROUP BY {dimension}"
    )


@query("indicator_breakdown", SURVEY + f""", scoped AS MATERIALIZED (SELECT * FROM survey WHERE {IN_PERIOD})
""" + " UNION ALL ".join([
    _broken_down("1.1", "region", "count(DISTINCT household_id)"),
    _broken_down("1.1", "segment", "count(DISTINCT household_id)"),
    _broken_down("1.2", "region", "round(100.0 * count(DISTINCT household_id) FILTER (priority IN ('1-URGENT', "
                 "'2-HIGH')) / count(DISTINCT household_id) FILTER (amount > 100000), 6)"),
    _broken_down("1.3", "segment", "coalesce(round(sum(amount) FILTER (segment IS NOT NULL), 2), 0)"),
    _broken_down("1.4", "country",
                 "count(*) FILTER (region <> 'ASIA' AND amount >= 50000 AND amount < 200000)"),
]))
def _indicator_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = evaluate_registry(spark, _registry(), landed_survey(spark, sf_dir), PERIOD)
    digits = F.when(F.col("code") == "1.3", F.round("value", 2)).otherwise(F.round("value", 6))
    return run.breakdown.select("code", "dimension", "category", digits.alias("value"), "reason")


@query("progress_pct", SURVEY + """
SELECT country, count(DISTINCT household_id) AS actual, (length(region) - 4) * 20 AS target,
       round(100.0 * count(DISTINCT household_id) / nullif((length(region) - 4) * 20, 0), 1) AS progress
FROM survey GROUP BY country, region""")
def _progress_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = group_counts(survey(spark, sf_dir), ["country", "region"], "household_id")
    target = ((F.length("region") - 4) * 20).cast("bigint")
    return per.select(
        "country", F.col("n_unique").alias("actual"), target.alias("target"),
        progress_pct(F.col("n_unique"), target).alias("progress"),
    )


@query("join_target", SURVEY + """
SELECT 't' || k AS code, (k * 1000)::DOUBLE AS target, n::DOUBLE AS actual,
       round(100.0 * n / nullif(k * 1000, 0), 1) AS progress_pct
FROM (SELECT unnest([0, 1, 2]) AS k), (SELECT count(DISTINCT household_id) AS n FROM survey)""")
def _join_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = [_indicator(f"t{k}", REACHED, k * 1000) for k in range(3)]
    run = evaluate_indicators(survey(spark, sf_dir), items, [], "survey")
    return run.summary().select("code", "target", "actual", "progress_pct")


@query("category_key", SURVEY + """
SELECT coalesce(segment, '(missing)') AS category, count(*) AS n FROM survey GROUP BY 1""")
def _category_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = survey(spark, sf_dir).select(category_key(col("segment")).alias("category"))
    return keyed.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("five_w", ACTIVITY + f"""
SELECT 'Relief Org' AS "Organization", 'P-1' AS "Project", region, country, "Period", "Activity",
       count(DISTINCT household_id) AS "Beneficiaries", {segment_columns()}
FROM activity GROUP BY region, country, "Period", "Activity" """)
def _five_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five_w(survey(spark, sf_dir, services=True), FIVE_W).table


@query("five_w_pivot", ACTIVITY + f"""
SELECT region, {segment_columns()} FROM activity GROUP BY region""")
def _five_w_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir, services=True)
    one = rows.withColumn("services", F.when(F.size(activities(rows, read_spec(FIVE_W))) > 0, "any"))
    spec = {**FIVE_W, "where": ["region"], "when": {"field": "visit_date", "granularity": "none"}, "fixed": None}
    return five_w(one, spec).table.drop("Activity", "Beneficiaries")


@query("unique_reach", ACTIVITY + """
SELECT count(DISTINCT household_id) AS unique_reach FROM activity""")
def _unique_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(survey(spark, sf_dir, services=True), read_spec(FIVE_W)).select("unique_reach")


# Pulls of the survey by year of visit: a household visited in two of them counts once in their union.
PULLS = {"1994": "year(visit_date) <= 1994", "1996": "year(visit_date) IN (1995, 1996)", "later": "year(visit_date) > 1996"}


def _merged(pulls: str, dimension: str | None, where: str) -> str:
    lane = f"'{dimension}', coalesce({dimension}, '(missing)')" if dimension else "NULL, NULL"
    return (
        f"SELECT '{pulls}' AS pulls, {lane.replace(', ', ' AS dimension, ', 1)} AS category, "
        f"count(DISTINCT household_id) FILTER (amount > 150000) AS value FROM survey WHERE {where}"
        + (f" GROUP BY {dimension}" if dimension else "")
    )


@query("merged_count_unique", SURVEY + " UNION ALL ".join(
    _merged(name, dimension, where)
    for name, where in (("all", "true"), ("early", f"{PULLS['1994']} OR {PULLS['1996']}"))
    for dimension in (None, "region", "segment")
))
def _merged_count_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, visits = scratch_path(spark, "pulls"), survey(spark, sf_dir)
    measure = {"aggregation": "count_unique", "field": "household_id", "filter": "amount > 150000"}
    for pull, where in PULLS.items():
        add_pull(measure_facts(visits.where(where), measure, ["region", "segment"]), store, pull)
    early = merged_counts(spark, store, ["1994", "1996"]).select(F.lit("early").alias("pulls"), "*")
    return merged_counts(spark, store).select(F.lit("all").alias("pulls"), "*").unionByName(early)


@query("merged_five_w", ACTIVITY + """, lanes AS (
  SELECT *, NULL AS dimension, NULL AS category FROM activity UNION ALL SELECT *, 'segment', seg FROM activity)
SELECT region, country, "Period", "Activity", dimension, category, count(DISTINCT household_id) AS beneficiaries,
       (SELECT count(DISTINCT household_id) FROM activity) AS unique_reach
FROM lanes GROUP BY region, country, "Period", "Activity", dimension, category""")
def _merged_five_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the view is made once, each pull reads its years from the stored rows
    store, visits = scratch_path(spark, "pulls"), staged(survey(spark, sf_dir, services=True), "visits")
    for pull, where in PULLS.items():
        five_w_pull(visits.where(where), FIVE_W, store, pull)
    whole = merged_counts(spark, f"{store}/reach", name="unique_reach")  # one row
    return merged_counts(spark, f"{store}/matrix", name="beneficiaries").join(F.broadcast(whole))


@query("rows_without_activity", SURVEY + """
SELECT count(*) FILTER (services IS NULL) AS rows_without_activity FROM survey""")
def _rows_without_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reach(survey(spark, sf_dir, services=True), read_spec(FIVE_W)).select("rows_without_activity")


@query("source_info", SURVEY + f""", dated AS (
  SELECT *, CASE WHEN record_id % 50 = 0 THEN NULL ELSE visit_date END AS d FROM survey)
SELECT 'survey' AS dataset, 'raw' AS copy, count(*) AS rows_total, count(*) FILTER ({IN_PERIOD.replace('visit_date', 'd')}) AS rows_in_scope,
       count(*) - count(*) FILTER ({IN_PERIOD.replace('visit_date', 'd')}) AS rows_excluded_by_period,
       count(*) FILTER (d IS NULL) AS rows_bad_date, NULL::VARCHAR AS warning FROM dated""")
def _source_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("visit_date", "yyyy-MM-dd")
    dated = survey(spark, sf_dir).withColumn(
        "visit_date", F.when(F.col("record_id") % 50 == 0, "not a date").otherwise(text)
    )
    return source_info(dated, PERIOD, "survey")


@query("group_counts", SURVEY + """
SELECT region, count(*) AS n_rows, count(DISTINCT household_id) AS n_unique FROM survey GROUP BY region""")
def _group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_counts(survey(spark, sf_dir), ["region"], "household_id")


@query("period_compare", SURVEY + """
SELECT region, a AS first_value, b AS second_value, b - a AS difference, round(b::DOUBLE / a, 9) AS ratio FROM (
  SELECT region,
    count(DISTINCT household_id) FILTER (visit_date >= TIMESTAMP '1998-07-01' AND visit_date < TIMESTAMP '1998-08-01') AS a,
    count(DISTINCT household_id) FILTER (visit_date >= TIMESTAMP '1998-08-01' AND visit_date < TIMESTAMP '1998-09-01') AS b
  FROM survey GROUP BY region)""")
def _period_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir)
    july = in_period(rows, Period("visit_date", date(1998, 7, 1), date(1998, 7, 31)))
    august = in_period(rows, Period("visit_date", date(1998, 8, 1), date(1998, 8, 31)))
    return period_compare(rows, "household_id", july, august, ["region"]).withColumn("ratio", F.round("ratio", 9))


@query("period_compare_measure", SURVEY + """
SELECT coalesce(segment, '(missing)') AS category, round(a, 2) AS first_value, round(b, 2) AS second_value,
       round(b - a, 2) AS difference, round(b / a, 9) AS ratio FROM (
  SELECT segment,
    sum(amount) FILTER (priority <> '5-LOW' AND visit_date >= TIMESTAMP '1997-01-01' AND visit_date < TIMESTAMP '1998-01-01') AS a,
    sum(amount) FILTER (priority <> '5-LOW' AND visit_date >= TIMESTAMP '1998-01-01' AND visit_date < TIMESTAMP '1999-01-01') AS b
  FROM survey GROUP BY segment)""")
def _period_compare_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = [Period("visit_date", date(y, 1, 1), date(y, 12, 31)) for y in (1997, 1998)]
    measure = {"aggregation": "sum", "field": "amount", "filter": "priority != '5-LOW'"}
    sides = compare_measure(survey(spark, sf_dir), measure, *years, by="segment")
    digits = {"first_value": 2, "second_value": 2, "difference": 2, "ratio": 9}
    return sides.withColumns({name: F.round(name, n) for name, n in digits.items()})


@query("five_w_long", ACTIVITY + """
SELECT region, country, "Period", "Activity", NULL AS dimension, NULL AS category,
       count(DISTINCT household_id) AS beneficiaries FROM activity GROUP BY ALL
UNION ALL SELECT region, country, "Period", "Activity", 'segment', seg, count(DISTINCT household_id) FROM activity GROUP BY ALL""")
def _five_w_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five_w_long(survey(spark, sf_dir, services=True), FIVE_W)


@query("five_w_report", ACTIVITY + f"""
SELECT 'Relief Org' AS "Organization", 'P-1' AS "Project", region, country, "Period", "Activity",
       count(DISTINCT household_id) AS "Beneficiaries", {segment_columns()}, '2026-09-14' AS day,
       (SELECT count(DISTINCT household_id) FROM activity WHERE {IN_PERIOD}) AS unique_reach,
       (SELECT count(*) FROM survey WHERE {IN_PERIOD}) AS rows_in_scope
FROM activity WHERE {IN_PERIOD} GROUP BY region, country, "Period", "Activity" """)
def _five_w_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = five_w_report(Catalog({"survey": survey(spark, sf_dir, services=True)}), FIVE_W, PERIOD)
    paths = report.save(scratch_path(spark, "report"), date(2026, 9, 14))
    matrix, summary, source = (spark.read.parquet(paths[name]) for name in ("matrix", "summary", "source"))
    # summary and account are one row each
    facts = summary.select("unique_reach").join(F.broadcast(source.select("rows_in_scope")))
    day = F.col("report_date").cast("string").alias("day")
    return matrix.select(*[c for c in matrix.columns if c != "report_date"], day).join(F.broadcast(facts))


@query("registry_report", SURVEY + f""", scoped AS MATERIALIZED (SELECT * FROM survey WHERE {IN_PERIOD}), parts AS (
  {_broken_down("1.1", "region", "count(DISTINCT household_id)")}
  UNION ALL {_broken_down("1.1", "segment", "count(DISTINCT household_id)")}
  UNION ALL {_broken_down("1.4", "country", "count(*) FILTER (region <> 'ASIA' AND amount >= 50000 AND amount < 200000)")})
SELECT 'breakdown' AS "table", code, dimension, category, value FROM parts
UNION ALL SELECT 'not_computable', code, NULL, NULL, NULL FROM (SELECT unnest(['2.1', '2.2']) AS code)
UNION ALL SELECT 'sources', 'survey', NULL, NULL, (SELECT count(*) FROM scoped)""")
def _registry_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = evaluate_registry(spark, _registry(), landed_survey(spark, sf_dir), PERIOD)
    paths = run.save(scratch_path(spark, "report"), date(2026, 9, 14))
    parts, missing, sources = (spark.read.parquet(paths[n]) for n in ("breakdown", "not_computable", "sources"))
    rows = parts.where(F.col("code").isin("1.1", "1.4")).select(F.lit("breakdown").alias("table"), "code", "dimension", "category", "value")
    rows = rows.unionByName(missing.select(F.lit("not_computable").alias("table"), "code"), allowMissingColumns=True)
    scope_rows = F.col("rows_in_scope").cast("double").alias("value")
    return rows.unionByName(
        sources.select(F.lit("sources").alias("table"), F.col("dataset").alias("code"), scope_rows), allowMissingColumns=True
    )


@query("join_left_equi", ACTIVITY + """, total AS (
  SELECT region, "Activity", count(DISTINCT household_id) AS n FROM activity GROUP BY ALL
), part AS (
  SELECT region, "Activity", seg, count(DISTINCT household_id) AS k FROM activity GROUP BY ALL)
SELECT total.region, total."Activity" AS activity, seg AS category, n AS beneficiaries, k AS in_category
FROM total LEFT JOIN part ON total.region = part.region AND total."Activity" = part."Activity" """)
def _join_left_equi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir, services=True)
    one = rows.select(
        "region", "household_id", category_key(col("segment")).alias("category"),
        F.explode(activities(rows, read_spec(FIVE_W))).alias("activity"),
    )
    keys = ["region", "activity"]
    total = group_counts(one, keys, "household_id").select(*keys, F.col("n_unique").alias("beneficiaries"))
    part = group_counts(one, [*keys, "category"], "household_id")
    return total.join(part.select(*keys, "category", F.col("n_unique").alias("in_category")), keys, "left")


@query("sort_categories", SURVEY + """
SELECT category, n, row_number() OVER (ORDER BY category = '(missing)', category) AS place
FROM (SELECT coalesce(segment, '(missing)') AS category, count(*) AS n FROM survey GROUP BY 1)""")
def _sort_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _category_key(spark, sf_dir)
    return with_place(counted, *category_order(F.col("category")))


@query("sort_group_keys", SURVEY + """
SELECT region, seg, n, row_number() OVER (ORDER BY region, seg) AS place
FROM (SELECT region, coalesce(segment, '(missing)') AS seg, count(*) AS n FROM survey GROUP BY ALL)""")
def _sort_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir).select("region", category_key(col("segment")).alias("seg"))
    counted = rows.groupBy("region", "seg").agg(F.count(F.lit(1)).alias("n"))
    return with_place(counted, F.col("region"), F.col("seg")).orderBy("region", "seg")


@query("limit_preview", ACTIVITY + """, matrix AS (
  SELECT region, country, "Period", "Activity", count(DISTINCT household_id) AS n FROM activity GROUP BY ALL)
SELECT * FROM (SELECT region, country, "Period", "Activity", n AS "Beneficiaries", NULL AS note
  FROM matrix ORDER BY region, country, "Period", "Activity" LIMIT 200)
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL,
  'first ' || least(200, count(*)) || ' of ' || count(*) || ' rows' FROM matrix""")
def _limit_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {**FIVE_W, "fixed": None, "whom": {"id_field": "household_id"}}
    table_5w = five_w(survey(spark, sf_dir, services=True), spec).table
    first, note = limit_preview(table_5w, ["region", "country", "Period", "Activity"])
    text = F.concat(F.lit("first "), F.col("shown"), F.lit(" of "), F.col("total"), F.lit(" rows"))
    return first.unionByName(note.select(text.alias("note")), allowMissingColumns=True)


@query("suppress_high_card", SURVEY + """
SELECT '1' AS code, 'region' AS dimension, region AS category, count(DISTINCT household_id)::DOUBLE AS value,
       NULL::VARCHAR AS reason FROM survey GROUP BY region
UNION ALL SELECT '1', 'household_id', NULL, NULL, count(DISTINCT household_id) || ' categories: too many to list'
FROM survey""")
def _suppress_high_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _indicator("1", REACHED, None, ["region", "household_id"])
    return suppress_high_card(evaluate_indicators(survey(spark, sf_dir), [item], [], "survey").breakdown())


@query("month_bucket", """
SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def _month_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(month_bucket(F.col("ts")).alias("month"), "event_type")
    return rows.groupBy("month", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("split_activities", SURVEY + """
SELECT record_id, CASE WHEN services IS NULL THEN 0 ELSE len(string_split(services, ' ')) END AS n_activities,
       CASE WHEN services IS NULL THEN '' ELSE array_to_string(list_sort(string_split(services, ' ')), '+') END AS names
FROM survey""")
def _split_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir, services=True)
    # untidy separators and blanks around the names
    untidy = rows.withColumn(
        "services", F.concat(F.lit("  "), F.regexp_replace("services", " ", " ;|\t"), F.lit(";| "))
    )
    names = activities(untidy, read_spec({**FIVE_W, "what": {"field": "services", "split": ";|"}}))
    return untidy.select(
        "record_id", F.size(names).cast("bigint").alias("n_activities"), F.array_join(F.array_sort(names), "+").alias("names")
    )


@query("explode_activities", ACTIVITY + """SELECT record_id, "Activity" AS activity FROM activity""")
def _explode_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir, services=True)
    return rows.select("record_id", F.explode(activities(rows, read_spec(FIVE_W))).alias("activity"))
