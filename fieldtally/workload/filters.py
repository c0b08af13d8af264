"""The filter language, refusals, projections and periods."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions.columns import col
from fieldtally.functions.numbers import to_number
from fieldtally.operators.filters import safe_filter
from fieldtally.operators.fivew import five_w, read_spec
from fieldtally.operators.fivew import activities as activity_list
from fieldtally.operators.indicators import evaluate_indicators
from fieldtally.operators.period import Period, scope
from fieldtally.operators.pii import drop_pii, pii_detect
from fieldtally.plans.report import evaluate_registry
from fieldtally.sources.tables import Catalog
from fieldtally.workload.base import (
    ACTIVITY, FIVE_W, SURVEY, query, segment_columns, survey, table,
)

NAME = {"uk": "Назва", "en": "Name"}


def _filtered(name: str, text: str, condition: str) -> None:
    """A filter query: record ids that meet ``text``; ``condition`` is its SQL reading."""

    @query(name, SURVEY + f"SELECT record_id FROM survey WHERE {condition}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return safe_filter(survey(spark, sf_dir), text).select("record_id")


_filtered(
    "flt_cmp", "segment != 'BUILDING' and 100000 <= amount < 300000 and visit_date >= '1997-01-01'",
    "segment IS DISTINCT FROM 'BUILDING' AND amount >= 100000 AND amount < 300000"
    " AND visit_date >= TIMESTAMP '1997-01-01'",
)
_filtered(
    "flt_in", "priority in ['1-URGENT', '2-HIGH', 7] and segment not in ('BUILDING', 'MACHINERY')",
    "priority IN ('1-URGENT', '2-HIGH') AND coalesce(segment NOT IN ('BUILDING', 'MACHINERY'), true)",
)
_filtered(
    "flt_bool", "segment == 'BUILDING' | amount > 400000 & ~(priority == '5-LOW' or segment.isna())",
    "coalesce(segment = 'BUILDING', false) OR (amount > 400000 AND NOT (priority = '5-LOW' OR segment IS NULL))",
)
_filtered(
    "flt_arith", "-record_id % 7 == 3 and amount / 2 + 5 > 60000 and amount / (record_id % 5) > 70000 "
    "and region + priority != 'ASIA5-LOW'",
    "((-record_id % 7) + 7) % 7 = 3 AND amount / 2 + 5 > 60000"
    " AND (record_id % 5 = 0 OR amount / (record_id % 5) > 70000) AND region || priority <> 'ASIA5-LOW'",
)
_filtered("flt_null", "segment.isna() or not priority.notna()", "segment IS NULL OR priority IS NULL")
_filtered("flt_isin", "segment.isin(['BUILDING', None])", "segment = 'BUILDING' OR segment IS NULL")
_filtered(
    "flt_str",
    "priority.str.contains('^[1-3]-.*(high|medium)', case=False) and country.str.startswith('NATION_1') "
    "or segment.str.endswith('Y', na=True) and priority.str.contains('-L', regex=False)",
    "(regexp_matches(priority, '(?i)^[1-3]-.*(high|medium)') AND country LIKE 'NATION\\_1%' ESCAPE '\\')"
    " OR (coalesce(segment LIKE '%Y', true) AND contains(priority, '-L'))",
)


@query("flt_quoted", SURVEY + "SELECT record_id FROM survey WHERE segment = 'BUILDING' AND amount > 250000")
def _flt_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = survey(spark, sf_dir).withColumnsRenamed({"segment": "hh type/code", "amount": "amount (UAH)"})
    return safe_filter(named, "`hh type/code` == 'BUILDING' and `amount (UAH)` > 250000").select("record_id")


@query("flt_in_column", """
SELECT l_returnflag, count(*) AS n_rows, sum(l_linenumber)::BIGINT AS lines FROM lineitem
WHERE l_partkey IN (SELECT l_suppkey FROM lineitem) AND l_quantity > 10 GROUP BY l_returnflag""")
def _flt_in_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = safe_filter(table(spark, sf_dir, "lineitem"), "l_partkey in l_suppkey and l_quantity > 10")
    return found.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_linenumber").alias("lines")
    )


def _statuses(df: DataFrame, measures: dict[str, dict], pii: list[str]) -> DataFrame:
    items = [
        {"code": code, "name": NAME, "definition": "d", "measure": {"dataset": "t", **measure}}
        for code, measure in measures.items()
    ]
    return evaluate_indicators(df, items, pii, "t").summary().select("code", "status", "actual")


REFUSED = {
    "bare": "record_id", "method": "priority.to_csv('x')", "dunder": "priority.__class__ == 1",
    "power": "amount ** 2 > 4", "index": "priority[0] == '1'", "choice": "amount if amount else amount",
    "local": "amount > @x", "length": "priority.str.len() > 1", "call": "abs(amount) > 1",
    "kinds": "priority > 1", "no_text": "amount.str.contains('9')", "constants": "1 < 2",
    "syntax": "priority === '5-LOW'", "unknown": "sex == 'f'", "case": "PRIORITY == '5-LOW'",
    "two_lines": "(amount > 1\n or amount < 5)", "arithmetic": "amount + 1",
}


@query("flt_refuse", SURVEY + """
SELECT 'fine' AS code, 'computed' AS status, count(*)::DOUBLE AS actual FROM survey WHERE priority = '5-LOW'
UNION ALL SELECT unnest([""" + ", ".join(f"'{code}'" for code in REFUSED) + """]), 'not_computable', NULL""")
def _flt_refuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"fine": "priority == '5-LOW'", **REFUSED}
    return _statuses(
        survey(spark, sf_dir), {c: {"aggregation": "count", "filter": t} for c, t in texts.items()}, []
    )


@query("flt_pii", """
SELECT 'open' AS code, 'computed' AS status, count(*)::DOUBLE AS actual FROM customer WHERE c_acctbal > 0
UNION ALL SELECT unnest(['direct', 'quoted', 'wide', 'in_text']), 'not_computable', NULL""")
def _flt_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    texts = {
        "open": "c_acctbal > 0", "direct": "c_name == 'x'", "quoted": "`c_name` != 'x'",
        "wide": "ｃ_ｎａｍｅ == 'x'", "in_text": "c_mktsegment == 'c_name'",
    }
    measures = {c: {"aggregation": "count", "filter": t} for c, t in texts.items()}
    return _statuses(customer, measures, pii_detect(customer))


@query("refuse_column", """
SELECT 'open' AS code, 'computed' AS status, count(DISTINCT c_mktsegment)::DOUBLE AS actual FROM customer
UNION ALL SELECT unnest(['unnamed', 'personal', 'absent', 'other_case']), 'not_computable', NULL""")
def _refuse_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    fields = {
        "open": "c_mktsegment", "unnamed": "", "personal": "c_name", "absent": "c_phone_2",
        "other_case": "C_MKTSEGMENT",
    }
    measures = {c: {"aggregation": "count_unique", "field": f} for c, f in fields.items()}
    return _statuses(customer, measures, pii_detect(customer))


@query("flt_status", SURVEY + """
SELECT '1' AS code, 'computed' AS part, NULL AS reason
UNION ALL SELECT '2', 'not_computable', 'it has no measure yet: the registry says what, not how'
UNION ALL SELECT '3', 'not_computable', 'Dataset ''ghost'' not found. Available: survey'
UNION ALL SELECT '4', 'not_computable', 'the denominator is 0: there is nothing to divide by'
UNION ALL SELECT '5', 'not_computable', 'column ''priority'' has ' || count(priority) || ' non-numeric values: it cannot be summed'
FROM survey""")
def _flt_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = {"field": "household_id"}
    measures = [
        {"dataset": "survey", "aggregation": "count"},
        None,
        {"dataset": "ghost", "aggregation": "count"},
        {"dataset": "survey", "aggregation": "percent", "numerator": share,
         "denominator": {**share, "filter": "amount < 0"}},
        {"dataset": "survey", "aggregation": "sum", "field": "priority"},
    ]
    items = [
        {"code": str(n), "name": NAME, "definition": "d", **({"measure": m} if m else {})}
        for n, m in enumerate(measures, 1)
    ]
    catalog = Catalog({"survey": survey(spark, sf_dir)})
    run = evaluate_registry(spark, {"indicators": items}, catalog)
    done = run.computed.select("code", F.lit("computed").alias("part"), "reason")
    return done.unionByName(run.not_computable.select("code", F.lit("not_computable").alias("part"), "reason"))


PERIOD = Period("visit_date", date(1997, 3, 1), date(1998, 8, 31))


@query("flt_period", SURVEY + """
SELECT record_id, strftime(visit_date, '%Y-%m-%d') AS day FROM survey
WHERE visit_date >= TIMESTAMP '1997-03-01' AND visit_date < TIMESTAMP '1998-09-01'""")
def _flt_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope(survey(spark, sf_dir), PERIOD).select(
        "record_id", F.date_format("visit_date", "yyyy-MM-dd").alias("day")
    )


@query("flt_drop_empty", ACTIVITY + """
SELECT "Activity", count(*) AS n_rows, count(DISTINCT record_id) AS n_records FROM activity GROUP BY 1""")
def _flt_drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir, services=True)
    one = rows.select("record_id", F.explode(activity_list(rows, read_spec(FIVE_W))).alias("Activity"))
    return one.groupBy("Activity").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record_id").alias("n_records")
    )


@query("drop_pii", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _drop_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return drop_pii(customer, pii_detect(customer))


def _small_five_w(**changes) -> dict:
    return {**FIVE_W, "where": ["region"], "when": {"field": "visit_date", "granularity": "none"}, **changes}


@query("constant_cols", ACTIVITY + """
SELECT 'Relief Org' AS "Organization", 'P-1' AS "Project", region, "Activity",
       count(DISTINCT household_id) AS "Beneficiaries" FROM activity GROUP BY region, "Activity" """)
def _constant_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five_w(survey(spark, sf_dir, services=True), _small_five_w(whom={"id_field": "household_id"})).table


@query("rename_labels", ACTIVITY + f"""
SELECT region, "Activity", count(DISTINCT household_id) AS "Beneficiaries", {segment_columns()}
FROM activity GROUP BY region, "Activity" """)
def _rename_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five_w(survey(spark, sf_dir, services=True), _small_five_w(fixed=None)).table


@query("numeric_cast", """
SELECT o_orderstatus, count(*) FILTER (o_orderkey % 10 <> 0) AS n_numbers,
       count(*) FILTER (o_orderkey % 10 = 0) AS n_bad,
       round(sum(o_totalprice) FILTER (o_orderkey % 10 <> 0), 2) AS total FROM orders GROUP BY 1""")
def _numeric_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderpriority")).otherwise(
        F.concat(F.lit(" "), F.col("o_totalprice").cast("string"), F.lit("\t"))
    )
    cells = table(spark, sf_dir, "orders").select("o_orderstatus", cell.alias("cell"))
    number = to_number(col("cell"), "text")
    return cells.groupBy("o_orderstatus").agg(
        F.count(number).alias("n_numbers"), F.count_if(number.isNull()).alias("n_bad"),
        F.round(F.sum(number), 2).alias("total"),
    )
