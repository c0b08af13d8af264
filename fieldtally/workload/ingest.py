"""Scans, sources, sinks, row ids and set operations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions.columns import col
from fieldtally.operators.profile import union_all
from fieldtally.operators.rowids import ROW_ID, derived_ids, keep_first
from fieldtally.plans.report import evaluate_registry
from fieldtally.session import scratch_path
from fieldtally.sources.documents import doc_text, scan_documents
from fieldtally.sources.logs import LOG_SCHEMA, log_damage, log_scan, log_summary
from fieldtally.sources.pages import rows_to_table, scan_json_pages
from fieldtally.sources.sinks import sink_clean, sink_pull
from fieldtally.sources.synthetic import synthetic_survey
from fieldtally.sources.tables import Catalog, scan_csv
from fieldtally.workload.base import SURVEY, query, survey, table

PAGE = 1000


@query("scan_csv", """
SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'HOUSEHOLD') AS segment, c_nationkey % 2 = 0 AS even
FROM customer""")
def _scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_acctbal",
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "NA").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_nationkey") % 2 == 0, "True").otherwise("False").alias("even"),
    ).write.csv(path, header=True)
    return scan_csv(spark, path)


@query("scan_parquet", """
SELECT o_orderkey, o_totalprice, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS day
FROM orders""")
def _scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", "o_totalprice", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )


def _landed_pages(spark: SparkSession, sf_dir: str) -> str:
    """Event rows as a form server pages them: one file per page of at most 1,000 rows."""
    path = scratch_path(spark, "pages")
    row = F.struct(
        "event_id", "user_id", "event_type",
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )
    pages = table(spark, sf_dir, "events").groupBy((F.floor(F.col("event_id") / PAGE)).alias("page"))
    landed = pages.agg(F.count(F.lit(1)).alias("count"), F.collect_list(row).alias("results")).drop("page")
    landed.write.option("maxRecordsPerFile", 1).json(path)
    return path


@query("scan_json_pages", """
SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events""")
def _scan_json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_json_pages(spark, _landed_pages(spark, sf_dir))


@query("scan_json_bare_pages", """
SELECT event_id, user_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events""")
def _scan_json_bare_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "bare-pages")
    row = F.struct(
        "event_id", "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    pages = table(spark, sf_dir, "events").groupBy((F.floor(F.col("event_id") / PAGE)).alias("page"))
    arrays = pages.agg(F.to_json(F.collect_list(row)).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return scan_json_pages(spark, path, wrapped=False)


@query("union_pages", """
SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type""")
def _union_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_json_pages(
        spark, _landed_pages(spark, sf_dir),
        schema="event_id bigint, user_id bigint, event_type string, value double",
    )
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users")
    )


@query("rows_to_table", """
SELECT event_id, CASE WHEN event_type = 'click' THEN user_id END AS clicked_by,
       CASE WHEN event_type = 'view' THEN value END AS viewed FROM events""")
def _rows_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    # to_json leaves absent values out, so the objects' keys differ by row
    record = F.to_json(F.struct(
        "event_id",
        F.when(F.col("event_type") == "click", F.col("user_id")).alias("clicked_by"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("viewed"),
    ))
    return rows_to_table(table(spark, sf_dir, "events").select(record.alias("record")), "record")


@query("resolve_dataset", """
SELECT 'customer' AS dataset, 'customer' AS resolved, false AS used_clean, count(*) AS n_rows FROM customer
UNION ALL
SELECT 'orders', 'orders_clean', true, count(*) FROM orders WHERE o_totalprice > 0 AND o_orderstatus <> 'P'
UNION ALL
SELECT 'orders_clean', 'orders_clean', true, count(*) FROM orders WHERE o_totalprice > 0 AND o_orderstatus <> 'P'""")
def _resolve_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    catalog = Catalog({
        "customer": table(spark, sf_dir, "customer"),
        "orders": orders,
        "orders_clean": orders.filter((F.col("o_totalprice") > 0) & (F.col("o_orderstatus") != "P")),
    })
    rows = []
    for name in ("customer", "orders", "orders_clean"):
        resolved, used_clean = catalog.resolve(name)
        rows.append(catalog.tables[resolved].agg(
            F.lit(name).alias("dataset"), F.lit(resolved).alias("resolved"),
            F.lit(used_clean).alias("used_clean"), F.count(F.lit(1)).alias("n_rows"),
        ))
    return union_all(rows)


@query("doc_text_scan", """
SELECT doc_id, md5(shown) AS text_md5, length(shown) AS n_chars_shown, length(text) > 30000 AS truncated
FROM (SELECT doc_id, text, CASE WHEN length(text) > 30000
        THEN substr(text, 1, 30000) || chr(10) || '[... document truncated ...]' ELSE text END AS shown
      FROM documents)""")
def _doc_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = doc_text(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(shown.cast("binary")).alias("text_md5"),
        F.length(shown).cast("bigint").alias("n_chars_shown"), (F.length("text") > 30000).alias("truncated"),
    )


@query("doc_csv_scan", """
WITH rows AS (
  SELECT c_nationkey % 5 AS part, c_custkey::VARCHAR || chr(9) || c_name || ', "' || c_mktsegment || '"' || chr(9) || coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS line,
    row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) AS n FROM customer
)
SELECT part::VARCHAR AS part, md5('key' || chr(9) || 'label' || chr(9) || 'kind' || chr(10) || string_agg(line || chr(10), '' ORDER BY n) FILTER (n < 200)
  || CASE WHEN count(*) >= 200 THEN '[... more rows omitted ...]' || chr(10) ELSE '' END) AS text_md5, count(*) AS n_rows
FROM rows GROUP BY part""")
def _doc_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as CSV documents with quoted cells, read back as capped texts and, for the count, as a table."""
    path = scratch_path(spark, "csv-documents")
    segment = F.col("c_mktsegment")
    rows = table(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") % 5).alias("part"), F.col("c_custkey").alias("key"),
        F.concat("c_name", F.lit(', "'), segment, F.lit('"')).alias("label"), F.when(segment != "BUILDING", segment).alias("kind"),
    )
    rows.repartition("part").sortWithinPartitions("part", "key").write.partitionBy("part").csv(path, header=True, escape='"')
    texts = scan_documents(spark, path).select(F.regexp_extract("path", r"part=(\d+)", 1).alias("part"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    counted = spark.read.csv(path, header=True, escape='"').groupBy(F.col("part").cast("string").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
    return texts.join(counted, "part")


def _session_log(spark: SparkSession, sf_dir: str) -> str:
    """Events as a session log, JSON lines whose payload differs by kind: some costs are words, some lines cut or no object."""
    kinds = {"click": "tool_use", "view": "code_executed", "error": "pii_block", "purchase": "result"}
    kind = F.coalesce(
        *(F.when(F.col("event_type") == event, name) for event, name in kinds.items()), F.lit("user_message")
    )
    sold = F.when(F.col("event_type") == "purchase", F.col("value"))
    shared = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), kind.alias("kind"), "event_id", "user_id"]
    line = F.when(
        F.col("event_id") % 13 == 0, F.to_json(F.struct(*shared, F.when(sold.isNotNull(), "n/a").alias("cost_usd")))
    ).otherwise(F.to_json(F.struct(*shared, sold.alias("cost_usd"))))
    line = F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 25)).when(F.col("event_id") % 101 == 0, "[1, 2]").otherwise(line)
    path = scratch_path(spark, "log")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return path


LOGGED = """
WITH logged AS (
  SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
         CASE event_type WHEN 'click' THEN 'tool_use' WHEN 'view' THEN 'code_executed' WHEN 'error' THEN 'pii_block'
           WHEN 'purchase' THEN 'result' ELSE 'user_message' END AS kind,
         CASE WHEN event_type = 'purchase' AND event_id % 13 <> 0 THEN value END AS cost_usd
  FROM events WHERE event_id % 97 <> 0 AND event_id % 101 <> 0
)"""
SUMMED = """count(*) AS events, count(*) FILTER (kind = 'tool_use') AS tool_calls,
       count(*) FILTER (kind = 'code_executed') AS code_runs, count(*) FILTER (kind = 'pii_block') AS pii_blocks,
       round(coalesce(sum(cost_usd) FILTER (kind = 'result'), 0), 6) AS cost_usd"""


@query("log_scan", LOGGED + "SELECT event_id, ts, kind, cost_usd FROM logged")
def _log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_scan(spark, _session_log(spark, sf_dir), "event_id bigint, ts string, kind string, cost_usd double")


@query("log_summary", LOGGED + f"SELECT user_id, {SUMMED} FROM logged GROUP BY user_id")
def _log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_scan(spark, _session_log(spark, sf_dir), LOG_SCHEMA + ", user_id bigint")
    return log_summary(log, ["user_id"])


@query("log_summary_open", LOGGED + f"SELECT {SUMMED} FROM logged")
def _log_summary_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_summary(log_scan(spark, _session_log(spark, sf_dir)))


@query("log_damage", """
SELECT count(*) AS lines, count(*) FILTER (event_id % 97 = 0 OR event_id % 101 = 0) AS damaged,
       count(*) FILTER (event_id % 97 <> 0 AND event_id % 101 <> 0) AS events FROM events""")
def _log_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _session_log(spark, sf_dir)
    events = log_scan(spark, path, LOG_SCHEMA).agg(F.count(F.lit(1)).alias("events"))
    counted = log_damage(spark, path).agg(F.sum("lines").alias("lines"), F.sum("damaged").alias("damaged"))
    return counted.join(F.broadcast(events))  # one row each


def _without_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer rows cut to two columns, so that most are copies of one another; some cells are missing."""
    return table(spark, sf_dir, "customer").select(
        "c_nationkey", F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).alias("c_mktsegment")
    )


@query("sink_pull", """
SELECT c_nationkey, nullif(c_mktsegment, 'HOUSEHOLD') AS c_mktsegment, count(*) AS n_rows, count(*) AS n_ids,
       (SELECT count(*) FROM customer) AS written
FROM customer GROUP BY 1, 2""")
def _sink_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "pull")
    written = sink_pull(_without_id(spark, sf_dir), root, "Household Survey (v2)!")
    back = spark.read.parquet(f"{root}/household_survey_v2")
    return back.groupBy("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(ROW_ID).alias("n_ids"),
        F.lit(written).cast("bigint").alias("written"),
    )


@query("sink_clean", """
SELECT count(*) AS n_rows, count(*) AS n_ids, round(sum(o_totalprice), 2) AS total FROM orders""")
def _sink_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "clean")
    orders = table(spark, sf_dir, "orders")
    copies = union_all([orders, orders.filter(F.col("o_orderkey") % 101 == 0)])
    path = sink_clean(keep_first(copies, "o_orderkey", [col("o_orderdate")]), root, "orders")
    return spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_ids"),
        F.round(F.sum("o_totalprice"), 2).alias("total"),
    )


@query("sink_report", SURVEY + """
SELECT '1' AS code, 'computed' AS status, count(DISTINCT household_id)::DOUBLE AS actual, '2026-09-14' AS day
FROM survey
UNION ALL SELECT '2', 'not_computable', NULL, '2026-09-14'""")
def _sink_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = {"uk": "Охоплені", "en": "Reached"}
    registry = {"indicators": [
        {"code": "1", "name": name, "definition": "d", "disaggregation": ["region"],
         "measure": {"dataset": "survey", "aggregation": "count_unique", "field": "household_id"}},
        {"code": "2", "name": name, "definition": "d"},
    ]}
    run = evaluate_registry(spark, registry, Catalog({"survey": survey(spark, sf_dir)}))
    root, day = scratch_path(spark, "report"), date(2026, 9, 14)
    run.save(root, day)
    paths = run.save(root, day)  # a rerun of the day replaces it
    return spark.read.parquet(paths["summary"]).select(
        "code", "status", "actual", F.col("report_date").cast("string").alias("day")
    )


@query("synthetic_survey", """
SELECT count(*) + 30 AS n_rows, count(*) AS n_ids, 30 AS n_copies, 15 AS n_bad_ages, 10 AS n_future,
       count(*) * 3 // 100 AS n_without_sex, 9 AS n_oblasts, 19 AS n_columns FROM customer""")
def _synthetic_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"))
    fake = synthetic_survey(spark, numbers.count(), 42, base=numbers)
    once = fake.groupBy("_uuid").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("head_age") == 999).cast("int")).alias("bad"),
        F.max((F.col("submission_date") > "2026-12-31").cast("int")).alias("future"),
        F.max(F.col("head_sex").isNull().cast("int")).alias("nosex"), F.first("oblast").alias("oblast"),
    )
    return once.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"),
        (F.sum("n") - F.count(F.lit(1))).cast("int").alias("n_copies"),
        F.sum("bad").cast("int").alias("n_bad_ages"), F.sum("future").cast("int").alias("n_future"),
        F.sum("nosex").alias("n_without_sex"), F.count_distinct("oblast").cast("int").alias("n_oblasts"),
        F.lit(len(fake.columns)).alias("n_columns"),
    )


@query("row_id", r"""
SELECT c_nationkey, seg AS c_mktsegment,
       h || CASE WHEN k > 1 THEN '-' || (k - 1) ELSE '' END AS _row_id
FROM (SELECT *, row_number() OVER (PARTITION BY h) AS k FROM (
  SELECT c_nationkey, nullif(c_mktsegment, 'HOUSEHOLD') AS seg,
    substr(sha1('c_mktsegment' || chr(30) || coalesce(nullif(c_mktsegment, 'HOUSEHOLD'), chr(0)) || chr(31)
                || 'c_nationkey' || chr(30) || c_nationkey), 1, 16) AS h FROM customer))""")
def _row_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_ids(_without_id(spark, sf_dir))


@query("dedup_keep_first", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders""")
def _dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    first = orders.withColumn("place", F.lit(0))
    later = orders.filter(F.col("o_orderkey") % 101 == 0).withColumns(
        {"place": F.lit(1), "o_orderstatus": F.lit("later")}
    )
    return keep_first(union_all([first, later]), "o_orderkey", [col("place")]).drop("place")


@query("union_all_dups", """
SELECT o_orderstatus, count(*) + count(*) FILTER (o_orderkey % 101 = 0) AS n_rows, count(*) AS n_ids
FROM orders GROUP BY o_orderstatus""")
def _union_all_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    both = union_all([orders, orders.filter(F.col("o_orderkey") % 101 == 0)])
    return both.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_ids")
    )
