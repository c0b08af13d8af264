"""The driver's tables, the survey-shaped view over them, and the query register."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldtally.session import configure, scratch_path
from fieldtally.sources.tables import Catalog, scan_parquet
from fieldtally.sources.verdicts import keep_verdict

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SCHEMAS: dict[str, StructType] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its inventory key, with the SQL that must agree with it."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; these never change, so each schema is looked up once."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return scan_parquet(spark, path, SCHEMAS[path])


def survey(spark: SparkSession, sf_dir: str, services: bool = False) -> DataFrame:
    """One row per order seen as a household visit; ``services`` adds the multi-valued column.

    Regions and nations are two fixed tables of 5 and 25 rows; customers grow with the data, so that join
    is left to the optimizer. An order has at most a handful of distinct flag pairs.
    """
    places = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    homes = table(spark, sf_dir, "customer").join(
        F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")
    )
    visits = table(spark, sf_dir, "orders").join(homes, F.col("o_custkey") == F.col("c_custkey"))
    columns = [
        F.col("o_orderkey").alias("record_id"),
        F.col("c_custkey").alias("household_id"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("country"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment")).alias("segment"),
        F.col("o_orderdate").alias("visit_date"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("priority"),
    ]
    if services:
        pair = F.concat("l_returnflag", "l_linestatus")
        flags = (
            table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
            .agg(F.concat_ws(" ", F.sort_array(F.collect_set(pair))).alias("services"))
        )
        visits = visits.join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        columns.append(F.col("services"))
    return visits.select(*columns)


def landed_survey(spark: SparkSession, sf_dir: str) -> Catalog:
    """The view as a stored table, its personal-data columns looked up when it was written."""
    root = scratch_path(spark, "landed")
    survey(spark, sf_dir).write.parquet(f"{root}/survey")
    keep_verdict(spark, f"{root}/survey")
    return Catalog.of_folder(spark, root, "survey")


# The same view for the oracle; token order inside ``services`` does not matter to any query.
SURVEY = """
WITH flags AS (
  SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ' ') AS services
  FROM lineitem GROUP BY l_orderkey
), survey AS (
  SELECT o_orderkey AS record_id, c_custkey AS household_id, r_name AS region, n_name AS country,
         CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS segment,
         o_orderdate AS visit_date, o_totalprice AS amount, o_orderpriority AS priority, services
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN flags ON l_orderkey = o_orderkey
)
"""

# One row per record and activity.
ACTIVITY = SURVEY + """, activity AS (
  SELECT *, unnest(string_split(services, ' ')) AS "Activity",
         strftime(visit_date, '%Y-%m') AS "Period", coalesce(segment, '(missing)') AS seg
  FROM survey WHERE services IS NOT NULL
)
"""

FIVE_W = {
    "dataset": "survey",
    "fixed": {"Organization": "Relief Org", "Project": "P-1"},
    "where": ["region", "country"],
    "when": {"field": "visit_date", "granularity": "month"},
    "what": {"field": "services", "split": " "},
    "whom": {"id_field": "household_id", "disaggregation": ["segment"]},
}

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "(missing)")


def segment_columns(expression: str = "household_id", where: str = "seg") -> str:
    """Oracle columns of the segment breakdown, one per category."""
    return ", ".join(
        f"count(DISTINCT CASE WHEN {where} = '{s}' THEN {expression} END) AS \"segment={s}\"" for s in SEGMENTS
    )
