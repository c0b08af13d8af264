"""Ad-hoc questions: SQL over tables without their personal columns, redacted and capped."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtally.errors import ReportError
from fieldtally.functions.columns import col
from fieldtally.functions.text import cap_bytes
from fieldtally.operators.pii import shown
from fieldtally.sources.tables import Catalog

# Rows and bytes an answer may have.
ROW_CAP = 50
BYTE_CAP = 32_768


def publish(catalog: Catalog, names: Iterable[str] | None = None) -> list[str]:
    """Register the stripped tables as temporary views."""
    published = list(catalog.tables if names is None else names)
    for name in published:
        catalog.stripped(name).createOrReplaceTempView(name)
    return published


@dataclass(frozen=True)
class Answer:
    """The capped, redacted rows, and one row ``(rows, shown, hidden, redacted)`` about them."""

    table: DataFrame
    notes: DataFrame


def _size(answer: DataFrame) -> Column:
    cells = [F.coalesce(F.octet_length(col(c).cast("string")), F.lit(0)) + 1 for c in answer.columns]
    return reduce(operator.add, cells)


RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
NAMED_QUERY = re.compile(r"^CTE \[([^\]]*)\]$|(?<=[ :+-]) ?CTE \[([^\]]*)\]", re.MULTILINE)


def _checked(spark: SparkSession, query: str, published: Iterable[str]) -> str:
    """The query as the inside of a selection, which no command can be, if all it reads are published views.

    Nothing is run for this: the relations are read from the parsed plan that EXPLAIN shows.
    """
    inside = f"SELECT * FROM (\n{query}\n)"
    try:
        explained = spark.sql(f"EXPLAIN EXTENDED {inside}").first()[0]
    except Exception as problem:
        raise ReportError(f"the question is no single SQL query: {type(problem).__name__}") from None
    parsed = explained.partition("== Analyzed Logical Plan ==")[0]
    own = {name.strip().lower() for found in NAMED_QUERY.findall(parsed) for name in ",".join(found).split(",") if name.strip()}
    known = {name.lower() for name in published}
    for relation in RELATION.findall(parsed):
        name = relation.lower()
        hides = name in own and not spark.catalog.tableExists(relation)
        if name not in known and not hides:
            raise ReportError(f"the question reads {relation!r}; it may read {', '.join(sorted(known)) or 'nothing'}")
    return inside


def ask(spark: SparkSession, catalog: Catalog, query: str, rows: int = ROW_CAP, size: int = BYTE_CAP) -> Answer:
    """Answer one query from stripped views; all that is shown is redacted, and capped in rows and bytes.

    Commands, several statements, other views and files by path are refused; the views are gone afterwards.
    """
    published = publish(catalog)
    files = "spark.sql.runSQLOnFiles"
    before = spark.conf.get(files, "true")
    spark.conf.set(files, "false")
    try:
        raw = spark.sql(_checked(spark, query, published))
        if len(set(raw.columns)) < len(raw.columns):
            raise ReportError("two columns of the answer have the same name: give each its own")
    finally:
        spark.conf.set(files, before)
        for name in published:
            spark.catalog.dropTempView(name)
    parts = shown(raw)
    answer = raw.select(*(value.alias(name) for name, (value, _) in parts.items()))
    texts = [name for name, kind in answer.dtypes if kind == "string"]
    if texts:
        answer = answer.withColumns({n: cap_bytes(col(n), size) for n in texts})
    # at most ``rows`` rows are left here, in the order of the query
    first = answer.limit(rows).withColumn("__place", F.monotonically_increasing_id())
    so_far = Window.orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    first = first.withColumn("__size", F.sum(_size(answer)).over(so_far))
    table = first.filter((F.col("__size") <= size) | (F.col("__place") == 0)).orderBy("__place")
    table = table.select(*map(col, answer.columns))
    hits = reduce(operator.add, (F.coalesce(count, F.lit(0)) for _, count in parts.values()), F.lit(0))
    redacted = F.coalesce(F.sum(hits), F.lit(0))
    total = raw.agg(F.count(F.lit(1)).alias("rows"), redacted.cast("bigint").alias("redacted"))
    counted = table.agg(F.count(F.lit(1)).alias("shown"))
    # two frames of one row each
    notes = total.withColumn("at", F.lit(1)).join(F.broadcast(counted.withColumn("at", F.lit(1))), "at")
    return Answer(table, notes.select("rows", "shown", (F.col("rows") - F.col("shown")).alias("hidden"), "redacted"))


def adhoc_sql(spark: SparkSession, catalog: Catalog, query: str, rows: int = ROW_CAP) -> DataFrame:
    """The rows of ``ask`` alone."""
    return ask(spark, catalog, query, rows).table
