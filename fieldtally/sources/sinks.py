"""Where results are written. Raw tables are never written over."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.errors import ReportError
from fieldtally.operators.rowids import ensure_row_ids
from fieldtally.sources.pages import require_rows
from fieldtally.sources.verdicts import keep_verdict


def safe_name(name: str) -> str:
    return re.sub(r"[^\w-]+", "_", name).strip("_").lower()


def _below(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _bare(path: str) -> str:
    """A path without its scheme, so that spellings of one place compare equal."""
    return re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/", path)


def sink_pull(df: DataFrame, root: str, name: str) -> int:
    """Write a pulled form with row ids, replacing the previous pull; returns the rows written.

    Its personal-data columns are looked up here, once, so that no report has to.
    """
    path = _below(root, safe_name(name))
    ensure_row_ids(require_rows(df, name)).write.mode("overwrite").parquet(path)
    keep_verdict(df.sparkSession, path)
    return df.sparkSession.read.parquet(path).count()


def sink_clean(df: DataFrame, root: str, name: str) -> str:
    """Write the clean copy beside the raw table as ``<name>_clean``; returns the path."""
    if name.endswith("_clean"):
        raise ReportError(f"{name!r} is a clean copy already: clean the raw table")
    path = _below(root, f"{name}_clean")
    # names that the driver's file index holds anyway; overwriting what is read would lose it, and Spark lets it happen
    if any(_bare(f).startswith(_bare(path) + "/") for f in df.inputFiles()):
        raise ReportError(f"{name!r}: the clean copy cannot be built from itself")
    df.write.mode("overwrite").parquet(path)
    keep_verdict(df.sparkSession, path)
    return path


def sink_report(tables: Mapping[str, DataFrame], root: str, kind: str, day: date, form: str = "parquet") -> dict[str, str]:
    """Write each table under ``<kind>/<table>/report_date=<day>``; a rerun of the day replaces it."""
    paths = {}
    for table, frame in tables.items():
        paths[table] = _below(root, f"{kind}/{table}")
        writer = frame.withColumn("report_date", F.lit(day.isoformat())).write.mode("overwrite")
        writer = writer.partitionBy("report_date").option("partitionOverwriteMode", "dynamic")
        (writer.option("header", True).csv if form == "csv" else writer.parquet)(paths[table])
    return paths
