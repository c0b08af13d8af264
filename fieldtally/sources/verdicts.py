"""Which columns of a stored table hold personal data, decided once when it is written and kept beside it."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from fieldtally.operators.pii import pii_of_files

SUFFIX = ".personal"  # no dataset has a dot in its name


def _version(files: list[str]) -> str:
    """Names of a table's files, as a digest: writers never use a name twice."""
    return hashlib.sha256("\n".join(sorted(f.rsplit("/", 1)[-1] for f in files)).encode()).hexdigest()


def keep_verdict(spark: SparkSession, path: str) -> list[str]:
    """Look a Parquet table's columns up and write the answer beside it, one row per column."""
    table = spark.read.parquet(path)
    personal = pii_of_files(spark, path)
    version = _version(table.inputFiles())
    rows = [(name, name in personal, version) for name in table.columns]
    spark.createDataFrame(rows, "name string, personal boolean, version string").coalesce(1).write.mode("overwrite").parquet(path + SUFFIX)
    return personal


def kept_verdict(spark: SparkSession, path: str) -> list[str] | None:
    """The personal-data columns that were kept beside a table; None without an answer for these very files."""
    try:
        rows = spark.read.schema("name string, personal boolean, version string").parquet(path + SUFFIX).collect()
    except AnalysisException:
        return None
    table = spark.read.parquet(path)
    version = _version(table.inputFiles())
    known = {r["name"]: r["personal"] for r in rows if r["version"] == version}
    return [name for name in table.columns if known[name]] if set(known) == set(table.columns) else None
