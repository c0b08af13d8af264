"""Landed submission pages (JSON) and rows with differing keys.

Pages are read once: their rows go to the shared folder as VARIANT, beside a mark for what could not be read. Damage and the
union of keys come from one pass over that copy, and so does the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.errors import ReportError
from fieldtally.functions.columns import col
from fieldtally.session import staged
from fieldtally.sources.open_json import as_fields, fields_of, flat, is_object, json_object, union_of_keys

NAMED = 5  # damaged files that an error names


def _no_rows() -> ReportError:
    return ReportError("0 submissions in the pages: there is nothing to pull.")


def scan_json_pages(
    spark: SparkSession, path: str, wrapped: bool = True, schema: T.StructType | str | None = None
) -> DataFrame:
    """All rows of all landed page files below ``path``.

    ``wrapped`` pages are ``{"results": [row, ...]}``; the others are bare arrays (or one row). Keys may differ from
    row to row: the table has their union, with a key of several types as text. A given ``schema`` (of one row) names the columns
    instead; a cell of another type is missing. A page that cannot be read, was cut off, or holds a row that is no object
    stops the pull with its file name; so does a pull without rows. A page is one task's text; a row is at most 16 MB.
    """
    files = spark.read.text(path, wholetext=True).where(F.trim("value", F.lit(" \t\r\n")) != "")
    options = {"columnNameOfCorruptRecord": "damaged"}
    if wrapped:
        parsed = F.from_json("value", "results array<variant>, damaged string", options)
        pages = files.select(parsed.alias("page"), "_metadata.file_path").select(
            "file_path", F.col("page.results").alias("rows"), (F.col("page").isNull() | F.col("page.damaged").isNotNull()).alias("bad")
        )
    else:
        one = json_object(F.col("value"))
        rows = F.coalesce(F.from_json("value", "array<variant>"), F.when(one.isNotNull(), F.array(one)))
        pages = files.select("_metadata.file_path", rows.alias("rows")).withColumn("bad", F.col("rows").isNull())
    broken = F.when(F.col("bad"), F.array(F.lit(None).cast("variant")))
    rows = pages.select("file_path", F.explode(F.coalesce(broken, F.col("rows"))).alias("row"))
    held = staged(rows.withColumn("bad", ~is_object(F.col("row"))), "page-rows")
    known = held.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.schema_of_variant_agg("row").alias("keys")
    ).first()
    if known["bad"]:
        file = F.element_at(F.split("file_path", "/"), -1).alias("file")
        names = [r["file"] for r in held.where("bad").select(file).distinct().orderBy("file").limit(NAMED).collect()]
        raise ReportError(f"JSON cannot be read in {', '.join(names)}: pull the pages again")
    if not known["n"]:
        raise _no_rows()
    if schema is None:
        fields = union_of_keys(known["keys"], T.StringType())
        if not fields:
            raise _no_rows()
        return held.select(*fields_of(F.col("row"), fields))
    return flat(held.select(*fields_of(F.col("row"), as_fields(schema))))


def rows_to_table(rows: DataFrame, column: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table from one JSON object per row of a text column: the union of keys, absent keys NULL.

    The objects are written once to the shared folder, where their keys are counted together (or ``schema`` names the
    columns) and the table is read. A NULL is no row; objects that cannot be read stop it with their number.
    """
    objects = rows.select(col(column).alias("value")).where(F.col("value").isNotNull())
    held = staged(objects.select(json_object(F.col("value")).alias("row")), "object-rows")
    known = held.agg(F.count_if(F.col("row").isNull()).alias("bad"), F.schema_of_variant_agg("row").alias("keys")).first()
    if known["bad"]:
        raise ReportError(f"{known['bad']} of the rows of {column!r} are no JSON objects that can be read")
    if schema is not None:
        return flat(held.select(*fields_of(F.col("row"), as_fields(schema))))
    return held.select(*fields_of(F.col("row"), union_of_keys(known["keys"], T.StringType())))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or an error before anything is written when it is empty."""
    if df.isEmpty():
        raise ReportError(f"{what!r} has 0 submissions: there is nothing to pull.")
    return df
