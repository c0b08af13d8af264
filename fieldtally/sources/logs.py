"""Session logs: one JSON object per line, and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.columns import WHOLE, col
from fieldtally.sources.open_json import JSON_BLANKS, as_fields, fields_of, json_object, numeric, union_of_keys

# The kinds a summary counts.
COUNTED = {"tool_use": "tool_calls", "code_executed": "code_runs", "pii_block": "pii_blocks"}
LOG_SCHEMA = "ts string, kind string, cost_usd double"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is not blank, and the object that it is (NULL: damaged)."""
    lines = spark.read.text(path).where(F.trim("value", F.lit(JSON_BLANKS)) != "")
    return lines.select(json_object(F.col("value")).alias("event"), "_metadata.file_path")


def log_scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """All events below ``path``: one per line that holds an object, whatever its payload.

    With ``schema`` its columns: a field that is missing or of another type is NULL and the event stays; a text column takes
    any value, as JSON shows it. Without it the union of all keys: a key with several types is a VARIANT column.
    A line that is no object is no event; ``log_damage`` counts those. What is read of the events does not change which
    there are.
    """
    events = _lines(spark, path).where(F.col("event").isNotNull()).select("event")
    if schema is None:
        keys = events.agg(F.schema_of_variant_agg("event")).first()[0]
        fields = union_of_keys(keys, T.VariantType())
    else:
        fields = as_fields(schema)
    return events.select(*fields_of(F.col("event"), fields))


def log_damage(spark: SparkSession, path: str) -> DataFrame:
    """``(file, lines, damaged)`` of every log file; a line is damaged if it is not blank and no object."""
    file = F.element_at(F.split("file_path", "/"), -1)
    return _lines(spark, path).groupBy(file.alias("file")).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("event").isNull()).alias("damaged")
    )


def _cost(log: DataFrame) -> Column:
    """The cost where it is a number, from a column of any type."""
    if "cost_usd" in log.columns:
        kind, cost = log.schema["cost_usd"].dataType, F.col("cost_usd")
        if isinstance(kind, T.VariantType):
            return F.when(numeric(cost), F.try_variant_get(cost, "$", "double"))
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType, *WHOLE)):
            return cost.cast("double")
    return F.lit(None).cast("double")


def log_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Events, tool calls, code runs, blocks and cost (of ``result`` events, where it is a number); per session with ``by``."""
    kind = F.col("kind") if "kind" in log.columns else F.lit(None)
    if "kind" in log.columns and isinstance(log.schema["kind"].dataType, T.VariantType):
        kind = F.try_variant_get("kind", "$", "string")
    return log.groupBy(*map(col, by)).agg(
        F.count(F.lit(1)).alias("events"),
        *(F.count_if(kind == word).alias(name) for word, name in COUNTED.items()),
        F.round(F.coalesce(F.sum(F.when(kind == "result", _cost(log))), F.lit(0.0)), 6).alias("cost_usd"),
    )
