"""Exact-name column lookup and the value families the operators tell apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType, T.DecimalType)
TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A top-level column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def new_name(name: str, taken: Sequence[str]) -> str:
    """The name, or the first numbered one that no column has."""
    return next(n for n in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if n not in taken)


def sql_text(value: object) -> str:
    """A SQL string literal, or a typed NULL."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_number(value: float | int | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST('{float(value)!r}' AS DOUBLE)"


def family(dtype: T.DataType) -> str:
    """``whole``, ``real``, ``text``, ``bool``, ``time`` or ``other``."""
    if isinstance(dtype, WHOLE):
        return "whole"
    if isinstance(dtype, REAL):
        return "real"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, TIME):
        return "time"
    return "other"


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: family(f.dataType) for f in df.schema.fields}


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes NULL, so counts and distinct counts skip it."""
    reals = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not reals:
        return df
    return df.withColumns({name: F.nanvl(col(name), F.lit(None)) for name in reals})
