"""JSON objects whose keys and types nobody promised: parsed once as VARIANT, read field by field.

A field that is not of the type asked for is NULL; it never costs the rest of its object, whatever else is read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.columns import WHOLE, col

JSON_BLANKS = " \t\r\n"
NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
_KEY_OR_OBJECT = re.compile(r"(`(?:[^`]|``)*`)|OBJECT<")


def json_object(text: Column) -> Column:
    """The object that a text is, as VARIANT; NULL if it is none, or has one key twice."""
    bare = F.trim(text, F.lit(JSON_BLANKS))
    return F.when(bare.startswith("{") & bare.endswith("}"), F.try_parse_json(bare))


def is_object(value: Column) -> Column:
    """Whether a VARIANT is an object."""
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))


def member(value: Column, name: str) -> Column:
    """A member of an object as VARIANT, by any name."""
    if "'" in name and '"' in name:
        return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def numeric(value: Column) -> Column:
    """Whether a VARIANT is a number; a text of digits is none."""
    return F.coalesce(F.schema_of_variant(value).rlike(NUMBER), F.lit(False))


def typed(value: Column, kind: T.DataType) -> Column:
    """A VARIANT as a cell of the type, NULL if it is of another one. Text takes any value as JSON shows it."""
    if isinstance(kind, T.VariantType):
        return value
    out = F.try_variant_get(value, "$", kind.simpleString())
    if isinstance(kind, (*WHOLE, T.DoubleType, T.FloatType, T.DecimalType)):
        return F.when(numeric(value), out)
    if isinstance(kind, T.BooleanType):
        return F.when(F.schema_of_variant(value) == "BOOLEAN", out)
    return out


def fields_of(value: Column, fields: list[T.StructField]) -> list[Column]:
    return [typed(member(value, f.name), f.dataType).alias(f.name) for f in fields]


def union_of_keys(schema: str | None, mixed: T.DataType) -> list[T.StructField]:
    """Fields of objects from what ``schema_of_variant_agg`` says of them.

    Numbers with a fraction are double, nested values and keys without a value text, keys with several types ``mixed``.
    """
    if schema is None or not schema.startswith("OBJECT<"):
        return []
    struct = _KEY_OR_OBJECT.sub(lambda found: found[1] or "STRUCT<", schema)
    return [T.StructField(f.name, _plain(f.dataType, mixed)) for f in T.DataType.fromDDL(struct).fields]


def _plain(kind: T.DataType, mixed: T.DataType) -> T.DataType:
    if isinstance(kind, T.VariantType):
        return mixed
    if isinstance(kind, T.DecimalType) and kind.scale:
        return T.DoubleType()
    if isinstance(kind, (T.StructType, T.ArrayType, T.NullType)):
        return T.StringType()
    return kind


def as_fields(schema: T.StructType | str) -> list[T.StructField]:
    return list((T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields)


def flat(df: DataFrame) -> DataFrame:
    """Nested cells (attachments, coordinates) as JSON text: a table holds plain values only."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *(
            F.to_json(col(f.name)).alias(f.name) if isinstance(f.dataType, nested) else col(f.name)
            for f in df.schema.fields
        )
    )
