"""The personal-data boundary: find such columns, drop them, redact text."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.columns import col, families
from fieldtally.functions.text import is_personal, redact, redaction_count
from fieldtally.session import staged

# Words that mark a column name, the size of the value sample, the share that marks it.
NAME_WORDS = (
    "name", "імʼя", "ім'я", "имя", "прізвище", "фамил", "phone", "тел", "gps", "lat", "lon", "coord",
    "address", "адрес", "email", "comment", "коммент", "enumerator", "інтерв",
)
SAMPLE = 50
SHARE = 0.3

BLOCK = 4096  # rows of a file whose values are counted together
HASH_SHIFT = 52  # content hashes are counted by their first 12 bits

_NAMES = re.compile("|".join(map(re.escape, NAME_WORDS)), re.IGNORECASE)


def named_personal(columns: Sequence[str]) -> list[str]:
    return [name for name in columns if _NAMES.search(name)]


def _as_text(value: Column, kind: str) -> Column:
    """Cell text as a reader sees it: a whole number kept as a double shows its digits."""
    if kind == "real":
        number = value.cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
        return F.when(whole, number.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def _candidates(df: DataFrame) -> dict[str, str]:
    """Columns whose values could match; a date, time or boolean never does."""
    named = set(named_personal(df.columns))
    return {n: k for n, k in families(df).items() if n not in named and k in ("text", "whole", "real")}


def pii_sample(df: DataFrame, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """``(column, value)``: the first values of each column in the given order (without one: by the rows' content).

    Equal places are settled by the value. No task sorts all its cells: with an order each column is read as one top list,
    of which a task holds the first values only; by content, see ``_first_values``. The content of a row is hashed once,
    before its cells are unfolded.
    """
    if not order:
        content = F.xxhash64(*map(col, columns)).alias("__content")
        rows = df.select(content, _cells(df, columns).alias("__cells")).select("__content", F.inline("__cells"))
        return _first_values(rows, ["__content"], {"__range": F.shiftright("__content", HASH_SHIFT)})
    kinds = families(df)
    tops = []
    for name in columns:
        present = df.withColumn("__value", _as_text(col(name), kinds[name])).where(F.col("__value").isNotNull())
        top = present.orderBy(*order, "__value").limit(SAMPLE)
        tops.append(top.select(F.lit(name).alias("column"), F.col("__value").alias("value")))
    return reduce(DataFrame.unionByName, tops)


def _cells(df: DataFrame, columns: Sequence[str]) -> Column:
    """The cells of a row, to be unfolded by column."""
    kinds = families(df)
    return F.array(*(
        F.struct(F.lit(name).alias("__column"), _as_text(col(name), kinds[name]).alias("__value")) for name in columns
    ))


def _first_values(cells: DataFrame, places: Sequence[str], blocks: Mapping[str, Column]) -> DataFrame:
    """The first values of each column of ``(places, __column, __value)``, without a sort of all cells.

    ``blocks`` are coarser than ``places`` and order alike. Values are counted per column and block; the blocks that hold the
    first ones are at most as many as these values, and only their cells are ordered. Cells of one place and value are
    counted, too, so that copies of a row are one line.
    """
    present = cells.where(F.col("__value").isNotNull()).withColumns(dict(blocks))
    by_column, counted = Window.partitionBy("__column"), F.count(F.lit(1)).alias("__n")

    def left(*order: str) -> Column:
        """How many values are wanted after those that stand before."""
        before = by_column.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.lit(SAMPLE) - F.coalesce(F.sum("__n").over(before), F.lit(0))

    filled = present.groupBy("__column", *blocks).agg(counted)
    filled = filled.withColumn("__rank", F.row_number().over(by_column.orderBy(*blocks))).where(F.col("__rank") <= SAMPLE)
    needed = filled.withColumn("__left", left(*blocks)).where(F.col("__left") > 0).select("__column", *blocks)
    needed = F.broadcast(staged(needed, "sample-blocks"))  # rows: at most the sample for each column
    found = present.join(needed, ["__column", *blocks], "left_semi").groupBy("__column", *places, "__value").agg(counted)
    first = found.withColumn("__left", left(*places, "__value")).where(F.col("__left") > 0)
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("__n", "__left")))
    return first.select(F.col("__column").alias("column"), F.col("__value").alias("value"), copies).drop("col")


def _shares(sample: DataFrame) -> dict[str, tuple[int, float]]:
    """By column how many values the sample has (none: no entry) and the share of hits; a row per column, no cell."""
    share = F.avg(is_personal(F.col("value")).cast("int")).alias("share")
    rows = sample.groupBy("column").agg(F.count(F.lit(1)).alias("n"), share).collect()
    return {r["column"]: (r["n"], r["share"]) for r in rows}


def _found(columns: Sequence[str], shares: dict[str, tuple[int, float]]) -> list[str]:
    named = set(named_personal(columns))
    return [name for name in columns if name in named or shares.get(name, (0, 0.0))[1] >= SHARE]


def pii_detect(df: DataFrame, order: Sequence[Column] = ()) -> list[str]:
    """Names of personal-data columns: by name, else by the share of hits among the first values.

    Without ``order`` "first" is decided by the rows' content, so the answer does not depend on how the frame is
    partitioned. Only column names reach the driver, never a cell.
    """
    candidates = list(_candidates(df))
    return _found(df.columns, _shares(pii_sample(df, order, candidates)) if candidates else {})


def pii_of_files(spark: SparkSession, path: str) -> list[str]:
    """Personal-data columns of a Parquet table, "first" being the order of its files by path and of their rows.

    The first file decides every column that has enough values there; only the others are looked up in all files.
    """
    df = spark.read.parquet(path)
    files, candidates = sorted(df.inputFiles()), list(_candidates(df))
    if not files or not candidates:
        return _found(df.columns, {})
    head = spark.read.schema(df.schema).option("basePath", path).parquet(files[0])
    shares = _shares(_in_file_order(head, candidates))
    sparse = [name for name in candidates if shares.get(name, (0, 0.0))[0] < SAMPLE]
    if sparse and len(files) > 1:
        shares |= _shares(_in_file_order(df, sparse))
    return _found(df.columns, shares)


def _in_file_order(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value)``: the first values of each column by file path and row."""
    places = {"__file": "_metadata.file_path", "__row": "_metadata.row_index"}
    cells = df.select(*(F.col(p).alias(n) for n, p in places.items()), F.inline(_cells(df, columns)))
    return _first_values(cells, list(places), {"__file": F.col("__file"), "__block": F.floor(F.col("__row") / BLOCK)})


def drop_pii(df: DataFrame, pii: Sequence[str]) -> DataFrame:
    return df.select(*(col(name) for name in df.columns if name not in set(pii)))


def shown(df: DataFrame) -> dict[str, tuple[Column, Column]]:
    """For every column what may be shown of it, and how many hits were taken out.

    Texts are redacted; nested cells are shown as redacted JSON; a number that reads like a phone is not shown.
    """
    out = {}
    for f in df.schema.fields:
        value, kind = col(f.name), families(df)[f.name]
        if kind == "text":
            out[f.name] = (redact(value), redaction_count(value))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            text = F.to_json(value)
            out[f.name] = (redact(text), redaction_count(text))
        elif kind in ("whole", "real"):
            hit = is_personal(_as_text(value, kind))
            out[f.name] = (F.when(~hit, value), hit.cast("int"))
        elif isinstance(f.dataType, T.BinaryType):
            text = F.try_validate_utf8(value.cast("string"))
            out[f.name] = (redact(text), redaction_count(text))
        else:
            out[f.name] = (value, F.lit(0))
    return out
