"""Distinct counts that can be added up across pulls: exact bitmaps, one set per pull.

A distinct count cannot be summed: an id that two days share would count twice. So a pull keeps, for each key (a lane
and category, or the keys of a 5W row), which ids it holds, as bitmaps of 32,768 numbered ids each. A further pull is
numbered and written without reading the ones before it, any choice of pulls is merged with a bitwise OR, and the
bits of the union are the count.

A store is a folder: ``ids`` numbers every id once, from 1, ``pulls/pull=<name>`` holds the bitmaps of a pull. Ids are compared
as text. Numbers are never given up, so a pull that is written again replaces its bitmaps only. One writer at a time.

A bitmap is 4 KB before compression whatever it holds; a key with few ids spread over all numbers costs one per
32,768 numbers that it touches, so ids are numbered in the order of the keys they first come with. A key with a third of all rows is spread over the numbers, not held by one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.errors import NotComputable, ReportError
from fieldtally.functions.categories import category_key
from fieldtally.functions.columns import col
from fieldtally.operators.filters import compile_filter
from fieldtally.operators.fivew import five_w_facts
from fieldtally.operators.measures import check_column
from fieldtally.operators.places import with_place
from fieldtally.session import staged

ID = "__id"
IDS = "id string, number bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _ids(spark: SparkSession, store: str) -> DataFrame:
    path = f"{store.rstrip('/')}/ids"
    return spark.read.schema(IDS).parquet(path) if _exists(spark, path) else spark.createDataFrame([], IDS)


def measure_facts(df: DataFrame, measure: Mapping, dimensions: Sequence[str] = (), pii: Sequence[str] = ()) -> DataFrame:
    """``(dimension, category, __id)`` of a ``count_unique`` measure; the rows without a dimension are the total.

    A row that the filter leaves out stays as a NULL id, so that its category is there with a count of zero.
    """
    if measure.get("aggregation") != "count_unique":
        raise NotComputable("only count_unique is kept as bitmaps; other counts add up as they are")
    field = check_column(df, measure.get("field"), pii)
    names = [check_column(df, name, pii) for name in dimensions]
    condition, needed = compile_filter(df, measure.get("filter") or None, pii)
    if needed:
        raise NotComputable("a filter over the values of another column needs all pulls at once")
    none = F.lit(None).cast("string")
    lanes = [F.struct(none.alias("dimension"), none.alias("category"))]
    lanes += [F.struct(F.lit(name).alias("dimension"), category_key(col(name)).alias("category")) for name in names]
    return df.select(F.when(condition, col(field)).alias(ID), F.inline(F.array(*lanes)))


def reach_facts(facts: DataFrame) -> DataFrame:
    """``(__id)`` of the 5W facts, that is of the rows with an activity: the union's count is the unique reach."""
    return facts.where("dimension IS NULL").select(ID).distinct()


def _home(keys: Sequence[str]) -> Column:
    """A number that is near for key sets which agree in their first columns; it holds 16 bits of each of four."""
    home = F.lit(0).cast("bigint")
    for n, name in enumerate(keys[:4]):
        home = home.bitwiseOR(F.shiftleft(F.xxhash64(col(name)).bitwiseAND(F.lit(0xFFFF)), 48 - 16 * n))
    return home


def _distinct_facts(facts: DataFrame) -> DataFrame:
    """The facts with ids as text, each once, written to the shared folder: they are numbered and then marked from there."""
    keys = [name for name in facts.columns if name != ID]
    return staged(facts.select(*map(col, keys), col(ID).cast("string").alias(ID)).distinct(), "pull")


def _check_name(pull: str) -> None:
    if not pull or "/" in pull:
        raise ReportError(f"{pull!r} cannot name a pull")


def add_pull(facts: DataFrame, store: str, pull: str) -> None:
    """Number the new ids of a pull and write its bitmaps; the same pull again replaces them.

    ``facts`` has ``__id`` and any key columns, rows may repeat. A key whose ids are all NULL is kept and counts zero;
    a pull without rows is an empty set. Earlier pulls are not read, only the numbers of their ids.
    """
    _check_name(pull)
    _write_pull(_distinct_facts(facts), store, pull)


def _write_pull(rows: DataFrame, store: str, pull: str) -> None:
    """Number and write distinct facts.

    New ids are numbered in the order of the keys they come with, so that ids which share keys share bitmaps, and a key is
    not spread thinly over all of them. Rows of a key and bitmap meet before it is made: a task that held one row of it
    would else send 4 KB for that row. As rows are distinct, they are 32,768 at most.
    """
    spark, root = rows.sparkSession, store.rstrip("/")
    keys = [name for name in rows.columns if name != ID]
    known = _ids(spark, store)
    homes = rows.where(col(ID).isNotNull()).groupBy(F.col(ID).alias("id")).agg(F.min(_home(keys)).alias("__home"))
    fresh = homes.join(known, "id", "left_anti")
    first = known.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    numbered = with_place(fresh, F.col("__home"), F.col("id"), name="place")
    numbered.select("id", (F.col("place") + first).alias("number")).write.mode("append").parquet(f"{root}/ids")

    found = rows.join(_ids(spark, store), F.col(ID) == F.col("id"), "left")
    marks = found.select(
        *map(col, keys), F.bitmap_bucket_number("number").alias("__bucket"), F.bitmap_bit_position("number").alias("__bit")
    )
    group = [*map(col, keys), F.col("__bucket")]
    bits = marks.repartition(*group).groupBy(*group).agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    bits.write.mode("overwrite").parquet(f"{root}/pulls/pull={pull}")


def merged_counts(spark: SparkSession, store: str, pulls: Sequence[str] | None = None, name: str = "value") -> DataFrame:
    """Distinct ids per key over the union of the named pulls (all, if None).

    Without key columns it is one row, zero where no id is. Pulls that are not named are not read.
    """
    root = f"{store.rstrip('/')}/pulls"
    if pulls is not None:
        missing = [p for p in pulls if not _exists(spark, f"{root}/pull={p}")]
        if missing or not pulls:
            raise ReportError(f"no such pull: {', '.join(missing) or 'none is named'}")
    kept = spark.read.option("basePath", root).parquet(*([root] if pulls is None else [f"{root}/pull={p}" for p in pulls]))
    keys = [c for c in kept.columns if c not in ("__bucket", "__bits", "pull")]
    union = kept.groupBy(*map(col, keys), "__bucket").agg(F.bitmap_or_agg("__bits").alias("__bits"))
    ids = F.coalesce(F.sum(F.bitmap_count("__bits")), F.lit(0)).cast("bigint").alias(name)
    return union.groupBy(*map(col, keys)).agg(ids) if keys else union.agg(ids)


def five_w_pull(df: DataFrame, spec: Mapping, store: str, pull: str, pii: Sequence[str] = ()) -> None:
    """Keep a pull's 5W rows (as ``five_w_long`` counts them) and its reach. The source is read once."""
    _check_name(pull)
    facts = _distinct_facts(five_w_facts(df, spec, pii))
    _write_pull(facts, f"{store.rstrip('/')}/matrix", pull)
    _write_pull(reach_facts(facts), f"{store.rstrip('/')}/reach", pull)
