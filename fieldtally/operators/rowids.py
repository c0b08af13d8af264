"""A guaranteed row id: keep a usable one, else derive it from content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtally.functions.columns import col
from fieldtally.session import staged

# Columns that may already hold an id, separators and length of the content hash.
ID_CANDIDATES = ("_uuid", "_id")
ROW_ID = "_row_id"
PAIR, FIELD = "\x1e", "\x1f"
HASH_CHARS = 16

ABSENT = "\x00"  # a missing cell hashes unlike any text
CHUNK = 1_000_000  # copies of one record regenerated by one task
BROADCAST_HASHES = 1_000_000  # 16-character hashes: some tens of megabytes


def unique_id(df: DataFrame) -> str | None:
    """The first candidate that is never missing and never repeats (as text), or None."""
    for name in ID_CANDIDATES:
        if name in df.columns:
            per_id = df.groupBy(col(name).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"))
            faults = F.count_if(F.col("id").isNull() | (F.col("n") > 1)).alias("faults")
            if per_id.agg(faults).first().faults == 0:
                return name
    return None


def content_hash(df: DataFrame) -> Column:
    """First hex digits of SHA-1 over ``name value`` pairs, columns sorted by name."""
    cells = [
        F.concat(F.lit(name + PAIR), F.coalesce(col(name).cast("string"), F.lit(ABSENT)))
        for name in sorted(df.columns)
    ]
    digest = F.sha1(F.encode(F.concat_ws(FIELD, *cells), "UTF-8"))
    # declared never NULL, so that a join on it does not hash every row a second time to test that
    return F.coalesce(F.substring(digest, 1, HASH_CHARS), F.lit(""))


def derived_ids(df: DataFrame) -> DataFrame:
    """Add ``_row_id``: the content hash, and ``-n`` on the n-th repeat.

    Records whose hash is unique need no shuffle of their columns, unless too many others repeat to say so
    by a broadcast. Equal records are interchangeable, so
    they are counted (combined before the shuffle, however many copies there are) and written out again
    with their numbers, in chunks, instead of being numbered inside one sorted group. Everything follows
    from content alone, so a lost task repeats itself exactly.
    """
    hashed = df.withColumn(ROW_ID, content_hash(df))
    copies = hashed.groupBy(ROW_ID).agg(F.count(F.lit(1)).alias("__n"))
    # written once: it is counted, and then joined twice
    repeated = staged(copies.filter(F.col("__n") > 1).select(ROW_ID), "hashes")
    n_repeated = repeated.count()
    if n_repeated == 0:
        return hashed
    single, copied = None, hashed
    if n_repeated <= BROADCAST_HASHES:
        repeated = F.broadcast(repeated)
        single = hashed.join(repeated, ROW_ID, "left_anti")
        copied = hashed.join(repeated, ROW_ID, "left_semi")
    columns = list(map(col, df.columns))
    groups = copied.groupBy(ROW_ID, *columns).agg(F.count(F.lit(1)).alias("__n"))
    # different records can share a 16-digit hash; they number on from one another
    before = Window.partitionBy(ROW_ID).orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    last_chunk = F.floor((F.col("__n") - 1) / CHUNK)
    chunks = groups.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
    many = chunks.filter(F.col("__n") > CHUNK).repartition(ROW_ID, "__chunk")
    few = chunks.filter(F.col("__n") <= CHUNK)
    start = F.col("__chunk") * CHUNK
    stop = F.least(start + CHUNK, F.col("__n")) - 1
    spread = few.unionByName(many).withColumn("__k", F.explode(F.sequence(start, stop)))
    number = F.col("__from") + F.col("__k")
    suffix = F.when(number > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise("")
    numbered = spread.select(*columns, F.concat(F.col(ROW_ID), suffix).alias(ROW_ID))
    return numbered if single is None else single.select(*columns, ROW_ID).unionByName(numbered)


def ensure_row_ids(df: DataFrame) -> DataFrame:
    """The frame itself when it has a usable id, else the frame with ``_row_id``."""
    return df if unique_id(df) is not None else derived_ids(df)


def _content_order(df: DataFrame) -> list[Column]:
    """An order of rows by their content: a 64-bit hash, and the cells themselves where two hashes are equal."""
    columns = list(map(col, df.columns))
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) or "map<" in f.dataType.simpleString() for f in df.schema.fields):
        return [content_hash(df)]  # neither hashed nor ordered by Spark
    return [F.xxhash64(*columns), *columns]


def keep_first(df: DataFrame, id_field: str, order: Sequence[Column]) -> DataFrame:
    """The first row of every id in the given order; rows without an id all stay. Ties are settled by content.

    The rank limit is applied inside each task before the shuffle, so a hot id costs one row per task.
    Rows without an id take no part in the shuffle.
    """
    first = Window.partitionBy(col(id_field)).orderBy(*order, *_content_order(df))
    ranked = df.filter(col(id_field).isNotNull()).withColumn("__rank", F.row_number().over(first))
    kept = ranked.filter(F.col("__rank") == 1).drop("__rank")
    if not df.schema[id_field].nullable:
        return kept
    return kept.unionByName(df.filter(col(id_field).isNull()))
