"""Places of rows in a total order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.session import staged


def with_place(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Add the place (from 1) of every row in the given order.

    Rows are dealt by ranges of the order and numbered inside each range; only the size of each range reaches the
    driver, which adds up what stands before it.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__key{n}" for n in range(len(order))]
    keyed = df.select("*", *(o.alias(k) for o, k in zip(order, keys, strict=True)))
    dealt = keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    rows = staged(dealt.withColumn("__row", F.monotonically_increasing_id()).drop(*keys), "places")
    part = F.shiftright("__row", 33)
    before, total = [], 0
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        before.append((r.part, total))
        total += r.n
    starts = spark.createDataFrame(before, "__part bigint, __before bigint")  # one row per range
    placed = rows.join(F.broadcast(starts), part == F.col("__part"))
    place = F.col("__before") + F.col("__row").bitwiseAND((1 << 33) - 1) + 1
    return placed.select(*df.columns, place.alias(name))
