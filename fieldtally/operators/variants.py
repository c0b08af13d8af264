"""Misspelt keys: rare texts one slip away from a common one, found without comparing all pairs.

A slip is one character more, less or other, or two neighbours swapped. Every key is indexed by what it would be with one
character out: keys that agree on the rest *and* on the place differ in that character only, so of such a group only its most
frequent key is needed; a key with one character more meets the shorter one by equality, a swap meets its original by
equality. Links lead from rare to common, so they form trees; every key takes the root of its tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.session import staged

SHORTEST = 5  # characters of a text that may be a slip; shorter ones are often other words
DOMINANCE = 5  # a slip is at least so many times rarer than what it is taken for
# Small Latin letters that look like Cyrillic ones (some only as capitals), in the order of the second line.
LATIN = "abcehikmoptxy"
CYRILLIC = "авсенікмортху"
ROUNDS = 5  # pointers doubled so often reach 2^5 links; a tree of links is log(rows) / log(DOMINANCE) deep, at most


def one_script(key: Column) -> Column:
    """A key with Cyrillic letters without the Latin ones that look like them."""
    return F.when(key.rlike(r"\p{IsCyrillic}"), F.translate(key, LATIN, CYRILLIC)).otherwise(key)


def _links(keys: DataFrame) -> DataFrame:
    """``(key, n, target)``: for every key with a far more frequent neighbour the most frequent one, as (-n, key)."""
    key, n = F.col("key"), F.col("n")
    size = F.length("key")
    places = F.when(size >= SHORTEST, F.sequence(F.lit(1), size))
    out_at = F.explode(places).alias("place")
    shorter = keys.select("key", "n", out_at).withColumn(
        "rest", F.concat(F.expr("substring(key, 1, place - 1)"), F.expr("substring(key, place + 1)"))
    )
    # other character: the group's most frequent key is one slip from all others in it
    hub = shorter.groupBy("rest", "place").agg(F.min(F.struct((-n).alias("m"), key.alias("key"))).alias("target"), F.count("*").alias("held"))
    hub = hub.where("held > 1").select("rest", "place", "target")
    other = shorter.join(hub, ["rest", "place"]).select("key", "n", "target")
    # one character more or less: the shorter key is a key itself
    known = keys.select(F.col("key").alias("rest"), F.struct((-n).alias("m"), key.alias("key")).alias("target"))
    more = shorter.select("key", "n", "rest").distinct().join(known, "rest")
    less = more.select(F.col("target.key").alias("key"), (-F.col("target.m")).alias("n"), F.struct((-n).alias("m"), key.alias("key")).alias("target"))
    swaps = keys.where(size >= SHORTEST).select("key", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("place"))
    swapped = F.expr("concat(substring(key, 1, place - 1), substring(key, place + 1, 1), substring(key, place, 1), substring(key, place + 2))")
    swap = swaps.select("key", "n", swapped.alias("rest")).join(known, "rest").select("key", "n", "target")
    both = other.unionByName(more.select("key", "n", "target")).unionByName(less).unionByName(swap)
    digits = lambda text: F.regexp_replace(text, r"(?U)\D", "")
    likely = (-F.col("target.m") >= n * DOMINANCE) & (digits(key) == digits(F.col("target.key")))  # "Ward 1" is no "Ward 2"
    return both.where(likely).groupBy("key").agg(F.min("target").alias("target")).select("key", F.col("target.key").alias("root"))


def roots(keys: DataFrame) -> DataFrame:
    """``(key, root)`` of every misspelt key of ``(key, n)``: the common key at the end of its links.

    Keys are distinct and not NULL; equal frequencies are settled by the smaller text.
    """
    found = staged(_links(keys), "slips")
    for _ in range(ROUNDS):
        further = found.select(F.col("key").alias("root"), F.col("root").alias("next"))
        jumped = found.join(further, "root", "left").select("key", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = staged(jumped, "slip-roots")
        found = jumped.select("key", "root")
        if jumped.where("moved").isEmpty():
            break
    return found
