"""Leak audit: does any personal value of one table occur in the text of another?

A value is looked for by its rarest pair of neighbouring words. Texts are split once: of the pairs of each log only those that some
value holds are kept, as 64-bit numbers, distinct within the log. How many logs hold a pair says which of a value's pairs is the
rarest; only logs with that one are compared with the value as text. No pair of a value and a log is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.text import PHONE_SEARCH
from fieldtally.session import staged

# Fixed value: what separates words.
WORD = r"[^\p{L}\p{M}\p{N}_]+"

BROADCAST_KEYS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def phone_keys(text: Column) -> Column:
    """Digits of every phone number in a text."""
    found = F.regexp_extract_all(text, F.lit(PHONE_SEARCH), F.lit(0))
    return F.transform(found, lambda phone: F.regexp_replace(phone, r"\D", ""))


def words_of(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(F.lower(text), WORD), lambda word: word != "")


def _runs(words: Column, length: int) -> Column:
    """Every run of ``length`` words."""
    starts = F.sequence(F.lit(1), F.size(words) - (length - 1))
    return F.when(F.size(words) >= length, F.transform(starts, lambda at: F.slice(words, at, length)))


def _neighbours(frame: DataFrame, name: str, words: Column, single: bool) -> DataFrame:
    """``(name, hash)``: the pairs of neighbouring words of each row, repeats included; with ``single`` also its words."""
    # words are hashed in a step of their own: an expression inside a lambda would be computed anew for every word
    hashed = frame.select(name, F.transform(words, lambda word: F.xxhash64(word)).alias("hashes"))
    rest = F.greatest(F.size("hashes") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("hashes", F.lit(1), rest), F.slice("hashes", F.lit(2), rest), lambda a, b: F.xxhash64(a, b))
    return hashed.select(name, F.explode(F.concat(pairs, "hashes") if single else pairs).alias("hash"))


def _known(keys: DataFrame, column: str = "key") -> DataFrame:
    """Distinct keys, broadcast only once their number and size are known to be small."""
    known = staged(keys.distinct(), "leak-keys")
    size = known.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(column).cast("string"))), F.lit(0)).alias("bytes")
    ).first()
    small = size.rows <= BROADCAST_KEYS and size.bytes <= BROADCAST_BYTES
    return F.broadcast(known) if small else known


def leaked_phones(secrets: DataFrame, secret: str, logs: DataFrame, log_id: str, text: str) -> DataFrame:
    """``(log_id, key)`` for each phone of ``secrets`` seen in a log text, however it is spaced."""
    phones = F.explode(F.array_distinct(phone_keys(F.col(text))))
    seen = logs.select(F.col(log_id).alias("log_id"), phones.alias("key"))
    known = _known(secrets.select(F.explode(phone_keys(F.col(secret))).alias("key")))
    return seen.join(known, "key", "left_semi").select("log_id", "key").distinct()


def _found(keys: DataFrame, logs: DataFrame, log_id: str, text: str) -> DataFrame:
    """``(log_id, key)`` of keys ``(key, probe)`` whose words stand together in a log; ``probe`` are words inside the key."""
    keyed = staged(keys.distinct(), "leak-values")
    single = not keyed.where(F.size("probe") == 1).isEmpty()
    held = _neighbours(keyed.where(F.size("probe") > 1), "key", F.col("probe"), False)
    held = held.union(_neighbours(keyed.where(F.size("probe") == 1), "key", F.col("probe"), True)).distinct()
    known = _known(held.select("hash"), "hash")
    named = logs.select(F.col(log_id).alias("log_id"), F.col(text).alias("text"))
    pairs = _neighbours(named, "log_id", words_of(F.col("text")), single)
    seen = staged(pairs.join(known, "hash", "left_semi").distinct(), "leak-pairs")
    common = seen.groupBy("hash").agg(F.count(F.lit(1)).alias("logs"))
    # a pair that no log holds clears its values
    rarest = held.join(common, "hash", "left").groupBy("key").agg(F.min(F.struct(F.coalesce("logs", F.lit(0)), "hash")).alias("least"))
    probes = rarest.where("least.col1 > 0").select("key", F.col("least.hash").alias("hash"))
    hits = staged(seen.join(probes, "hash").select("log_id", "key").distinct(), "leak-hits")
    # only logs with a hit are read as text again
    found = named.join(_known(hits.select("log_id"), "log_id"), "log_id", "left_semi")
    spelt = found.select("log_id", F.concat(F.lit(" "), F.array_join(words_of(F.col("text")), " "), F.lit(" ")).alias("text"))
    compared = hits.join(spelt, "log_id").where(F.contains("text", F.concat(F.lit(" "), F.col("key"), F.lit(" "))))
    return compared.select("log_id", "key").distinct()


def leaked_names(
    secrets: DataFrame, secret: str, logs: DataFrame, log_id: str, text: str, words: int
) -> DataFrame:
    """``(log_id, key)`` for each run of ``words`` words of the secret texts seen in a log text.

    A secret with fewer words is one run of its own length, so none goes unaudited.
    """
    spelt = secrets.select(words_of(F.col(secret)).alias("words")).where(F.size("words") > 0)
    runs = F.coalesce(_runs(F.col("words"), words), F.array("words"))
    keys = spelt.select(F.explode(runs).alias("probe"))
    return _found(keys.select(F.array_join("probe", " ").alias("key"), "probe"), logs, log_id, text)


def leaked_values(
    secrets: DataFrame, secret: str, logs: DataFrame, log_id: str, text: str, words: int = 8
) -> DataFrame:
    """``(log_id, key)`` for each whole secret value seen in a log text; a part of a value is no leak.

    ``words`` is how many words at the start of a value are looked up; the rest is compared afterwards.
    """
    spelt = secrets.select(words_of(F.col(secret)).alias("words")).where(F.size("words") > 0)
    return _found(spelt.select(F.array_join("words", " ").alias("key"), F.slice("words", 1, words).alias("probe")), logs, log_id, text)
