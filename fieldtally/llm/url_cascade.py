"""URL filter: path rules first, then a Bloom filter cascade over host keys.

A cascade answers membership exactly for every key of a known universe: level 0 encodes the listed keys; level 1
the unlisted keys that level 0 lets through; level 2 the listed keys that level 1 lets through; and so on, until no
key is wrong. The first level that does not let a key through decides. The universe is every host of the corpus, so
no host is answered wrongly, and pages need no join.

Keys are dealt into shards by hash. A shard's levels are built in one task from its own keys, whose number is
bounded; pages are judged with the shards that a broadcast of ``MAX_BYTES`` holds, in as many passes as that takes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import bounded_batches
from fieldtally.session import staged

# The rules of the contract (host, path, verdict); a host rule also fits the host's subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Words in a host that put it on the list.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")

SHARD_KEYS = 100_000  # keys of a shard, about
BITS_PER_KEY = 10
HASHES = 4
MAX_LEVELS = 64
MAX_BYTES = 32 << 20  # filters that are broadcast at once


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``? #``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), both NULL where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r), reverse=True)[::-1]:
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name = F.when(fits, F.lit(domain + start)).otherwise(name)  # longer rules come later and go first
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def listed_host(host: Column, words=LISTED_WORDS) -> Column:
    """Whether a label of the host has one of the words between hyphens."""
    return host.rlike(f"(^|[.-])({'|'.join(words)})([.-]|$)")


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    """A new 64-bit hash of hashed keys for each salt."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _places(keys: np.ndarray, level: int, size: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield (_mix(keys, 1 + level * HASHES + k) % np.uint64(size)).astype(np.int64)


def _encode(keys: np.ndarray, level: int) -> np.ndarray:
    bits = np.zeros(-(-max(len(keys), 1) * BITS_PER_KEY // 8) * 8, np.uint8)
    for at in _places(keys, level, len(bits)):
        bits[at] = 1
    return np.packbits(bits)


def _passes(keys: np.ndarray, level: int, packed: np.ndarray) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for at in _places(keys, level, 8 * len(packed)):
        found &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return found


def build_levels(listed: np.ndarray, unlisted: np.ndarray) -> list[np.ndarray]:
    """The levels of one shard; ``listed`` and ``unlisted`` are its whole universe, as 64-bit hashes."""
    levels: list[np.ndarray] = []
    inside, outside = np.unique(listed), np.setdiff1d(unlisted, listed)
    while len(inside):
        if len(levels) == MAX_LEVELS:
            raise ValueError("the cascade does not end")
        packed = _encode(inside, len(levels))
        wrong = outside[_passes(outside, len(levels), packed)]
        levels.append(packed)
        inside, outside = wrong, inside
    return levels


def contains(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Membership of keys of the universe: whether the first level that stops a key is an odd one."""
    answer, open_ = np.full(len(keys), len(levels) % 2 == 1), np.arange(len(keys))
    for n, packed in enumerate(levels):
        passed = _passes(keys[open_], n, packed)
        answer[open_[~passed]] = n % 2 == 1
        open_ = open_[passed]
    return answer


def build(universe: DataFrame) -> DataFrame:
    """(shard, level, bits) from (key_hash long, listed boolean); a key that is listed in any row is listed."""
    spark = universe.sparkSession
    keys = staged(universe.groupBy("key_hash").agg(F.max("listed").alias("listed")), "url-keys")
    shards = max(-(-keys.count() // SHARD_KEYS), 1)

    def levels(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, listed = rows["key_hash"].to_numpy(np.int64).view(np.uint64), rows["listed"].to_numpy(bool)
        made = build_levels(hashes[listed], hashes[~listed])
        return pd.DataFrame({
            "shard": [rows["shard"].iloc[0]] * len(made), "level": range(len(made)),
            "bits": [m.tobytes() for m in made],
        })

    filters = (
        keys.withColumn("shard", F.pmod("key_hash", F.lit(shards)).cast("int"))
        .groupBy("shard").applyInPandas(levels, "shard int, level int, bits binary")
    )
    return staged(filters, "url-cascade").withColumn("shards", F.lit(shards))


def judged(pages: DataFrame, filters: DataFrame, key_hash: str) -> DataFrame:
    """``pages`` with the column ``_listed``: whether the hashed key (NULL: no) is in the cascade.

    Filters over ``MAX_BYTES`` are asked in passes, each written before the next is read, so the driver holds one at a time.
    """
    sizes = filters.groupBy("shard").agg(F.sum(F.length("bits")).alias("bytes"), F.max("shards").alias("n")).collect()
    if not sizes:  # nothing is listed
        return pages.withColumn("_listed", F.lit(False))
    shards, passes, size = sizes[0]["n"], [[]], 0
    for r in sorted(sizes):
        if size + r["bytes"] > MAX_BYTES and passes[-1]:
            passes.append([])
            size = 0
        passes[-1].append(r["shard"])
        size += r["bytes"]
    found, last = None, len(passes) - 1
    for n, part in enumerate(passes):
        # the passes cut the shards' range into pieces; shards that list nothing have no filter and fall to a piece
        low, high = (part[0] if n else 0), (passes[n + 1][0] if n < last else shards)
        shard = F.pmod(F.coalesce(F.col(key_hash), F.lit(0)), F.lit(shards))
        mine = pages.where((shard >= low) & (shard < high)) if last else pages
        held = _loaded(filters.where(F.col("shard").isin(part)))
        here = mine.withColumn("_listed", _membership(held, shards)(F.col(key_hash)))
        if last:
            here = staged(here, "url-pass")
        found = here if found is None else found.unionByName(here)
    return found


def _loaded(filters: DataFrame) -> dict[int, list[np.ndarray]]:
    held: dict[int, list[np.ndarray]] = {}
    for r in filters.orderBy("shard", "level").collect():  # at most MAX_BYTES
        held.setdefault(r["shard"], []).append(np.frombuffer(bytes(r["bits"]), np.uint8))
    return held


def _membership(held: dict[int, list[np.ndarray]], shards: int):
    @F.pandas_udf("boolean")
    def listed(key: pd.Series) -> pd.Series:
        known = key.notna().to_numpy()
        hashes = pa.array(key, pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        answer = np.zeros(len(hashes), bool)
        shard = np.mod(hashes, shards)
        for s in np.unique(shard):
            if int(s) in held:
                at = np.nonzero((shard == s) & known)[0]
                answer[at] = contains(hashes[at].view(np.uint64), held[int(s)])
        return pd.Series(answer)

    return listed


def judge_pages(pages: DataFrame, words=LISTED_WORDS, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A NULL url, or one without ``://``, has an empty host and path, no rule and is allowed unless the empty host is listed
    (it is not); repeated rows are judged as often as they stand; an empty table gives no rows. Only the url is read.
    """
    bounded_batches(pages.sparkSession)
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    key = F.xxhash64("host")
    universe = parsed.select("host").distinct().select(
        key.alias("key_hash"), listed_host(F.col("host"), words).alias("listed")
    )
    marked = judged(parsed.withColumn("_key", key), build(universe), "_key")
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


SQL_WORDS = "|".join(LISTED_WORDS)
ORACLE = f"""
WITH parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(domain, start, says) AS (
  VALUES {', '.join(str(r) for r in RULES)}
), fitting AS (
  SELECT p.host, p.path, domain || start AS rule, says,
         row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(domain || start) DESC) AS k
  FROM (SELECT DISTINCT host, path FROM parsed) p JOIN rules
    ON (p.host = domain OR ends_with(p.host, '.' || domain)) AND starts_with(p.path, start)
)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN regexp_matches(host, '(^|[.-])({SQL_WORDS})([.-]|$)') THEN 'block' ELSE 'allow' END)
         AS verdict
FROM parsed LEFT JOIN fitting USING (host, path) WHERE k = 1 OR k IS NULL
"""
