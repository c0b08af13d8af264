"""Benchmark decontamination by templates, in DataFrame expressions only.

A text becomes a template: numbers, names and units turn into typed placeholders, the rest is lower case without
punctuation. Windows of the benchmark are joined with the windows of all documents by hash and then compared word by word: the
template's windows where slots may change, and every window's plain words, whatever was taken for a name in either text. A
question whose numbers or names were exchanged still has the same template; whether the match is one question with other values
is seen from its slots: along one alignment every benchmark value must have become one and the same document value. Windows that
hold a value that breaks this do not count. Short items and windows that are mostly slots could be anything once their values
change, so they count only word for word.

A text is marked once and its words are hashed once; windows of all sizes are hashes of these numbers, exploded together. Texts
are looked at again for rows that have a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.llm.common import by_keys
from fieldtally.session import staged

WINDOW = 8  # words of a window; a shorter item is one window of its own length
LITERAL = 5  # words of a window that are no placeholder, at least, for slots to change; other windows are looked for word for word
SHARE = 0.25  # part of an item's windows that a leak shows, at least
RARE = 1000  # an item of fewer than LITERAL words is evidence where at most one document in so many holds it (or a single one)
MAX_BROADCAST = 1_000_000  # benchmark windows (a hash and two numbers each) that are broadcast, at most

MARK = "\ue000"  # stands before the kind of a slot and its value; taken out of the texts first
BLANK = "[\\x09-\\x0D\\x20]"
UNITS = "kg|g|mg|km|m|cm|mm|mi|miles|meters|metres|feet|ft|inches|hours|hour|minutes|seconds|days|weeks|years|" \
    "dollars|euros|cents|percent|liters|litres|ml|degrees|mph|kmh"
STEPS = (  # (pattern, replacement) in the syntax that Java and RE2 share
    (f"{BLANK}+", " "),
    ("(^| )([$€£]?[0-9])", f"\\1{MARK}n\\2"),
    ("([\\p{Ll},;] )(\\p{Lu})", f"\\1{MARK}p\\2"),
    (f"({MARK}n[^ ]* )({UNITS})([^\\p{{L}}]|$)", f"\\1{MARK}u\\2\\3"),
)
DROPPED = f"[^\\p{{L}}\\p{{N}}{MARK} ]+"


def marked_words(text: Column) -> Column:
    """Words of a text in lower case; a slot's word starts with MARK and its kind (n, p, u)."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK, "")
    for pattern, replacement in STEPS:
        out = F.regexp_replace(out, pattern, replacement.replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3"))
    out = F.regexp_replace(F.lower(out), DROPPED, "")
    return F.split(F.trim(out), " +")


def template(words: Column) -> Column:
    """The words with every slot's value taken off."""
    return F.transform(words, lambda w: F.when(w.startswith(MARK), F.substring(w, 1, 2)).otherwise(w))


def plain(words: Column) -> Column:
    """The words without marks: a capital at the beginning of an item may be a name in the middle of a text."""
    return F.transform(words, lambda w: F.when(w.startswith(MARK), F.substring(w, 3, 1 << 30)).otherwise(w))


def _literal(words: Column) -> Column:
    """How many words are no slot."""
    return F.size(F.filter(words, lambda w: ~w.startswith(MARK)))


def _starts(n: Column, size: int) -> Column:
    """How many windows of ``size`` are in ``n`` words."""
    return F.greatest(n - (size - 1), F.lit(0))


def _windows(hashes: Column, n: Column, size: int, kind: int) -> Column:
    """Hash of every run of ``size`` words, in order; the size and the kind of window are part of it."""
    starts = F.when(n >= size, F.sequence(F.lit(1), n - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.xxhash64(F.lit(10 * size + kind), F.slice(hashes, at, size)))


TEMPLATE, PLAIN = 0, 1


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL) -> DataFrame:
    """One row per window: item_id, at (from 0), size, telling, windows (telling ones of the item), all_windows, hash, marked words.

    In telling windows slots may change; an item without a word has no window.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), marked_words(F.col("text")).alias("words"))
    items = items.distinct().where(F.col("item_id").isNotNull() & (F.array_join("words", "") != "")).withColumn(
        "size", F.least(F.lit(window), F.size("words"))
    )
    starts = F.sequence(F.lit(0), F.size("words") - F.col("size"))
    rows = items.withColumn("at", F.explode(starts))
    rows = rows.withColumn("item_words", F.slice("words", F.col("at") + 1, F.col("size")))
    rows = rows.withColumn("telling", _literal(F.col("item_words")) >= literal)
    item = Window.partitionBy("item_id", "words")
    counted = rows.withColumn("windows", F.count_if("telling").over(item)).withColumn("all_windows", F.count("*").over(item))
    return counted.drop("words")


def _known(parts: DataFrame) -> DataFrame:
    """Per window its plain hash and, if it is telling, its template's: hash, kind, size, item_id, at."""
    hashed = [
        parts.where(which).select(
            F.xxhash64(F.lit(10) * F.col("size") + kind, F.transform(words, lambda w: F.xxhash64(w))).alias("hash"),
            F.lit(kind).alias("kind"), "size", "item_id", "at",
        )
        for which, kind, words in (("telling", TEMPLATE, template(F.col("item_words"))), ("true", PLAIN, plain(F.col("item_words"))))
    ]
    return hashed[0].unionByName(hashed[1])


def _row_key() -> Column:
    """Names a row by its content, in 128 bits: rows with the same id and other texts are judged on their own."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(8), text, doc_id).alias("b"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL, share: float = SHARE
) -> DataFrame:
    """Per document and leaked item: row_key, doc_id, item_id, n_windows, item_windows, n_slots, n_changed, evident.

    ``n_windows`` counts the item's telling windows found along one alignment without those that hold a slot value with
    two values in the document, ``n_slots`` the distinct slot values met there and ``n_changed`` those that the document
    gives another value. Where these are less than the share, all windows that match word for word are counted against
    all of the item's, so a short item leaks if it stands there unchanged. ``evident`` is false for an item of fewer than
    ``literal`` words that more than one document and more than one in ``RARE`` hold: "yes" is no leak. NULL and empty texts leak
    nothing, a row without doc_id is reported with doc_id NULL, repeated rows once; without documents or items nothing leaks.
    """
    parts = staged(benchmark_windows(benchmark, window, literal), "benchmark-windows")
    counted = parts.count()
    sizes = sorted(r[0] for r in parts.select("size").distinct().collect())  # at most ``window`` values
    keyed = docs.select(
        _row_key().alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"),
        marked_words(F.col("text")).alias("words"),
    )
    known = _known(parts)
    known = F.broadcast(known) if counted <= MAX_BROADCAST else known
    hashed = keyed.select(
        "row_key", "doc_id", F.size("words").alias("n"),
        F.transform("words", lambda w: F.xxhash64(F.when(w.startswith(MARK), F.substring(w, 1, 2)).otherwise(w))).alias("hash_0"),
        F.transform("words", lambda w: F.xxhash64(F.when(w.startswith(MARK), F.substring(w, 3, 1 << 30)).otherwise(w))).alias("hash_1"),
    )
    every = [(size, kind) for size in sizes for kind in (TEMPLATE, PLAIN)]
    runs = [_windows(F.col(f"hash_{kind}"), F.col("n"), size, kind) for size, kind in every]
    runs = F.concat(*runs) if runs else F.array().cast("array<bigint>")
    exploded = hashed.select("row_key", "doc_id", "n", F.posexplode(runs).alias("place", "hash"))
    before, skipped = F.lit(0), F.lit(None).cast("int")  # the windows of one size and kind stand behind those before it
    for size, kind in every:
        skipped = F.when((F.col("size") == size) & (F.col("kind") == kind), before).otherwise(skipped)
        before = before + _starts(F.col("n"), size)
    found = exploded.join(known, "hash").withColumn("pos", F.col("place") - skipped)
    hits = staged(found.select("row_key", "doc_id", "pos", "size", "item_id", "at").distinct(), "benchmark-hits")
    again = by_keys(keyed.select("row_key", "words"), hits.select("row_key").distinct(), "row_key", "left_semi")
    compared = (
        hits.join(again.dropDuplicates(["row_key"]), "row_key")
        .withColumn("doc_words", F.slice("words", F.col("pos") + 1, F.col("size"))).drop("words")
        .join(
            parts.select("item_id", "at", "size", "telling", "windows", "all_windows", "item_words"), ["item_id", "at", "size"]
        )
        .withColumn("exact", plain(F.col("doc_words")) == plain(F.col("item_words")))
        .withColumn("same", F.col("telling") & (template(F.col("doc_words")) == template(F.col("item_words"))))
        .where("exact OR same").withColumn("shift", F.col("pos") - F.col("at"))
    )
    both = F.arrays_zip(F.col("item_words").alias("marked"), plain(F.col("item_words")).alias("item"), plain(F.col("doc_words")).alias("doc"))
    slots = F.transform(
        F.filter(both, lambda p: p["marked"].startswith(MARK)), lambda p: F.struct(p["item"].alias("item"), p["doc"].alias("doc"))
    )
    compared = staged(compared.withColumn("slots", slots).drop("doc_words", "item_words"), "benchmark-compared")
    one = ["row_key", "item_id", "shift"]
    values = compared.where("same").select(*one, F.explode("slots").alias("s")).select(*one, "s.*")
    values = values.groupBy(*one, "item").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    broken = values.where(F.col("least") != F.col("most")).groupBy(*one).agg(F.collect_list("item").alias("broken"))
    held = F.transform("slots", lambda p: p["item"])
    judged = compared.join(broken, one, "left").withColumn(
        "sound", F.col("same") & ~F.coalesce(F.arrays_overlap(held, "broken"), F.lit(False))
    )

    def met(which: str) -> Column:
        """The distinct pairs of values in the slots of some windows: at most the item's slots."""
        return F.array_distinct(F.flatten(F.collect_set(F.when(F.col(which), F.col("slots")))))

    aligned = judged.groupBy(*one, "doc_id", "windows", "all_windows", "size").agg(
        F.count_if("sound").alias("sound_here"), F.count_if("exact").alias("exact_here"),
        met("sound").alias("sound_slots"), met("exact").alias("exact_slots"),
    )
    changed = F.size(F.filter("sound_slots", lambda p: p["item"] != p["doc"]))

    def tally(n: str, of: str, slots: str, changed: Column) -> Column:
        return F.when((F.col(n) > 0) & (F.col(n) >= F.col(of) * share), F.struct(
            F.col(n).alias("n_windows"), (-changed).cast("long").alias("kept"), F.size(slots).cast("long").alias("n_slots"),
            F.col(of).cast("long").alias("item_windows"),
        ))

    # of several alignments of one item the longest tells
    best = aligned.groupBy("row_key", "doc_id", "item_id", "windows", "all_windows", "size").agg(
        F.max(tally("sound_here", "windows", "sound_slots", changed)).alias("s"),
        F.max(tally("exact_here", "all_windows", "exact_slots", F.lit(0))).alias("e"),
    ).withColumn("b", F.coalesce("s", "e")).where(F.col("b").isNotNull())
    best = staged(best.select(
        "row_key", "doc_id", "item_id", "size", "b.n_windows", "b.item_windows", "b.n_slots", (-F.col("b.kept")).alias("n_changed")
    ), "benchmark-found")
    few = max(docs.count() // RARE, 1)
    common = best.where(F.col("size") < literal).groupBy(F.col("item_id").alias("_item")).agg(F.count_distinct("row_key").alias("_held"))
    common = common.where(F.col("_held") > few).select("_item").withColumn("_common", F.lit(True))
    evident = (F.col("size") >= literal) | F.col("_common").isNull()
    return best.join(common, F.col("item_id") == F.col("_item"), "left").select(
        "row_key", "doc_id", "item_id", "n_windows", "item_windows", "n_slots", "n_changed", evident.alias("evident")
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no item evidently, all columns unchanged.

    NULL and empty texts stay, repeated rows go or stay together, and an empty table or benchmark takes nothing out.
    """
    bad = staged(leaks(docs, benchmark).where("evident").select("row_key").distinct(), "benchmark-leaks")
    return by_keys(docs, bad, _row_key(), "left_anti")


def _sql_words(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{MARK}', '')"
    for pattern, replacement in STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"string_split_regex(trim(regexp_replace(lower({out}), '{DROPPED}', '', 'g')), ' +')"


def _sql_each(words: str, then: str) -> str:
    return f"list_transform({words}, lambda w: CASE WHEN starts_with(w, '{MARK}') THEN {then} ELSE w END)"


def _sql_template(words: str) -> str:
    return _sql_each(words, "substr(w, 1, 2)")


def _sql_plain(words: str) -> str:
    return _sql_each(words, "substr(w, 3)")


ORACLE = f"""
WITH sized AS (
  SELECT *, least({WINDOW}, len(words)) AS size FROM (
    SELECT DISTINCT item_id, {_sql_words('text')} AS words FROM benchmark WHERE item_id IS NOT NULL)
  WHERE array_to_string(words, '') <> ''
), cut AS (
  SELECT item_id, words, place, size, words[place + 1:place + size] AS item_words
  FROM (SELECT *, unnest(range(0, len(words) - size + 1)) AS place FROM sized)
), parts AS (
  SELECT *, {_sql_template('item_words')} AS kind, {_sql_plain('item_words')} AS spelt,
    len(list_filter(item_words, lambda w: NOT starts_with(w, '{MARK}'))) >= {LITERAL} AS telling
  FROM cut
), good AS (
  SELECT * EXCLUDE (words), count(*) FILTER (telling) OVER (PARTITION BY item_id, words) AS windows,
    count(*) OVER (PARTITION BY item_id, words) AS all_windows
  FROM parts
), keyed AS (
  SELECT row_number() OVER () AS k, doc_id, words FROM (SELECT DISTINCT doc_id, text, {_sql_words('text')} AS words FROM documents)
), spread AS (
  SELECT k, doc_id, size, pos, {_sql_template('doc_words')} AS kind, {_sql_plain('doc_words')} AS spelt
  FROM (SELECT k, doc_id, size, pos, words[pos + 1:pos + size] AS doc_words FROM (
    SELECT *, unnest(range(0, len(words) - size + 1)) AS pos FROM keyed, (SELECT DISTINCT size FROM good) WHERE len(words) >= size))
), met AS (
  SELECT k, doc_id, pos, g.*, g.spelt = s.spelt AS exact, g.telling AND g.kind = s.kind AS same, s.spelt AS here
  FROM spread s JOIN good g ON s.size = g.size AND s.spelt = g.spelt
  UNION
  SELECT k, doc_id, pos, g.*, g.spelt = s.spelt, true, s.spelt FROM spread s JOIN good g ON s.size = g.size AND s.kind = g.kind AND g.telling
), hits AS (
  SELECT k, doc_id, item_id, size, windows, all_windows, pos - place AS shift, exact, same,
    list_transform(list_filter(list_zip(item_words, spelt, here), lambda p: starts_with(p[1], '{MARK}')), lambda p: [p[2], p[3]]) AS slots
  FROM met
), broken AS (
  SELECT k, item_id, shift, list(word) AS words FROM (
    SELECT k, item_id, shift, s[1] AS word FROM (SELECT k, item_id, shift, unnest(slots) AS s FROM hits WHERE same)
    GROUP BY ALL HAVING min(s[2]) <> max(s[2])) GROUP BY k, item_id, shift
), judged AS (
  SELECT h.*, same AND NOT coalesce(list_has_any(list_transform(slots, lambda p: p[1]), b.words), false) AS sound
  FROM hits h LEFT JOIN broken b USING (k, item_id, shift)
), aligned AS (
  SELECT k, doc_id, item_id, size, windows, all_windows, shift, count(*) FILTER (sound) AS n_sound, count(*) FILTER (exact) AS n_exact,
    list_distinct(coalesce(flatten(list(slots) FILTER (sound)), [])) AS sound_slots,
    list_distinct(coalesce(flatten(list(slots) FILTER (exact)), [])) AS exact_slots
  FROM judged GROUP BY k, doc_id, item_id, size, windows, all_windows, shift
), tallied AS (
  SELECT k, doc_id, item_id, size,
    max(CASE WHEN n_sound > 0 AND n_sound >= windows * {SHARE} THEN
      {{'n': n_sound, 'kept': -len(list_filter(sound_slots, lambda p: p[1] <> p[2])), 'slots': len(sound_slots), 'of': windows}} END) AS s,
    max(CASE WHEN n_exact > 0 AND n_exact >= all_windows * {SHARE} THEN
      {{'n': n_exact, 'kept': 0::BIGINT, 'slots': len(exact_slots), 'of': all_windows}} END) AS e
  FROM aligned GROUP BY k, doc_id, item_id, size, windows, all_windows
), best AS (SELECT *, coalesce(s, e) AS b FROM tallied WHERE s IS NOT NULL OR e IS NOT NULL)
SELECT doc_id, item_id, b.n AS n_windows, b.of AS item_windows, b.slots AS n_slots, -b.kept AS n_changed,
  size >= {LITERAL} OR (SELECT count(DISTINCT o.k) FROM best o WHERE o.item_id = best.item_id AND o.size < {LITERAL})
    <= greatest((SELECT count(*) FROM documents) // {RARE}, 1) AS evident
FROM best
"""
