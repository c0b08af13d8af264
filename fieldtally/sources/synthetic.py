"""A fake survey table of any size, seeded, with known defects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Categories and known defects of the demo survey.
REGIONS = (
    "Донецька", "Луганська", "Харківська", "Запорізька",
    "Херсонська", "Дніпропетровська", "Сумська", "Миколаївська",
)
MISSPELT, VARIANT = "Харківська", "Харківська обл."
SERVICES = ("health", "mhpss", "cash", "nfi", "protection")
FIRST_DAY, DAYS, FUTURE_DAY = "2026-06-01", 92, "2027-01-15"
BAD_AGES, BAD_AGE, FUTURE_DATES, COPIES = 15, 999, 10, 30

# Own fake names: syllables combined by the row's hash.
GIVEN = ("Олена", "Іван", "Марія", "Петро", "Ганна", "Андрій", "Софія", "Юрій")
FAMILY = ("Коваль", "Бондар", "Ткач", "Мельник", "Гончар", "Лисенко", "Мороз", "Шевчук")


def _draw(seed: int, label: str) -> Column:
    """A non-negative pseudo-random number of the row for one purpose."""
    return F.xxhash64(F.col("__n"), F.lit(seed), F.lit(label)).bitwiseAND(F.lit(2**62 - 1))


def _share(seed: int, label: str) -> Column:
    return (_draw(seed, label) % 1_000_000).cast("double") / 1_000_000


def _pick(seed: int, label: str, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(seed, label) % len(values) + 1).cast("int"))


def _between(seed: int, label: str, low: int, high: int) -> Column:
    return low + _draw(seed, label) % (high - low + 1)


def _chosen(seed: int, rows: int, how_many: int, step: int) -> Column:
    """Marks exactly ``how_many`` of the rows, spread over the table, without a sort.

    Row n takes place ``(n * step + seed) mod p`` for a stride coprime to the row count.
    """
    while _common(step, rows) != 1:
        step += 2
    return (F.col("__n") * step + seed) % rows < how_many


def _common(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return a


def synthetic_survey(
    spark: SparkSession, rows: int = 3000, seed: int = 42, base: DataFrame | None = None
) -> DataFrame:
    """``rows`` + 30 submissions with 19 columns.

    ``base`` may give the row numbers 0 .. rows-1 in a column ``n`` (any table's dense key); else a range
    does. The 30 copies come from the same marked rows, so nothing is sampled at random.
    """
    numbers = spark.range(rows).select(F.col("id").alias("__n")) if base is None else base.select(
        F.col("n").alias("__n")
    )
    # row 0 is always misspelt, so that every size has the defect
    first = F.col("__n") == 0
    region = F.when(first, MISSPELT).otherwise(_pick(seed, "region", REGIONS))
    spelt = F.when((region == MISSPELT) & (first | (_share(seed, "suffix") < 0.05)), VARIANT).otherwise(region)
    sex = F.when(_share(seed, "sex") < 0.58, "female").otherwise("male")
    scored = F.array(*(
        F.struct(_draw(seed, s).alias("score"), F.lit(s).alias("name")) for s in SERVICES
    ))
    taken = F.slice(F.array_sort(scored), F.lit(1), _between(seed, "services", 1, 3).cast("int"))
    services = F.array_join(F.array_sort(F.transform(taken, lambda s: s["name"])), " ")
    person = F.concat_ws(" ", _pick(seed, "given", GIVEN), _pick(seed, "family", FAMILY))
    phone = F.format_string(
        "+380 %d %d %d %d", _between(seed, "p1", 50, 98), _between(seed, "p2", 100, 998),
        _between(seed, "p3", 10, 98), _between(seed, "p4", 10, 98),
    )
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (_draw(seed, "day") % DAYS).cast("int")).cast("string")
    table = numbers.select(
        F.concat(F.lit("u-"), F.sha1(F.concat_ws("/", F.col("__n"), F.lit(seed)))).alias("_uuid"),
        F.when(_chosen(seed, rows, FUTURE_DATES, 7919), FUTURE_DAY).otherwise(day).alias("submission_date"),
        spelt.alias("oblast"),
        F.concat(F.lit("Район-"), _between(seed, "raion", 1, 5)).alias("raion"),
        F.concat(F.lit("Громада-"), _between(seed, "hromada", 1, 24)).alias("hromada"),
        F.when(_share(seed, "place") < 0.6, "urban").otherwise("rural").alias("settlement_type"),
        _between(seed, "size", 1, 8).alias("hh_size"),
        F.when(~_chosen(seed, rows, rows * 3 // 100, 6007), sex).alias("head_sex"),
        F.when(_chosen(seed, rows, BAD_AGES, 104729), F.lit(BAD_AGE).cast("bigint"))
        .otherwise(_between(seed, "age", 18, 89)).alias("head_age"),
        F.when(_share(seed, "disability") < 0.25, "yes").otherwise("no").alias("disability_in_hh"),
        F.when(_share(seed, "status") < 0.45, "idp")
        .when(_share(seed, "status") < 0.85, "host_community").otherwise("returnee")
        .alias("displacement_status"),
        services.alias("services_received"),
        _between(seed, "satisfaction", 1, 5).alias("satisfaction"),
        person.alias("resp_name"),
        phone.alias("resp_phone"),
        F.round(46.0 + 4.5 * _share(seed, "lat"), 6).alias("gps_lat"),
        F.round(29.5 + 9.0 * _share(seed, "lon"), 6).alias("gps_lon"),
        F.concat(F.lit("Інтервʼюер "), _between(seed, "enumerator", 1, 12)).alias("enumerator"),
        F.when(_share(seed, "comment") < 0.3, F.concat(F.lit("Примітка "), _draw(seed, "words") % 1000))
        .alias("comment"),
        _chosen(seed, rows, COPIES, 15485863).alias("__copied"),
    )
    copies = F.when(F.col("__copied"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return table.withColumn("__copy", F.explode(copies)).drop("__copied", "__copy")
