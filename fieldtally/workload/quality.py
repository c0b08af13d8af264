"""Profiles, personal data, cleaning, text functions and ad-hoc answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions.columns import col
from fieldtally.functions.dates import parse_dates
from fieldtally.functions.text import (
    GPS_PAIR, PHONE, cap_bytes, cap_chars, is_personal, redact, redaction_count, strip_control,
)
from fieldtally.operators.cleaning import (
    CleaningPlan, category_normalize, clean_dataset, date_bounds, impossible_to_null, spelling_map,
)
from fieldtally.operators.leaks import leaked_names, leaked_phones, leaked_values, words_of
from fieldtally.operators.pii import pii_detect, pii_sample
from fieldtally.operators.profile import dup_report, null_rates, profile, top_category, union_all
from fieldtally.plans.adhoc import adhoc_sql
from fieldtally.session import scratch_path
from fieldtally.sources.tables import Catalog
from fieldtally.sources.verdicts import keep_verdict
from fieldtally.workload.base import SURVEY, query, survey, table

PROFILED = ("record_id", "household_id", "region", "country", "segment", "amount", "priority")


def _listed(column: str, dtype: str, text: str = "{}") -> str:
    shown = text.format(column)
    return f"""SELECT '{column}' AS "column", '{dtype}' AS dtype, round(avg(({column} IS NULL)::INT), 4) AS null_rate,
  false AS pii, string_agg(DISTINCT {shown}, '|' ORDER BY {shown}) AS values, NULL::DOUBLE AS min, NULL::DOUBLE AS max
  FROM survey"""


def _ranged(column: str, dtype: str) -> str:
    return f"""SELECT '{column}', '{dtype}', round(avg(({column} IS NULL)::INT), 4), false, NULL,
  min({column})::DOUBLE, max({column})::DOUBLE FROM survey"""


@query("profile", SURVEY + ", stated AS (" + " UNION ALL ".join([
    _listed("region", "string"), _listed("country", "string"), _listed("segment", "string"),
    _listed("priority", "string"), _ranged("record_id", "bigint"), _ranged("household_id", "bigint"),
    _ranged("amount", "double"),
    "SELECT 'resp_phone', 'string', 0.0, true, NULL, NULL, NULL",
]) + ") SELECT *, (SELECT count(*) FROM survey) AS n_rows FROM stated")
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = survey(spark, sf_dir).select(*PROFILED).withColumn(
        "resp_phone", F.concat(F.lit("+380"), F.lpad(F.col("household_id").cast("string"), 9, "0"))
    )
    return profile(rows, pii=["resp_phone"]).select(
        "column", "dtype", "n_rows", "null_rate", "pii", F.array_join("values", "|").alias("values"), "min", "max"
    )


@query("profile_dates", """
SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day,
  round(avg((o_orderdate IS NULL)::INT), 4) AS null_rate FROM orders""")
def _profile_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profile(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), pii=[]).where("earliest IS NOT NULL")
    return found.select("column", F.left("earliest", F.lit(10)).alias("first_day"), F.left("latest", F.lit(10)).alias("last_day"), "null_rate")


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with contact cells of known content: mostly phones, some GPS pairs, rarely either."""
    key = F.col("c_custkey")
    nine = F.lpad(key.cast("string"), 9, "0")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_mktsegment",
        F.when(key % 3 != 0, F.concat(F.lit("0"), nine)).otherwise("none").alias("contact"),
        F.when(key % 2 == 0, F.concat(F.lit("48."), F.substring(nine, 5, 5), F.lit(", 35."), F.substring(nine, 4, 6)))
        .alias("place"),
        F.when(key % 7 == 0, F.concat(F.lit("+380"), nine)).otherwise("not given").alias("remark"),
    )


@query("pii_detect", """
SELECT unnest(['c_custkey', 'c_name', 'c_mktsegment', 'contact', 'place', 'remark']) AS "column",
       unnest([false, true, false, true, true, false]) AS pii,
       (SELECT count(*) FROM customer) AS n_rows""")
def _pii_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    contacts = _contacts(spark, sf_dir)
    found = pii_detect(contacts, [col("c_custkey")])
    flags = [F.struct(F.lit(c).alias("column"), F.lit(c in found).alias("pii")) for c in contacts.columns]
    return contacts.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(F.array(*flags)), "n_rows")


@query("pii_kept", """
SELECT unnest(['c_custkey', 'c_name', 'c_mktsegment', 'contact', 'place', 'remark']) AS "column",
       unnest([false, true, false, true, true, false]) AS pii,
       (SELECT count(*) FROM customer) AS n_rows""")
def _pii_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same contacts, stored in their order; the answer is the one kept beside the table."""
    root = scratch_path(spark, "contacts")
    _contacts(spark, sf_dir).sort("c_custkey").write.parquet(f"{root}/contacts")
    keep_verdict(spark, f"{root}/contacts")
    contacts = Catalog.of_folder(spark, root, "contacts")
    kept = spark.read.parquet(f"{root}/contacts.personal").select(F.col("name").alias("column"), F.col("personal").alias("pii"))
    n_rows = F.count(F.lit(1)).alias("n_rows")
    return kept.join(F.broadcast(contacts.stripped("contacts").agg(n_rows)))  # one row


@query("pii_sample", """
WITH contacts AS (
  SELECT c_custkey, c_mktsegment,
    CASE WHEN c_custkey % 2 = 0 THEN '48.' || substr(lpad(c_custkey::VARCHAR, 9, '0'), 5, 5) || ', 35.'
      || substr(lpad(c_custkey::VARCHAR, 9, '0'), 4, 6) END AS place FROM customer
), cells AS (
  SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, c_custkey FROM contacts
  UNION ALL SELECT 'place', place, c_custkey FROM contacts
  UNION ALL SELECT 'c_custkey', c_custkey::VARCHAR, c_custkey FROM contacts
)
SELECT "column", value FROM cells WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY c_custkey) <= 50""")
def _pii_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_sample(_contacts(spark, sf_dir), [col("c_custkey")], ["c_mktsegment", "place", "c_custkey"])


@query("null_rates", SURVEY + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg(({c} IS NULL)::INT), 4) AS null_rate FROM survey"""
    for c in (*PROFILED, "visit_date", "services")
))
def _null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return null_rates(survey(spark, sf_dir, services=True))


@query("dup_report", """
WITH copies AS (
  SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey END AS id FROM orders
  UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 101 = 0
), per AS (SELECT id, count(*) AS n FROM copies GROUP BY id)
SELECT sum(n)::BIGINT AS n_rows, count(id) AS n_ids, coalesce(sum(n - 1) FILTER (id IS NOT NULL), 0)::BIGINT AS n_duplicates,
       count(*) FILTER (id IS NOT NULL AND n > 1) AS n_repeated_ids,
       coalesce(sum(n) FILTER (id IS NULL), 0)::BIGINT AS n_without_id FROM per""")
def _dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    some = orders.select(F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey")).alias("o_orderkey"))
    return dup_report(union_all([some, orders.filter(F.col("o_orderkey") % 101 == 0)]), "o_orderkey")


@query("top_category", SURVEY + """
SELECT country AS category, count(*) AS n FROM survey GROUP BY country ORDER BY n DESC, country LIMIT 1""")
def _top_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_category(survey(spark, sf_dir), "country")


def _misspelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose priority is sometimes spelt in another way."""
    name, key = F.col("o_orderpriority"), F.col("o_orderkey")
    spelt = (
        F.when(key % 20 == 1, F.lower(name))
        .when(key % 20 == 2, F.concat(name, F.lit(" обл.")))
        .when(key % 20 == 3, F.concat(F.lit("  "), name, F.lit("\t")))
        .otherwise(name)
    )
    return table(spark, sf_dir, "orders").select(key, spelt.alias("priority"), "o_totalprice", "o_orderdate")


MISSPELT = """
WITH spelt AS (
  SELECT o_orderkey, o_orderpriority AS clean, o_totalprice, o_orderdate, CASE o_orderkey % 20
    WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN o_orderpriority || ' обл.'
    WHEN 3 THEN '  ' || o_orderpriority || chr(9) ELSE o_orderpriority END AS priority FROM orders)
"""


@query("category_normalize", MISSPELT + """
SELECT priority AS variant, clean AS dominant, count(*) AS affected FROM spelt WHERE priority <> clean GROUP BY 1, 2""")
def _category_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_map(_misspelt(spark, sf_dir), "priority", ["обл."])


@query("category_slips", """
WITH spelt AS (
  SELECT o_orderpriority AS clean, CASE o_orderkey % 100
    WHEN 1 THEN substr(o_orderpriority, 1, 3) || substr(o_orderpriority, 5) WHEN 2 THEN substr(o_orderpriority, 1, 4) || '_' || substr(o_orderpriority, 5)
    WHEN 3 THEN substr(o_orderpriority, 1, 2) || '~' || substr(o_orderpriority, 4)
    WHEN 4 THEN substr(o_orderpriority, 1, 2) || substr(o_orderpriority, 4, 1) || substr(o_orderpriority, 3, 1) || substr(o_orderpriority, 5)
    WHEN 5 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority FROM orders)
SELECT priority AS variant, clean AS dominant, count(*) AS affected FROM spelt WHERE priority <> clean GROUP BY 1, 2""")
def _category_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities with a character left out, added, exchanged or swapped in one row of a hundred each."""
    p = "o_orderpriority"
    wrong = {1: f"concat(substr({p}, 1, 3), substr({p}, 5))", 2: f"concat(substr({p}, 1, 4), '_', substr({p}, 5))",
             3: f"concat(substr({p}, 1, 2), '~', substr({p}, 4))", 5: f"lower({p})",
             4: f"concat(substr({p}, 1, 2), substr({p}, 4, 1), substr({p}, 3, 1), substr({p}, 5))"}
    cases = " ".join(f"WHEN {n} THEN {made}" for n, made in wrong.items())
    rows = table(spark, sf_dir, "orders").selectExpr(f"CASE o_orderkey % 100 {cases} ELSE {p} END AS priority")
    return spelling_map(rows, "priority", slips=True)


@query("join_mapping", MISSPELT + "SELECT o_orderkey, clean AS priority FROM spelt")
def _join_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed, _ = category_normalize(_misspelt(spark, sf_dir), "priority", ["обл."])
    return fixed.select("o_orderkey", "priority")


@query("impossible_to_null", """
SELECT l_returnflag, count(*) AS n_rows,
       count(*) FILTER (l_quantity BETWEEN 5 AND 40) AS n_kept,
       round(sum(l_extendedprice) FILTER (l_extendedprice >= 10000), 2) AS price_kept
FROM lineitem GROUP BY l_returnflag""")
def _impossible_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = {"l_quantity": (5, 40), "l_extendedprice": (10000, None)}
    clean = impossible_to_null(table(spark, sf_dir, "lineitem"), bounds)
    return clean.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("l_quantity").alias("n_kept"),
        F.round(F.sum("l_extendedprice"), 2).alias("price_kept"),
    )


@query("date_bounds", """
SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01'
         THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
       o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate >= TIMESTAMP '2001-01-01' AS flagged FROM orders""")
def _date_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded = date_bounds(table(spark, sf_dir, "orders"), {"o_orderdate": ("1996-01-01", "2000-12-31")})
    return bounded.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderdate_flagged").alias("flagged"),
    )


@query("parse_dates", """
SELECT o_orderkey, CASE o_orderkey % 10 WHEN 9 THEN NULL
    WHEN 1 THEN strftime(o_orderdate + INTERVAL 13 HOUR + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M')
    WHEN 5 THEN strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M')
    WHEN 7 THEN strftime(o_orderdate, '%Y-%m-01 00:00')
    WHEN 8 THEN strftime(CASE WHEN day(o_orderdate) > 12 THEN o_orderdate
      ELSE make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0) END, '%Y-%m-%d %H:%M')
    ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M') END AS moment FROM orders""")
def _parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, form = F.col("o_orderdate"), F.col("o_orderkey") % 10
    patterns = {
        0: "yyyy-MM-dd", 2: "yyyyMMdd", 3: "MM/dd/yyyy", 4: "d MMM yyyy", 6: "MMMM d, yyyy", 7: "yyyy-MM",
        8: "dd.MM.yyyy",
    }
    text = F.lit("not a date")
    for number, pattern in patterns.items():
        text = F.when(form == number, F.date_format(day, pattern)).otherwise(text)
    text = F.when(form == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 13:05"))).otherwise(text)
    text = F.when(form == 5, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T01:00:00+03:00"))).otherwise(text)
    dated = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    moment = parse_dates(F.col("text"), "text")
    return dated.select("o_orderkey", F.date_format(moment, "yyyy-MM-dd HH:mm").alias("moment"))


def _with_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts, most of them with a phone number or a GPS pair written into the end."""
    key = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    form = F.col("doc_id") % 4
    tail = (
        F.when(form == 0, F.concat(F.lit(" tel. 0"), key, F.lit(", +380 67 123 45 67.")))
        .when(form == 1, F.concat(F.lit(" at 48."), key, F.lit(" , 35.12345 or +38 050 123-45-67")))
        .when(form == 2, F.concat(F.lit(" 49.98765\t36."), key, F.lit("!")))
        .otherwise(" no contact 12345")
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("text"))


WITH_CONTACTS = """
WITH docs AS (
  SELECT doc_id, text || CASE doc_id % 4
    WHEN 0 THEN ' tel. 0' || lpad(doc_id::VARCHAR, 9, '0') || ', +380 67 123 45 67.'
    WHEN 1 THEN ' at 48.' || lpad(doc_id::VARCHAR, 9, '0') || ' , 35.12345 or +38 050 123-45-67'
    WHEN 2 THEN ' 49.98765' || chr(9) || '36.' || lpad(doc_id::VARCHAR, 9, '0') || '!'
    ELSE ' no contact 12345' END AS text FROM documents)
"""


@query("redact_text", WITH_CONTACTS + f"""
, phones AS (SELECT doc_id, text, regexp_replace(text, '{PHONE}', '[REDACTED]', 'g') AS t FROM docs)
SELECT doc_id, md5(regexp_replace(t, '{GPS_PAIR}', '[REDACTED]', 'g')) AS text_md5,
       len(regexp_extract_all(text, '{PHONE}')) + len(regexp_extract_all(t, '{GPS_PAIR}')) AS n_redacted
FROM phones""")
def _redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_contacts(spark, sf_dir).select(
        "doc_id", F.md5(redact(F.col("text")).cast("binary")).alias("text_md5"),
        redaction_count(F.col("text")).cast("bigint").alias("n_redacted"),
    )


@query("pii_match", WITH_CONTACTS + f"""
SELECT doc_id, regexp_matches(text, '{PHONE}') OR regexp_matches(text, '{GPS_PAIR}') AS personal FROM docs""")
def _pii_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_contacts(spark, sf_dir).select("doc_id", is_personal(F.col("text")).alias("personal"))


@query("strip_control", r"""
SELECT page_id, md5(html) AS html_md5, length(html) AS n_chars FROM pages""")
def _strip_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("\x00\x07"), F.regexp_replace("html", "<p>", "\x1b<p>"), F.lit("\x0c")).alias("html")
    )
    clean = strip_control(F.col("html"))
    return dirty.select(
        "page_id", F.md5(clean.cast("binary")).alias("html_md5"), F.length(clean).cast("bigint").alias("n_chars")
    )


@query("truncate_text", """
SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '[... document truncated ...]'
         ELSE text END) AS chars_md5,
       md5(substr(text, 1, len([i FOR i IN range(1, least(length(text), 1000) + 1)
         IF strlen(substr(text, 1, i)) <= 1000]))) AS bytes_md5
FROM documents""")
def _truncate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(cap_chars(text, 500).cast("binary")).alias("chars_md5"),
        F.md5(cap_bytes(text, 1000).cast("binary")).alias("bytes_md5"),
    )


def _words(text: str) -> str:
    return rf"[w FOR w IN string_split_regex(lower({text}), '[^\p{{L}}\p{{M}}\p{{N}}_]+') IF w <> '']"


# Benchmark texts, and the first one to three words of some as secrets that are shorter than a run.
SECRETS = f"""
WITH spelt AS (SELECT item_id, {_words('text')} AS words FROM benchmark), secrets AS (
  SELECT words FROM spelt WHERE len(words) > 0 UNION ALL SELECT words[4:4 + item_id % 3] FROM spelt WHERE len(words) > 8
), logs AS (
  SELECT doc_id, ' ' || array_to_string(words, ' ') || ' ' AS text FROM (SELECT doc_id, {_words('text')} AS words FROM documents)
)"""


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    words = words_of(F.col("text"))
    short = F.array_join(F.slice(words, 4, (F.col("item_id") % 3 + 1).cast("int")), " ")
    return items.select("text").union(items.where(F.size(words) > 8).select(short))


@query("leak_audit", SECRETS + """, runs AS (
  SELECT DISTINCT array_to_string(words[i:i + 7], ' ') AS run FROM (
    SELECT words, unnest(range(1, greatest(len(words) - 6, 2))) AS i FROM secrets))
SELECT doc_id AS log_id, count(*) AS n_runs FROM logs JOIN runs ON contains(text, ' ' || run || ' ') GROUP BY doc_id""")
def _leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = leaked_names(
        _secrets(spark, sf_dir), "text", table(spark, sf_dir, "documents"), "doc_id", "text", 8
    )
    return hits.groupBy("log_id").agg(F.count(F.lit(1)).alias("n_runs"))


@query("leak_audit_values", SECRETS + """, keys AS (SELECT DISTINCT array_to_string(words, ' ') AS key FROM secrets)
SELECT doc_id AS log_id, key FROM logs JOIN keys ON contains(text, ' ' || key || ' ')""")
def _leak_audit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_values(_secrets(spark, sf_dir), "text", table(spark, sf_dir, "documents"), "doc_id", "text")


@query("leak_audit_phones", rf"""
WITH known AS (SELECT DISTINCT '0' || lpad((c_custkey * 37)::VARCHAR, 9, '0') AS key FROM customer), logs AS (
  SELECT doc_id, text || ' call 0' || lpad(doc_id::VARCHAR, 9, '0') AS text FROM documents
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '{PHONE.replace("'", "''")}')) AS phone FROM logs
)
SELECT DISTINCT doc_id AS log_id, regexp_replace(phone, '[^0-9]', '', 'g') AS key FROM found
WHERE regexp_replace(phone, '[^0-9]', '', 'g') IN (SELECT key FROM known)""")
def _leak_audit_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phone of a customer in every whole text; a phone is written into each to have some."""
    people = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("tel: 0"), F.lpad((F.col("c_custkey") * 37).cast("string"), 9, "0"), F.lit(" (home)")).alias("phone")
    )
    logs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("text", F.lit(" call 0"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("text")
    )
    return leaked_phones(people, "phone", logs, "doc_id", "text")


@query("adhoc_sql", """
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS balance, '[REDACTED]' AS contact
FROM customer GROUP BY c_mktsegment""")
def _adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Catalog({"customer": table(spark, sf_dir, "customer")})
    return adhoc_sql(spark, catalog, """
        SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS balance, '+380671234567' AS contact
        FROM customer GROUP BY c_mktsegment ORDER BY c_mktsegment""")


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _misspelt(spark, sf_dir).withColumn("place", F.lit(0))
    copies = rows.filter(F.col("o_orderkey") % 101 == 0).withColumn("place", F.lit(1))
    return union_all([rows, copies])


CLEANING = CleaningPlan(
    order=["place"], id_field="o_orderkey", bounds={"o_totalprice": (2000, 450000)},
    dates={"o_orderdate": ("1995-06-01", "2001-06-30")}, categories={"priority": ["обл."]},
    key_fields=["priority"],
)
BAD_DAY = "(o_orderdate < TIMESTAMP '1995-06-01' OR o_orderdate >= TIMESTAMP '2001-07-01')"


@query("clean_dataset", MISSPELT + f"""
SELECT 1 AS step, 'row id kept' AS action, 'o_orderkey' AS "column", NULL AS detail, NULL::BIGINT AS before,
       NULL::BIGINT AS after, NULL::BIGINT AS affected
UNION ALL SELECT 2, 'duplicates dropped', 'o_orderkey', NULL, count(*) + count(*) FILTER (o_orderkey % 101 = 0),
  count(*), count(*) FILTER (o_orderkey % 101 = 0) FROM spelt
UNION ALL SELECT 3, 'impossible values set to missing', 'o_totalprice', NULL, count(*),
  count(*) FILTER (o_totalprice BETWEEN 2000 AND 450000), count(*) FILTER (o_totalprice NOT BETWEEN 2000 AND 450000) FROM spelt
UNION ALL SELECT 4, 'implausible dates set to missing', 'o_orderdate', NULL, count(*),
  count(*) FILTER (NOT {BAD_DAY}), count(*) FILTER ({BAD_DAY}) FROM spelt
UNION ALL SELECT 5, 'spelling replaced', 'priority', priority || ' -> ' || clean, count(*), 0, count(*)
  FROM spelt WHERE priority <> clean GROUP BY priority, clean
UNION ALL SELECT 6, 'missing values', 'priority', NULL, count(*), count(*), 0 FROM spelt""")
def _clean_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_dataset(_dirty(spark, sf_dir), CLEANING).report


@query("clean_dataset_table", MISSPELT + f"""
SELECT o_orderkey, clean AS priority, CASE WHEN o_totalprice BETWEEN 2000 AND 450000 THEN o_totalprice END AS o_totalprice,
       CASE WHEN NOT {BAD_DAY} THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM spelt""")
def _clean_dataset_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_dataset(_dirty(spark, sf_dir), CLEANING).table.select(
        "o_orderkey", "priority", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    )
