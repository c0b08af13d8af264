import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from fieldtally.errors import ReportError
from fieldtally.functions.categories import MISSING, category_key, ordered_labels, spelling_key
from fieldtally.functions.numbers import progress_pct, shown_number
from fieldtally.functions.text import cap_bytes, cap_chars, is_personal, redact, redaction_count, strip_control
from fieldtally.operators.cleaning import CleaningPlan, category_normalize, clean_dataset, date_bounds
from fieldtally.operators.leaks import leaked_names, leaked_phones, leaked_values
from fieldtally.operators.period import Period
from fieldtally.operators.pii import _in_file_order, drop_pii, pii_detect, pii_sample
from fieldtally.operators.profile import compare_measure, dup_report, null_rates, profile, top_category
from fieldtally.operators.places import with_place
from fieldtally.operators.rowids import CHUNK, ROW_ID, derived_ids, ensure_row_ids, keep_first, unique_id
from fieldtally.operators import profile as profiles
from fieldtally.operators import rowids
from fieldtally.session import staged
from fieldtally.operators.variants import DOMINANCE, SHORTEST, roots
from fieldtally.plans.adhoc import adhoc_sql, ask
from fieldtally.sources.sinks import sink_pull
from fieldtally.sources.tables import Catalog
from fieldtally.sources.verdicts import keep_verdict, kept_verdict


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string")


@pytest.mark.parametrize(
    ("text", "clean", "n"),
    [
        ("call +380671234567 or 0509876543", "call [REDACTED] or [REDACTED]", 2),
        ("+380 67 123 45 67; +38 050 123-45-67", "[REDACTED]; [REDACTED]", 2),
        ("point at 48.53421, 35.12345 ok", "point at [REDACTED] ok", 1),
        ("48.123456  35.654321", "[REDACTED]", 1),
        ("oblast  count\nДонецька  512\nСумська  380", "oblast  count\nДонецька  512\nСумська  380", 0),
        ("id 10509876543, total 3805", "id 10509876543, total 3805", 0),
        ("тел.٠ 0٥0987٦543", "тел.٠ [REDACTED]", 1),
    ],
)
def test_redaction(spark, text, clean, n):
    row = texts(spark, text).select(redact(F.col("t")), redaction_count(F.col("t")), is_personal(F.col("t"))).first()
    assert tuple(row) == (clean, n, n > 0)


def test_caps(spark):
    row = texts(spark, "їжак" * 5).select(
        cap_chars(F.col("t"), 3), cap_bytes(F.col("t"), 5), cap_bytes(F.col("t"), 100), cap_bytes(F.col("t"), 1)
    ).first()
    assert tuple(row) == ("їжа\n[... document truncated ...]", "їж", "їжак" * 5, "")
    assert texts(spark, "a\x00b\x1fc\nd\te").select(strip_control(F.col("t"))).first()[0] == "abc\nd\te"


def test_category_helpers(spark):
    assert ordered_labels(["b", MISSING, "a"]) == ["a", "b", MISSING]
    df = texts(spark, "b", None, "a")
    assert sorted(r[0] for r in df.select(category_key(F.col("t"))).collect()) == [MISSING, "a", "b"]
    variants = texts(spark, "Харківська", " харківська  ОБЛ. ", "ХАРКІВСЬКА\tобл.")
    assert variants.select(spelling_key(F.col("t"), ["обл."])).distinct().count() == 1


def test_progress(spark):
    row = spark.range(1).select(
        progress_pct(F.lit(3000.0), F.lit(2500)), progress_pct(F.lit(1.0), F.lit(0)),
        progress_pct(F.lit(1.0), F.lit(None).cast("double")),
    ).first()
    assert tuple(row) == (120.0, None, None)


def test_pii_by_name_and_value(spark, demo):
    found = set(pii_detect(demo))
    assert {"resp_name", "resp_phone", "gps_lat", "gps_lon", "enumerator", "comment"} == found
    contact = spark.createDataFrame([("+380671234567",), ("+380509876543",), ("0671112233",)], "contact string")
    assert pii_detect(contact) == ["contact"]
    assert drop_pii(contact, ["contact"]).columns == []


def test_pii_sample_is_the_first_fifty_present_values(spark):
    # hits only after the first fifty present values do not count; a mostly empty column is looked through
    df = spark.range(1000).selectExpr(
        "id", "if(id < 60, 'none', '+380671234567') AS tardy", "if(id >= 900, '0671112233', null) AS sparse",
        "if(id % 4 = 0, '0671112233', 'x') AS some", "380671234567 AS whole", "380671234567D AS real",
    )
    assert pii_detect(df, [F.col("id")]) == ["sparse", "whole", "real"]
    sample = pii_sample(df, [F.col("id")], ["tardy", "sparse"])
    got = {r.column: r.n for r in sample.groupBy("column").agg(F.count("value").alias("n")).collect()}
    assert got == {"tardy": 50, "sparse": 50}
    assert sample.filter("column = 'tardy' AND value != 'none'").count() == 0


def test_profile(spark, demo):
    cols = {r.column: r for r in profile(demo, pii_detect(demo)).collect()}
    assert list(cols) == demo.columns
    assert "Донецька" in cols["oblast"]["values"] and cols["oblast"]["values"] == sorted(cols["oblast"]["values"])
    assert cols["head_sex"].null_rate > 0.02 and (cols["head_age"].min, cols["head_age"].max) == (18.0, 999.0)
    assert cols["_uuid"]["values"] is None and cols["_uuid"]["min"] is None
    for row in cols.values():
        if row.pii:
            assert (row["values"], row["min"], row["max"], row["n_values"]) == (None, None, None, None)
    assert "+380" not in json.dumps([r.asDict() for r in cols.values()], ensure_ascii=False)


def test_profile_limit_is_exact(spark):
    df = spark.range(3000).selectExpr("id % 30 AS thirty", "id % 31 AS more", "cast(null AS double) AS nothing")
    cols = {r.column: r for r in profile(df, []).collect()}
    assert len(cols["thirty"]["values"]) == 30 and cols["thirty"]["max"] is None
    assert cols["more"]["values"] is None and cols["more"]["max"] == 30.0
    assert cols["nothing"]["values"] == [] and cols["nothing"]["null_rate"] == 1.0
    assert {r.column: r.null_rate for r in null_rates(df).collect()}["nothing"] == 1.0


def test_duplicates_and_top(spark, demo):
    row = dup_report(demo, "_uuid").first()
    assert (row.n_rows, row.n_ids, row.n_duplicates, row.n_repeated_ids, row.n_without_id) == (3030, 3000, 30, 30, 0)
    assert tuple(top_category(texts(spark, "b", "a", "b", "a", None), "t").first()) == ("a", 2)


def test_demo_known_defects(demo):
    ids = demo.dropDuplicates(["_uuid"])
    assert demo.count() == 3030 and ids.count() == 3000 and len(demo.columns) == 19
    assert ids.filter("head_age = 999").count() == 15
    assert ids.filter("submission_date > '2026-12-31'").count() == 10
    assert ids.filter("head_sex IS NULL").count() == 90
    assert "Харківська обл." in {r.oblast for r in demo.select("oblast").distinct().collect()}


def ids_of(df):
    return sorted(r[ROW_ID] for r in df.select(ROW_ID).collect())


def test_row_ids(spark):
    usable = spark.createDataFrame([("a", 1), ("b", 2)], "`_uuid` string, v int")
    assert ensure_row_ids(usable) is usable and unique_id(usable) == "_uuid"
    for rows in ([("a", 1), ("a", 1), ("b", 2)], [("a", 1), (None, 2)]):
        given = ensure_row_ids(spark.createDataFrame(rows, "`_uuid` string, v int"))
        assert given.select(ROW_ID).distinct().count() == len(rows)
    by_id = spark.createDataFrame([("a", 1), ("a", 2)], "`_uuid` string, `_id` int")
    assert unique_id(by_id) == "_id"
    same = ids_of(derived_ids(spark.createDataFrame([(1,), (1,), (1,), (2,)], "v int")))
    stem = next(i for i in same if i + "-1" in same)
    assert len(stem) == 16 and {stem, f"{stem}-1", f"{stem}-2"} <= set(same) and len(set(same)) == 4


def test_row_ids_depend_on_content_only(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "v int, w string")
    assert ids_of(derived_ids(a)) == ids_of(derived_ids(a.select("w", "v")))
    assert ids_of(derived_ids(a)) == ids_of(derived_ids(a.repartition(3)))
    assert ids_of(derived_ids(texts(spark, "")))[0] != ids_of(derived_ids(texts(spark, None)))[0]


def test_row_ids_of_shared_hashes_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(rowids, "CHUNK", 7)
    monkeypatch.setattr(rowids, "content_hash", lambda df: F.lit("0" * 16))
    df = spark.createDataFrame([(1,)] * 20 + [(2,)] * 3 + [(3,)], "v int")
    got = derived_ids(df)
    assert ids_of(got) == sorted("0" * 16 + (f"-{n}" if n else "") for n in range(24))
    assert {r.v: r["count"] for r in got.groupBy("v").count().collect()} == {1: 20, 2: 3, 3: 1}
    monkeypatch.setattr(rowids, "BROADCAST_HASHES", 0)
    assert len(set(ids_of(derived_ids(df)))) == 24
    assert CHUNK == 1_000_000


def test_keep_first(spark):
    df = spark.createDataFrame(
        [("a", 2, "later"), ("a", 1, "first"), (None, 3, "x"), (None, 4, "y"), ("b", 5, "only")],
        "id string, at int, v string",
    )
    kept = keep_first(df, "id", [F.col("at")])
    assert sorted(r.v for r in kept.collect()) == ["first", "only", "x", "y"]
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_category_normalize(spark):
    df = texts(spark, "Львівська", "Львівська", "львівська", "Львівська обл.", "Одеська", None)
    fixed, mapping = category_normalize(df, "t", ["обл."])
    assert {tuple(r) for r in mapping.collect()} == {("львівська", "Львівська", 1), ("Львівська обл.", "Львівська", 1)}
    assert sorted(str(r.t) for r in fixed.collect()) == ["None"] + ["Львівська"] * 4 + ["Одеська"]


def test_clean_demo(spark, demo):
    plan = CleaningPlan(
        order=["submission_date", "head_age"], bounds={"head_age": (0, 120), "hh_size": (1, 50)},
        dates={"submission_date": ("2026-06-01", "2026-08-31")}, categories={"oblast": ["обл."]},
        key_fields=["head_sex"], id_field="_uuid",
    )
    out = clean_dataset(demo, plan)
    assert out.table.columns == demo.columns and out.table.count() == 3000
    assert out.table.select("_uuid").distinct().count() == 3000
    assert out.table.filter("head_age = 999").count() == 0
    assert out.table.filter("submission_date > '2026-12-31'").count() == 0
    assert out.table.select("oblast").distinct().count() == 8
    report = {(r.action, r.column): r for r in out.report.collect()}
    drop = report["duplicates dropped", "_uuid"]
    assert (drop.before, drop.after, drop.affected) == (3030, 3000, 30)
    assert report["impossible values set to missing", "head_age"].affected == 15
    assert report["impossible values set to missing", "hh_size"].affected == 0
    assert report["implausible dates set to missing", "submission_date"].affected == 10
    assert report["missing values", "head_sex"].affected == 90
    assert report["spelling replaced", "oblast"].detail == "Харківська обл. -> Харківська"
    assert [r.step for r in out.report.collect()] == sorted(r.step for r in out.report.collect())


def test_clean_without_an_id(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "v int, w string")
    out = clean_dataset(df, CleaningPlan(order=["v"]))
    assert out.table.count() == 3 and ROW_ID in out.table.columns
    assert out.report.first().action == "row id created"


def test_date_bounds_on_text(spark):
    df = texts(spark, "2026-06-01", "2030-01-01", "soon", None)
    rows = {r.t_flagged: r.t for r in date_bounds(df, {"t": (None, "2026-12-31")}).filter("t_flagged").collect()}
    assert rows == {True: None}
    assert date_bounds(df, {"t": (None, "2026-12-31")}).filter("t = 'soon'").count() == 1


LOGS = [
    (1, "ring +380671234567 or +380 67 123 45 67"), (2, "ОЛЕНА  КОВАЛЬ came"), (3, "Олена came, Коваль left"), (4, ""), (5, None),
    (6, "the quick brown dog"), (7, "see the quick, brown FOX!"), (8, "Ada wrote"), (9, "Adan wrote"),
]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(LOGS, "i int, t string")


def hits(found):
    return sorted(map(tuple, found.select("log_id", "key").collect()))


def test_leaked_phones(spark, logs):
    people = spark.createDataFrame([("+380 67 123 45 67",), ("0501112233",), (None,)], "p string")
    assert hits(leaked_phones(people, "p", logs, "i", "t")) == [(1, "380671234567")]


def test_leaked_runs_and_whole_values(spark, logs):
    people = spark.createDataFrame([("Олена Коваль",), ("the quick brown fox",), ("Ada",), ("...",), (None,)], "n string")
    short = [(2, "олена коваль"), (8, "ada")]
    assert hits(leaked_names(people, "n", logs, "i", "t", 3)) == sorted([*short, (6, "the quick brown"), (7, "the quick brown"), (7, "quick brown fox")])
    for words in (1, 2, 8):  # a part of a value is no leak, however few of its words are looked up
        assert hits(leaked_values(people, "n", logs, "i", "t", words)) == sorted([*short, (7, "the quick brown fox")])
    assert hits(leaked_names(people.where("n IS NULL"), "n", logs, "i", "t", 3)) == []


@pytest.mark.parametrize("seed", range(3))
def test_leaks_against_a_plain_search(spark, seed):
    """Few words, so pairs are common, values overlap and repeat, and a value may be one word that all logs hold."""
    rng = random.Random(seed)
    texts_ = [(n, " ".join(rng.choice(["a", "B", "c!", "d", "ее", "f"]) for _ in range(rng.randint(0, 30)))) for n in range(60)] + [(60, None), (61, "")]
    values = [" ".join(rng.choice("abcdf") for _ in range(rng.randint(1, 6))) for _ in range(25)] + [None, "", "  ", "zz zz", "a", "a a"]
    logs_ = spark.createDataFrame(texts_ + texts_[:5], "i int, t string")
    secrets = spark.createDataFrame([(v,) for v in values], "n string")
    spelt = {n: f" {(t or '').lower().replace('!', '')} " for n, t in texts_}
    whole = sorted({(n, v) for n, t in spelt.items() for v in values if v and v.strip() and f" {v} " in t})
    assert hits(leaked_values(secrets, "n", logs_, "i", "t", 2)) == hits(leaked_values(secrets, "n", logs_, "i", "t")) == whole
    runs = {" ".join(w[k : k + 3]) for v in values if v and (w := v.split()) for k in range(max(len(w) - 2, 1))}
    assert hits(leaked_names(secrets, "n", logs_, "i", "t", 3)) == sorted({(n, r) for n, t in spelt.items() for r in runs if f" {r} " in t})


def test_adhoc(spark, wells):
    catalog = Catalog({"wells": wells}, {"wells": ["well_no"]})
    answer = adhoc_sql(spark, catalog, "SELECT kind, count(*) AS n, '0501112233' AS x FROM wells WHERE kind IS NOT NULL GROUP BY kind")
    assert {tuple(r) for r in answer.collect()} == {("dug", 2, "[REDACTED]"), ("bored", 3, "[REDACTED]")}
    assert adhoc_sql(spark, catalog, "SELECT a.kind FROM wells a, wells b, wells c").count() == 50
    assert not spark.catalog.tableExists("wells")  # the views are gone


def test_adhoc_notes_and_byte_cap(spark, wells):
    catalog = Catalog({"wells": wells})
    out = ask(spark, catalog, "SELECT a.depth, '0501112233 +380671234567' AS x FROM wells a, wells b, wells c ORDER BY 1")
    assert tuple(out.notes.first()) == (216, 50, 166, 432)
    assert {r.depth for r in out.table.collect()} == {8, 12}
    small = ask(spark, catalog, "SELECT id, repeat('x', 40) AS t FROM range(30) ORDER BY id DESC", size=100)
    assert [r.id for r in small.table.collect()] == [29, 28] and small.notes.first().hidden == 28
    one = ask(spark, catalog, "SELECT repeat('x', 400) AS t", size=100)
    assert one.table.first().t == "x" * 100


def test_adhoc_redacts_every_cell(spark, wells):
    row = adhoc_sql(spark, Catalog({"wells": wells}), """
        SELECT array('a', '+380 67 123 45 67') AS l, named_struct('p', '0501112233', 'q', 5) AS s, map('0501112233', 1) AS m,
               380671234567 AS n, 42 AS k, 1.5 AS d, cast('0501112233' AS binary) AS b FROM wells LIMIT 1""").first()
    assert (row.l, row.s, row.m) == ('["a","[REDACTED]"]', '{"p":"[REDACTED]","q":5}', '{"[REDACTED]":1}')
    assert row.n is None and row.k == 42 and float(row.d) == 1.5 and row.b == "[REDACTED]"


@pytest.mark.parametrize("query", [
    "SELECT * FROM hidden", "DROP VIEW hidden", "CREATE TABLE x AS SELECT 1", "SELECT 1; SELECT 2", "SHOW TABLES", "INSERT INTO wells VALUES (1)",
    "SELECT 1 AS a) UNION ALL (SELECT name FROM hidden", "SELECT (SELECT max(name) FROM hidden) AS m", "WITH w AS (SELECT * FROM hidden) SELECT * FROM w",
    "WITH hidden AS (SELECT 1 AS a) SELECT * FROM hidden", "SELECT depth, depth FROM wells", "SELECT * FROM wells WHERE kind IN (SELECT name FROM hidden)",
    "SELECT * FROM parquet.`/tmp`", "not sql",
])
def test_adhoc_reads_its_own_views_only(spark, wells, query):
    spark.createDataFrame([("+380 67 123 45 67",)], "name string").createOrReplaceTempView("hidden")
    with pytest.raises(Exception):
        ask(spark, Catalog({"wells": wells}), query).table.collect()
    assert spark.table("hidden").count() == 1 and spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_adhoc_may_name_a_part(spark, wells):
    got = adhoc_sql(spark, Catalog({"wells": wells}), "WITH dug AS (SELECT * FROM wells WHERE kind = 'dug') SELECT count(*) AS n FROM dug")
    assert got.first().n == 2
    with pytest.raises(Exception, match="owner_phone"):
        adhoc_sql(spark, Catalog({"wells": wells}), "SELECT owner_phone FROM wells")


def test_personal_columns_do_not_depend_on_partitions(spark):
    rows = [(n, "0501112233" if n % 4 == 0 else "none", None if n % 50 else "0501112233") for n in range(4000)]
    df = spark.createDataFrame(rows, "n int, often string, seldom string")
    whole = [(n, "0501112233" if n < 20 else "none") for n in range(4000)]
    ordered = spark.createDataFrame(whole, "n int, head string")
    for frame in (df, df.repartition(7), df.repartition(3, "often")):
        assert pii_detect(frame) == pii_detect(df) and "seldom" in pii_detect(frame)
    for frame in (ordered, ordered.repartition(9)):
        assert pii_detect(frame, [F.col("n")]) == ["head"] and pii_detect(frame, [F.col("n").desc()]) == []
        assert Catalog({"o": frame}, {"o": ["n"]}).personal("o") == ["head"]


def one_slip(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        off = [i for i in range(len(a)) if a[i] != b[i]]
        return len(off) == 1 or (len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]])
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


@pytest.mark.parametrize("seed", range(3))
def test_slips_against_all_pairs(spark, seed):
    """Words of three letters, so that nearly all are neighbours of some; links by comparing every pair."""
    rng = random.Random(seed)
    counts = {"".join(rng.choice("ab1") for _ in range(rng.randint(3, 8))): rng.choice([1, 2, 7, 40, 300, 2000]) for _ in range(120)}
    link = {}
    for a, n in counts.items():
        near = [b for b, m in counts.items() if a != b and max(len(a), len(b)) >= SHORTEST and m >= n * DOMINANCE and one_slip(a, b)
                and re.sub(r"\D", "", a) == re.sub(r"\D", "", b) and (len(a) != len(b) or len(a) >= SHORTEST)]
        if near:
            link[a] = min(near, key=lambda b: (-counts[b], b))
    expected = {}
    for a in link:
        expected[a] = a
        while expected[a] in link:
            expected[a] = link[expected[a]]
    got = roots(spark.createDataFrame(list(counts.items()), "key string, n long"))
    assert {r.key: r.root for r in got.collect()} == expected and expected


def test_typos_and_mixed_letters(spark):
    texts_ = ["Харківська"] * 60 + ["Xарківська", "Харкiвська", "Харківьска", "Харквська", "харківсська", "Харківська"] + ["Сумська"] * 40
    texts_ += ["Район-1"] * 50 + ["Район-2"] * 3 + ["cash"] * 30 + ["cosh"] + ["Mykolaiv"] * 20 + ["Mykolajv", "Mikolajv"] + [None]
    df = spark.createDataFrame([(t,) for t in texts_], "t string")
    fixed, mapping = category_normalize(df, "t", slips=True)
    got = {r.t: r["count"] for r in fixed.groupBy("t").count().collect()}
    assert got == {"Харківська": 66, "Сумська": 40, "Район-1": 50, "Район-2": 3, "cash": 30, "cosh": 1, "Mykolaiv": 21, "Mikolajv": 1, None: 1}
    assert {r.variant for r in mapping.collect()} == {"Xарківська", "Харкiвська", "Харківьска", "Харквська", "харківсська", "Mykolajv"}
    assert category_normalize(df.limit(0), "t", slips=True)[1].count() == 0
    assert {r.t for r in category_normalize(df, "t")[0].distinct().collect()} == set(texts_)  # only when asked for


def test_verdicts_are_kept_with_the_table(spark, tmp_path):
    """The first file decides; only a column with few values there is looked up in the others; a new table needs a new verdict."""
    root, path = str(tmp_path), str(tmp_path / "visits")
    rows = [(n, "0501112233" if n < 60 else "x", None if n < 900 else "0501112233", "x" if n < 60 else "0501112233") for n in range(1000)]
    frame = spark.createDataFrame(rows, "n int, early string, sparse string, tail string")
    frame.repartitionByRange(4, "n").sortWithinPartitions("n").write.parquet(path)
    assert kept_verdict(spark, path) is None and keep_verdict(spark, path) == ["early", "sparse"] == kept_verdict(spark, path)
    catalog = Catalog.of_folder(spark, root, "visits")
    started = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    loaded = catalog.load("visits")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == started  # no job for the verdict
    assert loaded.pii == ["early", "sparse"] and catalog.stripped("visits").columns == ["n", "tail"]
    frame.drop("tail").write.mode("overwrite").parquet(path)
    assert kept_verdict(spark, path) is None and Catalog.of_folder(spark, root, "visits").personal("visits") is not None
    assert sink_pull(frame.withColumn("_uuid", F.col("n").cast("string")), root, "Visits") == 1000
    assert kept_verdict(spark, path) is not None and Catalog.of_folder(spark, root, "visits")._pii["visits"] == kept_verdict(spark, path)
    frame.limit(0).write.mode("overwrite").parquet(path)
    assert keep_verdict(spark, path) == []


def test_the_sample_hashes_a_row_once(spark):
    df = spark.range(10).selectExpr("id", "cast(id AS string) AS a", "cast(id AS string) AS b")
    plan = pii_sample(df, [], ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("xxhash64") > plan.index("Generate inline") and plan.count("xxhash64") == 1


def test_the_sample_sorts_no_whole_task(spark, tmp_path):
    """Copies, gaps and columns that fill up late: the first fifty as a plain count gives them, and no ranking of all cells."""
    rows = [(n, n % 3, None if n % 7 else f"s{n}", f"t{n}" if n > 11_000 else None) for n in range(12_000)]
    df = spark.createDataFrame(rows, "n int, few int, seldom string, tail string")
    plans = []
    for order in ([], [F.col("n").desc()]):
        sample = pii_sample(df, order, ["few", "seldom", "tail"])
        plans.append(sample._jdf.queryExecution().toString())
        got = {}
        for r in sample.collect():
            got.setdefault(r.column, []).append(r.value)
        keyed = df.withColumn("h", F.xxhash64("few", "seldom", "tail")).orderBy(*(order or ["h"])).collect()
        for name in ("few", "seldom", "tail"):
            assert sorted(got[name]) == sorted([str(r[name]) for r in keyed if r[name] is not None][:50])
    assert "WindowGroupLimit" not in plans[0] and plans[1].count("TakeOrderedAndProject") == 3 and "Window" not in plans[1]
    path = str(tmp_path / "t")
    df.coalesce(1).write.parquet(path)
    by_file = _in_file_order(spark.read.parquet(path), ["few", "seldom", "tail"])
    assert "WindowGroupLimit" not in by_file._jdf.queryExecution().toString()
    got = {(r.column, r.value) for r in by_file.collect()}
    assert {v for c, v in got if c == "seldom"} == {f"s{n}" for n in range(0, 350, 7)}
    assert {v for c, v in got if c == "tail"} == {f"t{n}" for n in range(11_001, 11_051)} and by_file.count() == 150


def test_unknown_dataset_message(spark, wells):
    with pytest.raises(ReportError, match="Available: wells"):
        Catalog({"wells": wells}).stripped("other")


def test_cleaning_counts_what_is_missing_afterwards(spark):
    rows = [("a", 5, "x"), ("a", 5, "x"), ("b", None, "x"), ("c", 999, "y"), ("d", 7, "y"), ("d", 700, "y")]
    tables = []
    for given in (rows, rows[::-1]):
        frame = spark.createDataFrame(given, "id string, age int, at string")
        out = clean_dataset(frame, CleaningPlan(order=["at"], id_field="id", bounds={"age": (0, 120)}, key_fields=["age"]))
        kept = {r.id: r.age for r in out.table.collect()}
        missing = next(r for r in out.report.collect() if r.action == "missing values")
        assert missing.affected == sum(v is None for v in kept.values()) and kept["b"] is kept["c"] is None
        tables.append(kept)
    assert tables[0] == tables[1]  # a tie is settled by content, not by arrival


def test_profile_counts_rows(spark, wells):
    assert {r.n_rows for r in profile(wells, ["owner_phone"]).collect()} == {6}


def test_compare_any_measure(spark):
    df = spark.createDataFrame([("2024-01-05", "a", 2.0), ("2024-01-20", "b", 3.0), ("2024-02-03", "a", 5.0)], "d string, g string, x double")
    months = [Period("d", date(2024, m, 1), date(2024, m, 28)) for m in (1, 2)]
    total = compare_measure(df, {"aggregation": "sum", "field": "x"}, *months).first()
    assert (total.category, total.first_value, total.second_value, total.difference, total.ratio) == (None, 5.0, 5.0, 0.0, 1.0)
    rows = {r.category: (r.first_value, r.second_value) for r in compare_measure(df, {"aggregation": "count"}, *months, by="g").collect()}
    assert rows == {"a": (1.0, 1.0), "b": (1.0, None)}
    share = {"aggregation": "percent", "numerator": {"field": "x", "filter": "g == 'a' or x > 9"}, "denominator": {"field": "x"}}
    for frame in (df, df.withColumnRenamed("g", "in_first")):  # the periods' flags take other names than the table's
        named = "g" if frame is df else "in_first"
        own = {**share, "numerator": {"field": "x", "filter": f"{named} == 'a' or x > 9"}}
        assert tuple(compare_measure(frame, own, *months).first())[1:] == (50.0, 100.0, 50.0, 2.0)
    empty = Period("d", date(2020, 1, 1), date(2020, 1, 2))
    assert tuple(compare_measure(df, {"aggregation": "count"}, months[0], empty).first())[1:] == (2.0, 0.0, -2.0, 0.0)


def test_a_comparison_reads_its_source_once(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(profiles, "staged", lambda frame, label: (plans.append(frame._jdf.queryExecution().executedPlan().toString()), staged(frame, label))[1])
    spark.sql("SELECT '2024-01-05' AS d, 'a' AS g, 2.0D AS x").write.parquet(str(tmp_path / "p"))
    months = [Period("d", date(2024, m, 1), date(2024, m, 28)) for m in (1, 2)]
    for by in (None, "g"):
        frame = compare_measure(spark.read.parquet(str(tmp_path / "p")), {"aggregation": "sum", "field": "x", "filter": "x > 1"}, *months, by=by)
        assert str(tmp_path) not in frame._jdf.queryExecution().executedPlan().toString()
    assert [plan.count("FileScan") for plan in plans] == [1, 1]


def test_places_and_shown_numbers(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    assert all(r.place == r.v + 1 for r in with_place(df, F.col("v")).collect())
    numbers = spark.createDataFrame([(2.0,), (-3.0,), (1.23456,), (None,), (1e16,)], "x double")
    assert [r[0] for r in numbers.select(shown_number(F.col("x"))).collect()] == ["2", "-3", "1.2346", None, "1.0E16"]
