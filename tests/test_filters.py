"""The filter language over a table of clinics: what it keeps, what it refuses, and why."""

import pytest
from pyspark.sql import functions as F

from fieldtally.errors import NotComputable
from fieldtally.operators.filters import compile_filter, safe_filter

PII = ["nurse_mobile", "head nurse"]
CLINICS = [
    (1, "North", "rural", 4, "day", "+44 20 1", "Ann", 0.5, True, "a+b (new) [x]"),
    (2, "South", None, 12, "night", "+44 20 2", "Bea", -3.0, False, "+380 ward"),
    (3, "North", "urban", 30, "day", "+44 20 3", "Cyd", None, None, "plain"),
    (4, None, "rural", 55, "night", "+44 20 4", "Dot", 0.0, True, None),
    (5, "East", "urban", 9, "day", "+44 20 5", "Eve", 8.25, False, "PLAIN"),
]
SCHEMA = (
    "no int, region string, setting string, beds bigint, `shift kind` string, nurse_mobile string, `head nurse` string, "
    "margin double, open boolean, note string"
)


@pytest.fixture(scope="module")
def clinics(spark):
    return spark.createDataFrame(CLINICS, SCHEMA).cache()


def kept(df, text):
    return [r["no"] for r in safe_filter(df, text, PII).select("no").orderBy("no").collect()]


COMPARISONS = {
    "beds > 10": [2, 3, 4], "beds <= 9": [1, 5], "10 < beds <= 30": [2, 3], "beds == 12.0": [2], "beds != 12": [1, 3, 4, 5],
    "region == 'North'": [1, 3], "'North' == region": [1, 3], "beds < 10 and region == 'East'": [5], "   beds>=55   ": [4],
    "beds > 10 & region == 'South'": [2], "beds < 5 | beds > 50": [1, 4], "beds == 4 or beds == 12 and region == 'South'": [1, 2],
    "not beds > 10": [1, 5], "~(beds > 10)": [1, 5], "(beds > 10) == (setting == 'urban')": [1, 3], "`shift kind` == 'night'": [2, 4],
    "beds > -1": [1, 2, 3, 4, 5], "beds == 99999999999999999999": [], "open == True": [1, 4], "open == 0": [2, 5], "open != True": [2, 3, 5],
}
MISSING = {
    "region != 'North'": [2, 4, 5], "region not in ['North', 'South']": [4, 5], "margin > 0": [1, 5], "not margin > 0": [2, 3, 4],
    "region.isna()": [4], "setting.notna()": [1, 3, 4, 5], "not region.isna() and setting.notna()": [1, 3, 5], "region == None": [],
    "region != None": [1, 2, 3, 4, 5], "region in ['East', None]": [4, 5], "margin.isin([None, 0])": [3, 4], "~setting.str.contains('urb')": [1, 2, 4],
    "setting.str.startswith('u', na=True)": [2, 3, 5],
}
LISTS = {
    "region in ('East', 'South')": [2, 5], "region.isin(['East'])": [5], "beds in [4, 9.0]": [1, 5], "beds not in [4, 9]": [2, 3, 4],
    "region == ['East', 'South']": [2, 5], "['North'] != region": [2, 4, 5], "'North' in region": [1, 3], "region in []": [],
    "beds in ['4', 9]": [5], "region in ['East', 7]": [5], "beds == '4'": [], "beds != '4'": [1, 2, 3, 4, 5], "region == beds": [],
}
TEXTS = {
    "setting.str.endswith('al')": [1, 4], "region.str.contains('th')": [1, 2, 3], "note.str.contains('plain')": [3],
    "note.str.contains('plain', case=False)": [3, 5], "note.str.contains('PLAIN', False, regex=False)": [3, 5],
    "note.str.contains('(', regex=False)": [1], "note.str.contains('[', regex=False)": [1], "note.str.contains('+380', regex=False)": [2],
    "note.str.contains('a+b', regex=False)": [1], "note.str.contains('a+b')": [], "note.str.contains('^p.*n$')": [3],
    "region + '!' == 'East!'": [5],
}
SUMS = {
    "beds * 2 > 60": [4], "beds - 10 < 0": [1, 5], "beds / 0 > 1": [1, 2, 3, 4, 5], "margin / 0 < -1": [2], "beds % 5 == 4": [1, 5],
    "-beds % 7 == 5": [3, 5], "beds % -5 == -1": [1, 5], "beds % 0 == 0": [], "-margin > 1": [2], "~beds < -50": [4], "margin % 2 == 1.0": [2],
}


@pytest.mark.parametrize(("text", "expected"), [c for group in (COMPARISONS, MISSING, LISTS, TEXTS, SUMS) for c in group.items()])
def test_kept_rows(clinics, text, expected):
    assert kept(clinics, text) == expected


def test_arithmetic_at_the_ends_of_the_range(spark):
    ends = [2**63 - 1, 2**63 - 2, -(2**63), -(2**63) + 1, 0, 5]
    pairs = [(a, b) for a in ends for b in ends]
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(pairs)], "no int, a bigint, b bigint")
    assert [r.no for r in safe_filter(df, "a % b > 1").orderBy("no").collect()] == [n for n, (a, b) in enumerate(pairs) if b and a % b > 1]
    assert [r.no for r in safe_filter(df, "a % b < 0").orderBy("no").collect()] == [n for n, (a, b) in enumerate(pairs) if b and a % b < 0]
    safe_filter(df, "a + b > 1 or a * b > 1 or a - b > 1 or -a > 1").count()  # overflow is missing, no error


OUTSIDE = [
    "beds > @limit", "beds.max() > 4", "region.str.upper() == 'EAST'", "region.str.contains(setting)", "region.__class__ == 1",
    "note.str.contains('p', flags=2)", "region.isin(setting)", "region.isin([setting])", "region.isin(['a'], ['b'])", "open.isna(1)",
    "len(region) > 3", "beds ** 2 > 9", "beds // 2 > 9", "region['x'] == 1", "1 if beds else 2", "beds is None", "[b for b in beds]",
    "lambda: beds", "f'{beds}' == '4'", "beds > 1\nand beds < 9", "`region == 'East'", "x`region` == 'East'", "`re'gion` == 1", "beds > 1j", "beds == b'4'",
    "beds >", "region === 'East'", "(" * 400, "clinics.to_csv('x')", "beds > 1 or clinics.to_csv('x')",
]
NO_CONDITION = ["region", "(open)", "open and beds > 1", "beds > 1 or open", "not open", "~beds", "beds - 1", "'text'", "['North']", "5", "None"]
UNFIT = [
    "beds.str.contains('1')", "beds < '9'", "region > 3", "region * 2 == 'x'", "region % 'x' == 'y'", "-region == 'x'", "'a' != 'b'", "1 < 2 < beds",
    "note.str.contains('(')", "note.str.contains('[')", "note.str.contains('+380')", "note.str.startswith('p', case=False)", "region.isna(case=True)",
    "region.isin(['East'], na=True)", "note.str.contains(3)", "note.str.contains()", "note.str.contains('p', True, 4096)", "beds in 4", "4 in beds",
]


@pytest.mark.parametrize(("text", "words"), [
    *((t, "outside the filter language") for t in OUTSIDE + NO_CONDITION), *((t, "does not fit") for t in UNFIT),
    ("wards > 1", "no such column.*profile"), ("REGION == 'East'", "no such column"),
    ("nurse_mobile == '1'", "personal data.*another column"), ("`head nurse`.isna()", "personal data"), ("note == 'nurse_mobile'", "personal data"),
    ("ｎｕｒｓｅ_ｍｏｂｉｌｅ.isna()", "personal data"), ("Nurse_Mobile.isna()", "no such column"),
])
def test_refusals_name_the_reason_and_no_cell(clinics, text, words):
    with pytest.raises(NotComputable, match=words) as refusal:
        safe_filter(clinics, text, PII)
    assert "+44" not in refusal.value.reason and "Traceback" not in refusal.value.reason


def test_membership_in_another_column(spark):
    moves = spark.createDataFrame([(1, "x", "y"), (2, "y", "z"), (3, "q", None), (4, None, "x"), (5, "z", "z")], "no int, was string, now string")
    assert kept(moves, "was in now") == [1, 2, 4, 5]
    assert kept(moves, "was not in now") == [3]
    assert kept(moves, "no > 1 and was in now") == [2, 4, 5]
    assert kept(moves, "was in no") == []  # a text is no number
    assert safe_filter(moves, "was in now").columns == moves.columns


def test_moments(spark):
    visits = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-02-28 23:30:00'), (2, TIMESTAMP_NTZ'2024-02-29 00:00:00'), (3, NULL) AS v(no, at)"
    )
    assert kept(visits, "at >= '2024-02-29'") == [2] and kept(visits, "at == '2024-02-29'") == [2]
    assert kept(visits, "at != '2024-02-29'") == [1, 3] and kept(visits, "at < '2024-02-29T01:15:00+02:00'") == []
    with pytest.raises(NotComputable, match="does not fit"):
        safe_filter(visits, "at > 'spring'")


@pytest.mark.parametrize(("pattern", "hits"), [
    (r"\d", "٣b1"), (r"^.1$", ["b1"]), (r"b\Z", ["]b"]), ("[[b]", ["[", "]b", "b1"]), ("[]]b", ["]b"]), ("(?P<k>b)1", ["b1"]), ("[b&&1]", ["]b", "b1"]), ("[1^]", ["b1"]),
])
def test_patterns_are_read_as_python_reads_them(spark, pattern, hits):
    df = spark.createDataFrame([(t,) for t in ("b1", "٣", "[", "]b", "z")], "t string")
    got = [r.t for r in safe_filter(df, f"t.str.contains({pattern!r})").collect()]
    assert sorted(got) == sorted(["b1", "٣"] if hits == "٣b1" else hits)


def test_plain_comparisons_reach_the_reader(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("beds"), F.lit("North").alias("region")).write.parquet(str(tmp_path / "t"))
    found = safe_filter(spark.read.parquet(str(tmp_path / "t")), "beds > 7 and region != 'South' and region in ['North', 'East']")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(beds,7)" in plan and "EqualNullSafe(region,South)" in plan and "In(region, [East,North])" in plan.replace("[North,East]", "[East,North]")


def test_no_condition_keeps_every_row(clinics):
    assert safe_filter(clinics, "").count() == safe_filter(clinics, None).count() == 5
    assert compile_filter(clinics, None)[1] == []
