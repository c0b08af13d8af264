"""Measures and breakdowns over a register of wells."""

import pytest

from fieldtally.errors import NotComputable
from fieldtally.operators.indicators import evaluate_indicators
from fieldtally.operators.measures import BITS, Conditions, Distinct, Tally, evaluate_measure
from tests.conftest import indicator

PII = ["owner_phone"]


def share(top=None, bottom=None):
    return {"dataset": "wells", "aggregation": "percent", "numerator": {"field": "well_no", "filter": top},
            "denominator": {"field": "well_no", "filter": bottom}}


def wells_of(aggregation, field=None, where=None):
    return {"dataset": "wells", "aggregation": aggregation, "field": field, "filter": where}


DEEP = share("depth >= 25", "kind.notna()")  # w2, w5 of w1, w2, w4, w5 have a kind; w3 is deep without one


def answer(df, measure):
    (row,) = evaluate_measure(df, measure, PII).collect()
    return row.value, row.reason


@pytest.mark.parametrize(("measure", "expected"), [
    (wells_of("count"), 6), (wells_of("count", "works"), 5), (wells_of("count", "works", "district == 'Vale'"), 1),
    (wells_of("count", where="depth > 500"), 0), (wells_of("count", where="kind in works"), 1),
    (wells_of("count_unique", "well_no"), 5), (wells_of("count_unique", "kind"), 2),
    (wells_of("count_unique", "well_no", "works.str.contains('pump')"), 2), (wells_of("count_unique", "district", "kind == 'dug'"), 2),
    (wells_of("sum", "depth"), 185), (wells_of("sum", "depth", "kind.isna()"), 25), (wells_of("sum", "depth", "depth > 500"), 0),
    (share("kind == 'dug'"), 40), (DEEP, 75), (share("depth > 500"), 0),
])
def test_values(wells, measure, expected):
    assert answer(wells, measure) == (float(expected), None)


@pytest.mark.parametrize(("measure", "words"), [
    (share(None, "depth > 500"), "denominator is 0"), (wells_of("sum", "works"), "5 non-numeric"),
])
def test_values_that_the_data_prevent(wells, measure, words):
    value, reason = answer(wells, measure)
    assert value is None and words in reason


@pytest.mark.parametrize(("measure", "words"), [
    (wells_of("count_unique", "shaft"), "'shaft' is no column.*profile"), (wells_of("sum", "DEPTH"), "'DEPTH' is no column"),
    (wells_of("count_unique", "owner_phone"), "personal data.*another column"), (wells_of("count", where="owner_phone.isna()"), "personal data"),
    (wells_of("count", where="depth >> 1"), "outside the filter language"), (wells_of("mode", "depth"), "'mode' is no aggregation"),
    (wells_of("sum"), "none is named"), (wells_of("count", ""), "name is missing"),
    ({"aggregation": "percent", "denominator": {"field": "well_no"}}, "without its numerator"),
])
def test_refusals_come_before_any_job(wells, measure, words):
    with pytest.raises(NotComputable, match=words):
        evaluate_measure(wells, measure, PII)


def test_numbers_written_as_text(spark):
    good = spark.createDataFrame([(" 7 ",), ("2.5e2",), ("-.25",), ("+1",), (None,)], "x string")
    assert answer(good, wells_of("sum", "x")) == (257.75, None)
    bad = spark.createDataFrame([(t,) for t in ("4kg", "1 000", "", "0b1", "NaN", "12")], "x string")
    assert "5 non-numeric" in answer(bad, wells_of("sum", "x"))[1]


def test_no_rows(wells):
    none = wells.where("false")
    assert [answer(none, m)[0] for m in (wells_of("count"), wells_of("count_unique", "kind"), wells_of("sum", "depth"))] == [0.0] * 3
    assert answer(none, DEEP)[0] is None


def by_category(df, item, pii=PII):
    return {(r.dimension, r.category): r.value for r in evaluate_indicators(df, [item], pii, "wells").breakdown().collect()}


def test_a_summary_row(wells):
    row = evaluate_indicators(wells, [indicator("7", wells_of("count_unique", "well_no"), target=8)], PII, "wells").summary().first()
    assert (row.code, row.name_en, row.dataset, row.unit) == ("7", "Indicator 7", "wells", "units")
    assert (row.actual, row.target, row.progress_pct, row.status, row.reason) == (5.0, 8.0, 62.5, "computed", None)


def test_breakdowns_keep_missing_and_empty_categories(wells):
    unique = wells_of("count_unique", "well_no")
    assert by_category(wells, indicator("1", unique, ["district", "kind"])) == {
        ("district", "Hill"): 2, ("district", "Vale"): 2, ("district", "(missing)"): 1,
        ("kind", "dug"): 2, ("kind", "bored"): 2, ("kind", "(missing)"): 1,
    }
    only = wells_of("count_unique", "well_no", "kind == 'bored'")
    assert by_category(wells, indicator("1", only, ["district"])) == {("district", "Hill"): 1, ("district", "Vale"): 0, ("district", "(missing)"): 1}


def test_a_reason_for_each_category(wells):
    run = evaluate_indicators(wells, [indicator("1", share("depth > 10", "kind == 'bored'"), ["district"])], PII, "wells")
    rows = {r.category: (r.value, r.reason) for r in run.breakdown().collect()}
    assert rows["Hill"] == (200.0, None) and rows["Vale"][0] is None and "denominator" in rows["Vale"][1]


def test_an_unusable_dimension_costs_its_breakdown_only(wells):
    run = evaluate_indicators(wells, [indicator("1", wells_of("count"), ["shaft", "owner_phone", "kind"])], PII, "wells")
    assert run.summary().first().actual == 6.0
    reasons = {r.dimension: r.reason for r in run.breakdown().where("category IS NULL").collect()}
    assert "no column" in reasons["shaft"] and "personal data" in reasons["owner_phone"] and set(reasons) == {"shaft", "owner_phone"}


def test_no_breakdown_without_a_value(wells):
    run = evaluate_indicators(wells, [indicator("1", wells_of("sum", "works"), ["kind"], 3)], PII, "wells")
    row = run.summary().first()
    assert (row.status, row.actual, row.target) == ("not_computable", None, 3.0) and run.breakdown().count() == 0


def test_membership_is_decided_within_a_category(spark):
    df = spark.createDataFrame([("m", "1", "2"), ("m", "2", "3"), ("n", "3", "9"), ("n", "9", "9")], "ward string, was string, now string")
    item = indicator("1", wells_of("count", where="was in now"), ["ward"])
    assert by_category(df, item, []) == {("ward", "m"): 1, ("ward", "n"): 1}
    assert evaluate_indicators(df, [item], [], "t").summary().first().actual == 3.0


def test_more_conditions_than_a_mask_has_bits(spark):
    df = spark.range(150).selectExpr("id AS n", "id % 7 AS g")
    parts = [Distinct("n", f"n >= {2 * k}") for k in range(BITS + 3)]
    counts = Tally(Conditions(df, []), [None, "g"], {None: parts, "g": parts}).frame.where("__lane = 0").first()
    assert [counts[f"d{k}"] for k in range(BITS + 3)] == [150 - 2 * k for k in range(BITS + 3)]


def test_a_hot_id_is_combined_before_the_shuffle(spark):
    df = spark.range(90_000).selectExpr("if(id % 3 = 0, -1, id) AS n", "if(id % 3 = 0, 'hot', 'cold') AS g")
    run = evaluate_indicators(df, [indicator("1", wells_of("count_unique", "n"), ["g"])], [], "t")
    plan = run.counts._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "Expand" not in plan and run.summary().first().actual == 60_001.0
