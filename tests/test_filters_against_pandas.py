"""Random filters give the same rows as ``pandas.DataFrame.query`` with the 3.x text type."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtally.errors import NotComputable
from fieldtally.operators.filters import compile_filter

ROWS = [
    ("female", "a", 17, 1.5, True), ("male", "b", 18, None, False), (None, "A", -7, -2.0, True),
    ("", "fem", 0, 0.0, False), ("fe.male", "female", 40, 17.0, True), ("x", None, 3, 1e6, False),
]
SCHEMA = "s string, t string, i bigint, n double, b boolean"

texts = st.sampled_from(["female", "male", "a", "", "fe.male", "e", "FEM"]).map(repr)
wholes = st.integers(-20, 45).map(str)
reals = st.sampled_from(["1.5", "-2.0", "0.0", "17.0", "1e6"])
numbers = st.one_of(wholes, reals)
text_columns, number_columns = st.sampled_from("st"), st.sampled_from("in")
orders = st.sampled_from(["<", "<=", ">", ">="])
equals = st.sampled_from(["==", "!="])
comparisons = st.one_of(orders, equals)


def joined(*parts):
    return st.tuples(*(st.just(p) if isinstance(p, str) else p for p in parts)).map(" ".join)


def listed(items):
    return st.lists(items, min_size=1, max_size=3).map(lambda found: "[" + ", ".join(found) + "]")


divisors = st.sampled_from(["2", "-3", "7", "0", "i"])
terms = st.one_of(
    number_columns, joined(number_columns, st.sampled_from("+-*"), st.one_of(numbers, number_columns)),
    joined(number_columns, st.sampled_from("/%"), divisors), joined("-", number_columns),
)
leaves = st.one_of(
    joined(text_columns, comparisons, texts),
    joined(terms, comparisons, numbers),
    joined(terms, comparisons, terms),
    joined(text_columns, equals, text_columns),
    joined(numbers, orders, number_columns, orders, numbers),
    joined(text_columns, st.sampled_from(["in", "not in", "==", "!="]), listed(st.one_of(texts, st.just("None")))),
    joined(number_columns, st.sampled_from(["in", "not in"]), listed(numbers)),
    joined(number_columns, equals, texts),
    joined("s", "+", "t", equals, texts),
    joined("b", equals, st.sampled_from(["True", "False", "1"])),
    st.sampled_from([
        "s.isna()", "n.notna()", "s.isin(['male', None])", "i.isin([17, 40])", "n.isin([1.5])",
        "s.str.contains('fe')", "s.str.contains('FE', case=False)", "s.str.contains('e.m', regex=False)",
        "t.str.startswith('f', na=True)", "s.str.endswith('e')", "s.str.contains('^.e', na=False)",
        "t in s", "s not in t", "'male' in s",
    ]),
)
filters = st.recursive(
    leaves,
    lambda inner: st.one_of(
        joined("(", inner, st.sampled_from(["and", "or", "&", "|"]), inner, ")"),
        joined("not (", inner, ")"), joined("~ (", inner, ")"),
    ),
    max_leaves=4,
)


@pytest.fixture(scope="module")
def frames(spark):
    with pd.option_context("future.infer_string", True):
        pandas = pd.DataFrame(ROWS, columns=list("stinb"))
        pandas["k"] = range(len(ROWS))
    return pandas, spark.createDataFrame([(*row, k) for k, row in enumerate(ROWS)], SCHEMA + ", k int").cache()


def by_pandas(frame, text):
    with pd.option_context("future.infer_string", True, "mode.use_inf_as_na", False):
        try:
            return list(frame.query(text, local_dict={}, global_dict={})["k"])
        except Exception:
            return None


@settings(max_examples=25, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(filters, min_size=10, max_size=16))
def test_same_rows(frames, batch):
    from fieldtally.operators.filters import with_memberships

    pandas, df = frames
    columns, needed, expected = [], [], {}
    for n, text in enumerate(batch):
        try:
            condition, more = compile_filter(df, text, prefix=f"__in_{n}")
        except NotComputable:
            expected[text] = by_pandas(pandas, text)
            assert expected[text] is None, f"refused here: {text}"
            continue
        rows = by_pandas(pandas, text)
        if rows is None:
            continue
        expected[text] = rows
        needed += more
        hits = F.sort_array(F.collect_list(F.when(condition, F.col("k"))))
        columns.append((text, hits))
    if not columns:
        return
    got = with_memberships(df, needed).agg(*(c.alias(f"c{n}") for n, (_, c) in enumerate(columns))).first()
    for n, (text, _) in enumerate(columns):
        assert got[n] == expected[text], text
