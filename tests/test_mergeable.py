"""Distinct counts kept as bitmaps and merged across pulls."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtally.errors import NotComputable, ReportError
from fieldtally.operators.fivew import five_w_long, reach, read_spec
from fieldtally.operators.mergeable import add_pull, five_w_pull, measure_facts, merged_counts
from tests.test_fivew import PII, SPEC, repairs  # noqa: F401  (a fixture)

UNIQUE = {"aggregation": "count_unique", "field": "well_no", "filter": "depth > 10"}


def counts(frame):
    return {tuple(r)[:-1]: r[-1] for r in frame.collect()}


def test_pulls_add_up_to_the_whole(spark, tmp_path):
    dice = random.Random(3)
    rows = [(dice.randrange(4), dice.choice("abc"), f"w{dice.randrange(40)}") for _ in range(300)]
    df = spark.createDataFrame(rows, "pull int, kind string, __id string")
    store = str(tmp_path / "s")
    for pull in (2, 0, 3, 1):
        add_pull(df.where(F.col("pull") == pull).drop("pull"), store, str(pull))
    for chosen in ([0], [1, 3], [0, 1, 2, 3], None):
        want = {}
        for pull, kind, name in rows:
            if chosen is None or pull in chosen:
                want.setdefault((kind,), set()).add(name)
        got = counts(merged_counts(spark, store, chosen and [str(p) for p in chosen]))
        assert got == {k: len(v) for k, v in want.items()}
    numbers = sorted(r.number for r in spark.read.parquet(f"{store}/ids").collect())
    assert numbers == list(range(1, 1 + len({name for *_, name in rows})))


def test_a_pull_written_again_replaces_itself(spark, tmp_path):
    store = str(tmp_path / "s")
    add_pull(spark.createDataFrame([("a",), ("b",), ("a",)], "__id string"), store, "1")
    add_pull(spark.createDataFrame([("c",), (None,)], "__id string"), store, "1")
    assert merged_counts(spark, store).first()[0] == 1
    add_pull(spark.createDataFrame([("b",), ("c",)], "__id string"), store, "2")
    assert merged_counts(spark, store).first()[0] == 2
    assert spark.read.parquet(f"{store}/ids").count() == 3


def test_more_ids_than_a_bitmap(spark, tmp_path):
    store = str(tmp_path / "s")
    for pull, (low, high) in {"a": (0, 50_000), "b": (30_000, 100_000)}.items():
        ids = spark.range(low, high).select(F.col("id").alias("__id"), F.lit("hot").alias("kind"))
        add_pull(ids, store, pull)
    assert counts(merged_counts(spark, store)) == {("hot",): 100_000}
    assert counts(merged_counts(spark, store, ["b"])) == {("hot",): 70_000}
    assert spark.read.parquet(f"{store}/pulls").groupBy("__bucket").count().count() == 4


def test_measure(spark, wells, tmp_path):
    store = str(tmp_path / "s")
    for pull, where in {"hill": "district = 'Hill'", "rest": "district IS NULL OR district != 'Hill'"}.items():
        add_pull(measure_facts(wells.where(where), UNIQUE, ["kind"]), store, pull)
    assert counts(merged_counts(spark, store)) == {
        (None, None): 4, ("kind", "dug"): 1, ("kind", "bored"): 2, ("kind", "(missing)"): 1,
    }
    shallow = UNIQUE | {"filter": "depth < 10"}
    add_pull(measure_facts(wells, shallow, ["kind"]), str(tmp_path / "t"), "1")
    assert counts(merged_counts(spark, str(tmp_path / "t")))["kind", "bored"] == 0


def test_five_w(spark, repairs, tmp_path):  # noqa: F811
    store = str(tmp_path / "s")
    for pull, where in {"w2": "well_no = 'w2'", "rest": "well_no IS NULL OR well_no != 'w2'", "none": "false"}.items():
        five_w_pull(repairs.where(where), SPEC, store, pull, PII)
    whole = counts(five_w_long(repairs, SPEC, PII))
    assert counts(merged_counts(spark, f"{store}/matrix")) == whole
    assert merged_counts(spark, f"{store}/reach").first()[0] == reach(repairs, read_spec(SPEC)).first()[0] == 4
    assert merged_counts(spark, f"{store}/reach", ["none"]).first()[0] == 0


def test_earlier_pulls_are_not_read(spark, wells, tmp_path):
    store = str(tmp_path / "s")
    add_pull(measure_facts(wells, UNIQUE), store, "1")
    for part in (tmp_path / "s" / "pulls" / "pull=1").glob("*.parquet"):
        part.write_bytes(b"not to be read")
    for crc in (tmp_path / "s" / "pulls" / "pull=1").glob(".*.crc"):
        crc.write_bytes(b"")
    add_pull(measure_facts(wells, UNIQUE), store, "2")
    assert merged_counts(spark, store, ["2"]).first()[-1] == 4


@pytest.mark.parametrize("measure, names", [
    ({"aggregation": "sum", "field": "depth"}, []), (UNIQUE | {"field": "owner_phone"}, []), (UNIQUE, ["owner_phone"]),
    (UNIQUE | {"filter": "kind in works"}, []),
])
def test_refusals(wells, measure, names):
    with pytest.raises(NotComputable):
        measure_facts(wells, measure, names, PII)


def test_unknown_pulls(spark, wells, tmp_path):
    store = str(tmp_path / "s")
    add_pull(measure_facts(wells, UNIQUE), store, "1")
    for pulls in (["2"], []):
        with pytest.raises(ReportError):
            merged_counts(spark, store, pulls)
    with pytest.raises(ReportError):
        add_pull(measure_facts(wells, UNIQUE), store, "a/b")


def test_a_source_is_read_once(spark, repairs, tmp_path):  # noqa: F811
    seen = spark.sparkContext.accumulator(0)

    def passed(name):
        seen.add(1)
        return name

    marked = F.udf(passed, "string").asNondeterministic()
    five_w_pull(repairs.withColumn(SPEC["whom"]["id_field"], marked(SPEC["whom"]["id_field"])), SPEC, str(tmp_path / "s"), "1", PII)
    assert seen.value == repairs.count()


def test_ids_that_share_keys_share_bitmaps(spark, tmp_path):
    """Twenty kinds whose ids alternate, over four bitmaps: each kind lies in one or two, not in all."""
    store = str(tmp_path / "s")
    facts = spark.range(100_000).select(F.col("id").alias("__id"), (F.col("id") % 20).cast("string").alias("kind"))
    add_pull(facts, store, "1")
    assert spark.read.parquet(f"{store}/pulls").count() <= 23
    assert counts(merged_counts(spark, store)) == {(str(k),): 5000 for k in range(20)}
