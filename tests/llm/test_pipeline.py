"""The stages of the pipeline on small tables, and the library without this folder."""

import subprocess
import sys

import pytest

import corpus_pipeline
from tests.llm.fixtures import awkward

SF_LARGER = "/root/testdata/sf0.01"


def through(spark, docs, tmp_path, sf_dir=SF_LARGER):
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_on_the_small_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet")
    steps = through(spark, docs, tmp_path)
    for before, after in steps[:-1]:
        assert after.columns == docs.columns and after.count() <= before.count()
    labels = spark.read.parquet(f"{SF_LARGER}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    ids = [{r["doc_id"] for r in after.select("doc_id").collect()} for _, after in steps]
    good = labels[labels == 1].index
    assert len(ids[0] & set(good)) > 0.98 * len(good)  # clean documents stay
    assert len(ids[0] & set(labels[labels == 0].index)) < 0.1 * (labels == 0).sum()
    from fieldtally.llm.simhash import near_duplicates

    again = near_duplicates(steps[1][1]).toPandas()
    assert (again["doc_id"] == again["component_id"]).all()  # one of each group
    from fieldtally.llm.decontaminate import leaks

    assert leaks(steps[2][1], spark.read.parquet(f"{SF_LARGER}/benchmark.parquet")).count() == 0
    from fieldtally.llm.pii_crf import KINDS, base_spans

    assert ids[3] == ids[2]
    assert not any(base_spans(r["text"])[k] for r in steps[3][1].collect() for k in KINDS)
    assert ids[4] == ids[3]
    packed = steps[4][1].groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in packed) <= 4096
    assert corpus_pipeline.run(spark, SF_LARGER).count() == steps[4][1].count()


def test_stages_on_awkward_rows(spark, tmp_path):
    docs = awkward(spark)
    steps = through(spark, docs, tmp_path)
    for before, after in steps[:-1]:
        assert after.columns == docs.columns and after.count() <= before.count()


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_LARGER}/documents.parquet").limit(0)
    assert through(spark, docs, tmp_path)[-1][1].count() == 0


@pytest.mark.parametrize("hidden,left", [("fieldtally.llm", False), ("corpus_pipeline", False), ("nothing", True)])
def test_the_rest_stands_without_this_folder(hidden, left):
    code = f"""
import importlib.abc, sys
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {hidden!r} or name.startswith({hidden!r} + "."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert ("pipeline" in e.queries()) == {left}
assert "indicator_registry" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)
