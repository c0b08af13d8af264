"""The corpus pipeline: five of the training-data operators, each stage written as Parquet and read by the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldtally.llm import decontaminate, packing, pii_crf, quality_gam, simhash
from fieldtally.llm.common import bounded_batches, table
from fieldtally.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that score under 0.7 go; the model is fitted on the labelled ones of this stage's input.

    A NULL text is judged as an empty one; equal rows stay or go together; a score of exactly 0.7 stays; without rows nothing is left.
    """
    bounded_batches(spark)
    return quality_gam.keep_good(docs, quality_gam.train(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each group within three bits stays, the one with the smallest doc_id.

    NULL, empty and blank texts share the fingerprint zero and are one group; of repeated rows one stays; an empty table stays empty.
    """
    bounded_batches(spark)
    return simhash.keep_one(docs)


def template_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that leak a benchmark item evidently go.

    NULL and empty texts leak nothing; equal rows stay or go together; an item of fewer than five words that many texts hold is no
    evidence; without rows or items nothing goes.
    """
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def skip_chain_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data in the texts is masked by its kind.

    Every row stays; a NULL text stays NULL, an empty one empty, and equal texts are masked alike.
    """
    bounded_batches(spark)
    return pii_crf.redact(docs, pii_crf.train(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the places of all remaining documents in sequences of 4,096 ids.

    NULL and empty texts are one id; longer texts than a sequence are cut; an empty table packs into no sequence.
    """
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("template_decontamination", template_decontamination),
    ("skip_chain_pii", skip_chain_pii),
    ("best_fit_packing", best_fit_packing),
]

# The first stage is a fitted model, which SQL cannot express; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage returns is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
