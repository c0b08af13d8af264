"""One registered query for each operator of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.llm import (
    conversations, cutting_stock, decontaminate, lexical_search, packing, pii_crf, quality_gam, rules, simhash, substrings,
    token_files, toxicity, url_cascade,
)
from fieldtally.llm.common import bucket, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the patterns' spans and those that the field adds."""
    docs = table(spark, sf_dir, "documents")
    return pii_crf.find(docs, pii_crf.train(docs))


@register
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 ids, id 1 after each."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


@register
def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that a document with a smaller id holds, too."""
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


@register
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as flat id files in doc_id order, id 2 after each, and read back."""
    return token_files.tokens_round_trip(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2
    )


@register
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked within three bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or with other numbers and names."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


@register
def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by an additive model with pairwise interactions."""
    docs = table(spark, sf_dir, "documents")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_gam.score(docs, model)
    return scored.withColumn("held_out", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)))


@register
def op3_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and whether the weighed votes of the rules keep it."""
    return rules.judge(table(spark, sf_dir, "documents"))


@register
def op5_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, scored on the restored text."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("held_out", F.coalesce(bucket(F.col("doc_id"), 3) == 1, F.lit(False)))


@register
def op9_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the path rules, then by the cascade over listed hosts."""
    return url_cascade.judge_pages(table(spark, sf_dir, "pages"))


@register
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after the rows' damage: its faults, the cheapest edits, and the repaired text's hash."""
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


@register
def op13_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 ids, id 0 after each, without padding."""
    return cutting_stock.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0)


ORACLES["op8_template_decontamination"] = decontaminate.ORACLE
ORACLES["op9_bloom_cascade"] = url_cascade.ORACLE
ORACLES["op11_lexical_search"] = lexical_search.ORACLE
ORACLES["op12_conversation_repair"] = conversations.ORACLE
