"""The corpus pipeline: stages that each call one operator of ``llm``, written and read between stages.

1. quality classifier: documents that it rejects go;
2. SimHash near-dedup: the document of smallest id of each group stays; texts of five-word similarity 0.8 or more link;
3. benchmark decontamination: removal spans are cut out of the texts;
4. mixing: documents are repeated or left out, so that sources meet their target weights;
5. token output: all ids as binary shards, and what a reader gets back, one row per document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from llm import decontaminate, mixing, quality, simhash, tokenbin
from llm.common import written
from llm.queries import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.removed(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokenbin.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [(f.__name__, f) for f in (quality_filter, simhash_dedup, benchmark_decontamination, source_mixing, token_output)]

#: Trained models, random rounding and a tokenizer can't be written as SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
