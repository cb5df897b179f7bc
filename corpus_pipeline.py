"""A training corpus from `documents`: toxic texts out, one of each near-duplicate group, benchmark
passages out, sources mixed to their weights, and the rest dealt to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dartline.llm import decontaminate, jaccard, mixing, sharding, toxicity
from dartline.llm.common import Work, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(docs, [1.0] * sharding.SHARDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]
#: Stages with models and searches have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written and read again."""
    work, docs, last = Work(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir))
        if last is not None:
            work.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
