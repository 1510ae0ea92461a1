"""Corpus pipeline: documents -> quality rules -> near-duplicates -> benchmark
decontamination -> mix. Each stage is written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelab.llm import decontaminate, mix, quality, simhash
from pagelab.llm.common import shared_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the decision list learned from
    the labelled documents of this stage's input."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: 4-word shingles, 4 bits."""
    return simhash.keep_one(docs, width=4, max_bits=4)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of 10 words of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), width=10, remove="documents")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: sources weigh 5, 2, 1 in turn and share 150 % of the words,
    at most two passes. One row per document and pass, with its output shard and
    its place in the shard (``order_key``)."""
    return mix.mix(docs, weights=(5, 2, 1), share=1.5, max_epochs=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
]

#: The classes, windows and learned rules are not expressible in SQL; the tests
#: hold every stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
