"""The corpus pipeline: quality classifier, quality rules, SimHash near-dedup, best-fit packing.

Each stage takes all that its predecessor kept; the last returns packed pieces. Stages are written as Parquet to the
folder that all executors share and read back, which ends their lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import importance, packing, rules, simhash
from tessera.llm.common import forget, stored

#: Bytes of a worker's memos. Stages share their workers, which keep what each took, so memos are smaller than in a lone query.
MEMO_BYTES = 16 << 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the labels come with the tables."""
    return importance.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), memo=MEMO_BYTES)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the production policy."""
    return rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return simhash.dedup(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, memo=MEMO_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted models, hashed links and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; what a stage wrote is deleted when the next one's rows are stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            forget(spark, before)
        before = path
    return docs
