"""The corpus pipeline: filtering, near and exact duplicates, decontamination and packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaymark.llm import convnet, decontaminate, packing, suffixes, trie_join
from quaymark.llm.text import set_aside
from quaymark.session import checkpoint_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality network rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, own = set_aside(docs, {"score", "held_out", "predicted"})
    return convnet.classified(docs, labels).filter("predicted = 1").select(*own)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group linked by 5-word shingles at a similarity of 0.75."""
    return trie_join.one_per_group(docs)


def repeats_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 100 bytes that also start earlier; n_chars is counted anew."""
    return suffixes.deduplicated(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", repeats_cut),
    ("benchmark decontamination", uncontaminated),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each writes Parquet to the shared folder, and the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name.replace(' ', '-')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
