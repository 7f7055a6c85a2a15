"""A corpus from raw documents to shuffled shards: five stages, each one of the operators of seqlake.llm.

Each stage takes all rows that the stage before kept, and its decisions take effect: frequent lines and the
documents that fail the quality rules go; of near duplicates one stays; documents with a benchmark passage go;
sources are mixed to their targets, documents repeated as the mix takes them; and the rows are dealt to shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqlake.llm import decontaminate, mixing, neardup, quality_rules, sharding
from seqlake.llm.common import checkpointed, table

#: The last stage ends in a seeded Fisher-Yates shuffle, which SQL does not have.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_corpus(docs, weight=mixing.by_length())


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.external_shuffle(docs)


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_passages),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; between stages the documents are a checkpoint, as each stage reads them more than once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
