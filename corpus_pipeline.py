"""The training-data pipeline: five stages, each calling one operator on all that the one before kept.

Every stage but the last returns the columns that it was given. Rows that repeat are handled as each
operator says; the mix may take a document in two epochs, which then are two rows of the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontaminate, langid, mixing, near_dedup, sharding
from loomline.llm.common import scratch_path

#: The mix takes as many tokens as it is given, redistributed to the target weights.
BUDGET_SHARE = 1.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text is in one of the learnt languages; the others go."""
    return langid.accept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by domain, language and source, in the target weights; at most two epochs of each leaf."""
    return mixing.mix(docs, mixing.document_levels(), mixing.WEIGHTS, BUDGET_SHARE, mixing.MAX_EPOCHS, mixing.SEED)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard; no shard of several keys is above the byte limit."""
    return sharding.shard(docs, sharding.LIMIT)


STAGES = [("language_id", language_id), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("sharding", shards)]

#: Language ID and near-duplicate groups are beyond SQL; tests hold each stage against SQL or plain Python on what it was given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
