"""Corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination,
mixing and sharding, each stage over all that its predecessor kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame. Between the stages
the documents are written as Parquet to the folder of ``spark.checkpoint.dir``
and read again. All stages but the last return the columns of ``documents``;
the last one returns the shard of every record of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillbook.llm import contamination, mixing, quality, sharding, simhash
from tillbook.llm.common import Stage

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.cascade(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return contamination.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents once for each epoch that the mix takes of them."""
    return mixing.mix(docs)


def shard_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every record."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", shard_records),
]

#: SQL has no SimHash of XXH64 hashes; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table is removed once the next one is written."""
    stage, docs, last = Stage(spark), _table(spark, sf_dir, "documents"), None
    for k, (_, apply) in enumerate(STAGES):
        made = apply(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        docs = stage.write(made)
        if last is not None:
            stage.drop(last)
        last = docs
