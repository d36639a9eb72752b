"""The training-data pipeline over documents.  Each stage is written as Parquet and read again as the next one's input.

quality -> near duplicates -> benchmark decontamination -> mixing -> shards.  The last stage is the shard index:
a row for each row of the mix (a document taken twice has two), with its shard and slot.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattloom.llm import decontaminate, mixing, nearcopies, quality, sharding
from wattloom.llm.common import free_names
from wattloom.session import cut


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is at least quality.KEEP."""
    model = quality.quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = free_names(docs, "expected_grade", "tail")
    return quality.rate(docs, model, 2, tuple(names)).filter(F.col(names[1]) >= quality.KEEP).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more in five-word shingles."""
    return nearcopies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("quality", keep_sound),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# The quality model and the fingerprints have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
