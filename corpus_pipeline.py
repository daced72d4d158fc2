"""A training corpus from raw documents, as stages that each call one operator of larkspur.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read again as the next stage's docs, so that a lost executor costs one stage's tasks at most.
What a stage read is deleted once its own result is written. All stages keep the columns of
documents, whatever their names; the last adds each row's shard and place to the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from larkspur.llm.state import remove, shared_folder


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the full policy rejects."""
    names = {c: f"in {c}" for c in docs.columns}  # the ledger's measurements replace columns of their names
    led = quality_rules.ledger(docs.withColumnsRenamed(names), text="in text")
    kept = led.where(~quality_rules.rejected(quality_rules.FULL)).select(*[F.col(f"`{c}`") for c in names.values()])
    return kept.withColumnsRenamed({new: c for c, new in names.items()})


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, k=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item is leaked."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its place there, by a map that is stored in the shared folder."""
    return sharding.shard_documents(docs, 40)


STAGES = [("quality rules", rules), ("jaccard join", one_of_each), ("decontamination", clean), ("mixing", mix), ("sharding", shards)]

#: Random rounding and the hashes of slots are not for SQL; tests/llm holds run() against brute force on a fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
