"""From raw documents to shards of a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that its
predecessor kept, and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from velum.llm.common import shared_dir, table
from velum.llm.decontaminate import drop_contaminated
from velum.llm.language import keep_known_languages, train_language_filter, training_rows
from velum.llm.mixing import apply_mix
from velum.llm.sharding import shard_names, with_shards
from velum.llm.simhash import near_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters or in none of them go."""
    return keep_known_languages(docs, train_language_filter(training_rows(docs)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return near_dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, not even one window of it."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), items=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return apply_mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard."""
    return with_shards(docs, shard_names())


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: SQL expresses neither the first two stages nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    base = f"{shared_dir(spark)}/velum/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
