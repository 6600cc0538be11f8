"""The training-data pipeline: five operators, one after another, over all documents.

Each stage takes what its predecessor kept, written as Parquet and read again, and returns the columns of ``documents``;
the last adds where a row stands in the mix, and returns the rows in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from typeloom.llm.common import stored
from typeloom.llm.decontaminate import drop_leaks
from typeloom.llm.linedup import cut_documents
from typeloom.llm.mixing import mix
from typeloom.llm.neardup import first_of_each
from typeloom.llm.quality import keep_good
from typeloom.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on length, repetition and perplexity."""
    ship_package(spark)
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those with nothing left go."""
    ship_package(spark)
    return cut_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    ship_package(spark)
    return first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    ship_package(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix."""
    ship_package(spark)
    mixed = mix(docs)
    return mixed.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: No SQL says what a perplexity model or an alignment keeps; tests hold each stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
