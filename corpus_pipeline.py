"""A training corpus from the documents: filter, deduplicate, mix, pack.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns the next stage's documents, whole rows with the columns of the
table, which may have more columns of any names. The last returns the packing plan. An empty table gives
an empty result at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathomlake.llm import exactdedup, mixing, neardup, packing, quality
from fathomlake.llm.shared import shared_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, accepts.

    Null texts and texts without a word go; without labels all others stay. Rows with a null id or
    repeated rows are judged by their text like any other.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one of least id (null orders last). Null texts all stay."""
    return exactdedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least id (null orders last), once if its row is repeated.

    Texts without a word are in no group and stay.
    """
    return neardup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources have their target weights, shard by shard; a null source is a source.

    Ties between documents are broken by hashes of their ids.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which bytes of the documents go to which place of which window. Null and empty texts have a row without a window."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No SQL expresses a trained classifier or a packing; the tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn on ``documents``, each one's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_table(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
