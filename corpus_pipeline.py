"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from readgrove.llm.decontam import decontaminate
from readgrove.llm.exact import drop_exact_duplicates
from readgrove.llm.packing import pack
from readgrove.llm.quality import keep_quality
from readgrove.llm.simhash import simhash_dedup
from readgrove.session import delete, scratch_path, scratch_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


# In every stage null texts count as empty, repeated rows stay or go together unless the stage removes copies,
# an empty table gives an empty one, and other columns pass through whatever their names are.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores as good; null ids are scored like others, empty texts as texts without words."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest id; one without an id only if no other has one."""
    return drop_exact_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of three words at up to three bits, the one with the smallest id.

    Documents without an id stay; texts without words are near copies of one another.
    """
    return simhash_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; null and empty texts stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of what is left in sequences of 4096 tokens; an empty text is its end mark alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained scores, fingerprint components and packing are no SQL; tests check them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before it wrote to the shared folder.

    What a stage needs only for itself, and the table before it, are deleted once its own is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        before, docs = path, spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
