"""Dereplication: unique reads with the number of distinct headers that carry them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from readgrove.functions.sequence import seq_id
from readgrove.session import materialise, small

MAX_HEADERS = 100_000
HOT_ROW_BYTES = 64


def dereplicate(reads: DataFrame) -> DataFrame:
    """``seq_id, read, abundance`` per unique upper-cased read.

    Spark plans the distinct count as a shuffle on (read, header), which spreads the headers of a
    read that fills a third of the input, and then a pre-aggregated count per read.
    """
    upper = reads.select(F.upper("read").alias("read"), "header")
    counted = upper.groupBy("read").agg(F.count_distinct("header").alias("abundance"))
    return counted.select(seq_id(F.col("read")).alias("seq_id"), "read", "abundance")


def header_sets(reads: DataFrame, derep: DataFrame, max_headers: int = MAX_HEADERS) -> DataFrame:
    """``seq_id, read, part, parts, headers``: the sorted distinct headers of every unique read.

    A read with more than ``max_headers`` headers gets several rows, its headers shared out by
    hash, so that neither a task nor a row holds an unbounded set. All other reads have one row,
    ``part`` 0. ``derep`` tells which reads are that hot: at most rows / ``max_headers`` of them.
    It is read twice, so pass a written table.
    """
    hot = derep.where(F.col("abundance") > max_headers).select(
        "seq_id", F.ceil(F.col("abundance") / max_headers).cast("int").alias("n_parts")
    )
    n_hot = hot.count()
    upper = reads.select(F.upper("read").alias("read"), "header")
    keyed = upper.withColumn("seq_id", seq_id(F.col("read")))
    part, parts = F.lit(0), F.lit(1)
    if n_hot:
        keyed = keyed.join(small(hot, n_hot, HOT_ROW_BYTES), "seq_id", "left")
        parts = F.coalesce("n_parts", F.lit(1))
        part = F.pmod(F.xxhash64("header"), parts).cast("int")
    grouped = keyed.groupBy("read", part.alias("part"), parts.alias("parts")).agg(
        F.sort_array(F.collect_set("header")).alias("headers")
    )
    return grouped.select(seq_id(F.col("read")).alias("seq_id"), "read", "part", "parts", "headers")


def abundant(derep: DataFrame, n: int = 2) -> DataFrame:
    """Reads carried by at least ``n`` distinct headers."""
    return derep.where(F.col("abundance") >= n)


def stage_counts(reads: DataFrame, derep: DataFrame, n: int = 2) -> DataFrame:
    """``stage, n``: records read, unique reads, and abundant reads."""
    total = reads.agg(F.count(F.lit(1)).alias("n")).select(F.lit("input").alias("stage"), "n")
    unique = derep.agg(
        F.count(F.lit(1)).alias("unique"), F.count_if(F.col("abundance") >= n).alias("abundant")
    )
    return total.unionByName(unique.unpivot([], ["unique", "abundant"], "stage", "n"))


def dereplicate_counted(reads: DataFrame, n: int = 2) -> tuple[DataFrame, DataFrame]:
    """The unique reads as a written table, and their ``stage_counts``, in the one pass that writes them.

    Spark counts the rows as they go by, so nothing is read again to be counted.
    """
    read, kept = Observation(), Observation()
    seen = reads.observe(read, F.count(F.lit(1)).alias("input"))
    counts = F.count(F.lit(1)).alias("unique"), F.count_if(F.col("abundance") >= n).alias("abundant")
    unique = materialise(dereplicate(seen).observe(kept, *counts), "derep")
    # of a plan that it knows to be empty Spark counts nothing
    found = dict.fromkeys(("input", "unique", "abundant"), 0) if unique.isEmpty() else {**read.get, **kept.get}
    stages = [(name, int(value)) for name, value in found.items()]
    return unique, reads.sparkSession.createDataFrame(stages, "stage string, n bigint")
