"""From hits of unique reads to the cluster of every original read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readgrove.functions.sequence import hash60, parse_header_set
from readgrove.session import BROADCAST_BYTES, number_rows

CLUSTER_ROW_BYTES = 128


def explode_header_sets(hits: DataFrame) -> DataFrame:
    """One row per header of each ``Set(...)``; other columns are kept, malformed text is an error."""
    others = [name for name in hits.columns if name != "header_set"]
    return hits.select(F.explode(parse_header_set(F.col("header_set"))).alias("header"), *others)


def dedupe_hits(hits: DataFrame, order: str) -> DataFrame:
    """``header, cluster``: of several hits of a header the last by ``order``, then by cluster."""
    last = F.max(F.struct(F.col(order).alias("o"), F.col("cluster").alias("c")))
    return hits.groupBy("header").agg(last.alias("last")).select("header", F.col("last.c").alias("cluster"))


def observed_clusters(hits: DataFrame) -> DataFrame:
    return hits.select("cluster").distinct()


def unassigned(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Reads whose header has no hit."""
    return reads.join(hits.select("header"), "header", "left_anti")


def assigned(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """Reads whose header has a hit."""
    return reads.join(hits.select("header"), "header", "left_semi")


def fallback_slot(header: Column, seed: int, clusters: int) -> Column:
    """The cluster number a read without a hit is given: a hash of its header."""
    return hash60(F.concat_ws("|", F.lit(f"fallback|{seed}"), header)) % F.lit(clusters)


def assign_all(reads: DataFrame, hits: DataFrame, seed: int = 0) -> DataFrame:
    """``header, read, cluster`` for every read; one without a hit gets a pseudo-random cluster.

    ``reads`` and ``hits(header, cluster)`` have one row per header. The choice is among the
    observed clusters in ascending order. Without any hit there is nothing to choose from: an error.
    """
    clusters = number_rows(observed_clusters(hits), ["cluster"], "slot").withColumnRenamed("cluster", "fallback")
    n = clusters.count()
    if n == 0:
        raise ValueError("no hit at all: no cluster to assign reads to")
    joined = reads.select("header", "read").join(hits.select("header", "cluster"), "header", "left")
    slot = fallback_slot(F.col("header"), seed, n)
    if n * CLUSTER_ROW_BYTES <= BROADCAST_BYTES:
        open_slot = F.when(F.col("cluster").isNull(), slot)
        filled = joined.withColumn("slot", open_slot).join(F.broadcast(clusters), "slot", "left")
        return filled.select("header", "read", F.coalesce("cluster", "fallback").alias("cluster"))
    missing = joined.where(F.col("cluster").isNull()).withColumn("slot", slot).join(clusters, "slot")
    return joined.where(F.col("cluster").isNotNull()).unionByName(
        missing.select("header", "read", F.col("fallback").alias("cluster"))
    )


def count_clusters(assigned_reads: DataFrame) -> DataFrame:
    """Number of clusters that hold a read."""
    return assigned_reads.agg(F.count_distinct("cluster").alias("n_clusters"))


def cluster_members(assigned_reads: DataFrame) -> DataFrame:
    """``cluster, n_reads``: reads per cluster."""
    return assigned_reads.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_reads"))
