"""Unit tables: counts per centroid and sample, unit numbers, and the wide tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrove.functions.sequence import sample_of
from readgrove.session import number_rows


def otu_counts(members: DataFrame, centroids: DataFrame | None = None) -> DataFrame:
    """``cluster, centroid, sample, n`` from ``members(cluster, query, target)``.

    A centroid is not a member of its own unit; pass ``centroids`` to count it as one.
    """
    rows = members.select("cluster", F.col("target").alias("centroid"), F.col("query").alias("header"))
    if centroids is not None:
        rows = rows.unionByName(centroids.select("cluster", "centroid", F.col("centroid").alias("header")))
    sampled = rows.withColumn("sample", sample_of(F.col("header")))
    return sampled.groupBy("cluster", "centroid", "sample").agg(F.count(F.lit(1)).alias("n"))


def _wide(counts: DataFrame, row: str, column: str, columns: list[str] | None) -> DataFrame:
    grouped = counts.groupBy(row)
    pivoted = grouped.pivot(column, columns) if columns else grouped.pivot(column)
    return pivoted.agg(F.sum("n")).na.fill(0)


def otu_pivot(counts: DataFrame, centroids: list[str] | None = None) -> DataFrame:
    """Partial table: a row per sample, a column per centroid, 0 where there is no read.

    For the few centroids of one cluster; name them where they are known, which saves a pass.
    ``tables.write_counts`` writes the wide text of any number of columns from the counts.
    """
    return _wide(counts, "sample", "centroid", centroids)


def number_otus(centroids: DataFrame) -> DataFrame:
    """Adds ``otu_num`` and ``otu``: by cluster, longest first, then by centroid."""
    order = ["cluster", F.desc(F.length("read")), "centroid"]
    numbered = number_rows(centroids, order, "otu_num")
    return numbered.withColumn("otu", F.concat(F.lit("OTU_"), F.col("otu_num").cast("string")))


def rename_otus(counts: DataFrame, otus: DataFrame) -> DataFrame:
    """``otu_num, otu, sample, n``: counts under unit names, matched by cluster and centroid.

    Clusters may be numbers on one side and their text on the other, as a table's name is.
    """
    names = otus.select(F.col("cluster").cast("string").alias("cluster"), "centroid", "otu_num", "otu")
    counts = counts.withColumn("cluster", F.col("cluster").cast("string"))
    return counts.join(names, ["cluster", "centroid"]).select("otu_num", "otu", "sample", "n")


def merge_otu_tables(parts: list[DataFrame], otus: DataFrame) -> DataFrame:
    """Partial counts of many clusters as one long table under unit names.

    The parts have ``cluster, centroid, sample, n``. A unit is a centroid of a cluster: two clusters may name
    a centroid alike.
    """
    merged = reduce(DataFrame.unionByName, parts)
    return rename_otus(merged, otus).groupBy("otu_num", "otu", "sample").agg(F.sum("n").alias("n"))


def otu_table(counts: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """Final table: a row per unit in number order, a column per sample, 0 where there is no read."""
    wide = _wide(counts.select("otu_num", "sample", "n"), "otu_num", "sample", samples)
    named = wide.withColumn("otu", F.concat(F.lit("OTU_"), F.col("otu_num").cast("string")))
    return named.orderBy("otu_num").select("otu", *[c for c in wide.columns if c != "otu_num"])
