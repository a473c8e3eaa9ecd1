"""FASTA as a splittable text source, and the FASTA sinks. Nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readgrove.functions.sequence import format_header_set, let


def read_fasta(spark: SparkSession, path: str | list[str], with_file: bool = False, with_position: bool = False) -> DataFrame:
    """Raw records ``value``: the text between two ``>``, wherever they stand; no empty ones.

    ``position`` orders the records by file name and place in the file.
    """
    raw = spark.read.option("lineSep", ">").text(path)
    columns = [F.col("value")]
    if with_file:
        columns.append(F.col("_metadata.file_path").alias("file"))
    if with_position:
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
        columns.append(place.alias("position"))
    return raw.select(*columns).where(F.length("value") > 0)


def parse_fasta(
    raw: DataFrame, mode: str = "failfast", strip_cr: bool = True, fold_case: bool = True
) -> DataFrame:
    """``header, read`` per record: first line, and all further lines joined (and upper-cased).

    A record without bases is an error with ``failfast`` and left out with ``dropmalformed``.
    Other columns of ``raw`` are kept.
    """
    if mode not in ("failfast", "dropmalformed"):
        raise ValueError(f"unknown mode {mode!r}")
    text = F.replace(F.col("value"), F.lit("\r"), F.lit("")) if strip_cr else F.col("value")
    header = F.substring_index(text, "\n", 1)
    bases = F.replace(F.substr(text, F.length(header) + 1), F.lit("\n"), F.lit(""))
    read = F.upper(bases) if fold_case else bases
    others = [F.col(name) for name in raw.columns if name != "value"]
    reads = raw.select(header.alias("header"), read.alias("read"), *others)
    if mode == "dropmalformed":
        return reads.where(F.length("read") > 0)
    checked = F.when(F.length("read") > 0, F.col("read")).otherwise(
        F.raise_error(F.concat(F.lit("FASTA record without bases: "), F.col("header"))).cast("string")
    )
    return reads.withColumn("read", checked)


def reads_by_header(reads: DataFrame, order: Column | None = None) -> DataFrame:
    """One ``header, read`` per header; of repeated headers the last in ``order`` stays.

    Blanks around both are trimmed and the case is kept. Without ``order`` the greatest read stays.
    """
    trimmed = reads.withColumn("header", F.trim("header")).withColumn("read", F.trim("read"))
    last = F.max("read") if order is None else F.max_by("read", order)
    return trimmed.groupBy("header").agg(last.alias("read"))


def _write(df: DataFrame, name: Column, read: Column, path: str) -> None:
    df.select(F.concat(F.lit(">"), name, F.lit("\n"), read).alias("value")).write.text(path)


def write_fasta(df: DataFrame, path: str, name: str = "header", read: str = "read") -> None:
    _write(df, F.col(name), F.col(read), path)


def write_derep(header_sets: DataFrame, path: str) -> None:
    """``>Set(h1, h2)`` and the read: one record per unique read, however many headers it has.

    A record is one line and so one row; only reads whose headers came in several parts are
    gathered again for it.
    """
    columns = ["read", "headers"]
    cut = header_sets.where(F.col("parts") > 1).groupBy("seq_id", "read").agg(
        F.sort_array(F.flatten(F.collect_list("headers"))).alias("headers")
    )
    whole = header_sets.where(F.col("parts") == 1).select(*columns).unionByName(cut.select(*columns))
    _write(whole, format_header_set(F.col("headers")), F.col("read"), path)


def cluster_name(cluster: Column) -> Column:
    return F.concat(F.lit("cluster_"), cluster.cast("string"))


def write_partition(labels: DataFrame, path: str) -> None:
    """``>cluster_<i>`` and the read, for every labelled read."""
    _write(labels, cluster_name(F.col("cluster")), F.col("read"), path)


def write_landmarks(leaf_landmarks: DataFrame, path: str) -> None:
    """``>cluster_<i>`` and the read, for every landmark; names repeat within a leaf."""
    _write(leaf_landmarks, cluster_name(F.col("cluster")), F.col("read"), path)


def write_clusters(assigned: DataFrame, path: str) -> None:
    """One FASTA folder per cluster with every read once, ``path/cluster=<name>/``.

    The rebalance lets adaptive execution gather small clusters into few files and cut a cluster
    that holds much of the data into many tasks.
    """
    lines = assigned.select(
        "cluster", F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("read")).alias("value")
    )
    lines.hint("rebalance", "cluster").write.partitionBy("cluster").text(path)


def read_clusters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``cluster, header, read`` from folders written by ``write_clusters``, any number of them."""
    paths = [path] if isinstance(path, str) else path
    raw = None
    for one in paths:
        part = spark.read.option("lineSep", ">").schema("value string, cluster string").text(one)
        raw = part if raw is None else raw.unionByName(part)
    return parse_fasta(raw.where(F.length("value") > 0), fold_case=False).select("cluster", "header", "read")


def write_centroids(otus: DataFrame, path: str) -> None:
    """Centroid reads under their unit names."""
    _write(otus, F.col("otu"), F.col("read"), path)


def read_centroids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``cluster, centroid, read`` from one or many centroid files, records over many lines.

    The cluster is the last folder or file name part of the form ``cluster=<name>`` or
    ``<name>_centroids.fa``.
    """
    raw = parse_fasta(read_fasta(spark, path, with_file=True), fold_case=False)
    name = F.regexp_extract("file", r"(?:cluster=([^/]+)/[^/]*|([^/]+)_centroids\.fa)$", 0)
    cluster = let(
        name,
        lambda text: F.when(
            F.startswith(text, F.lit("cluster=")),
            F.substring_index(F.substring_index(text, "/", 1), "=", -1),
        ).otherwise(F.substring_index(text, "_centroids.fa", 1)),
    )
    return raw.select(cluster.alias("cluster"), F.col("header").alias("centroid"), F.trim("read").alias("read"))
