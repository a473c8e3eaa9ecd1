"""Scratch tables on shared storage, and joins against small tables whose size is checked."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest table, in bytes, that a join sends whole to every executor.
BROADCAST_BYTES = 256 * 1024 * 1024

CHECKPOINT_DIR, WAREHOUSE_DIR = "spark.checkpoint.dir", "spark.sql.warehouse.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names for checkpoints, else one below the warehouse.

    A cluster has to name one of the two: the default warehouse is a folder of the driver's own machine.
    """
    context = spark.sparkContext
    # the second is set by SparkContext.setCheckpointDir; its trailing part is the context's own folder
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not root:
        named = context.getConf().get(WAREHOUSE_DIR)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} or {WAREHOUSE_DIR} to a folder that all executors share")
        root = f"{(named or spark.conf.get(WAREHOUSE_DIR)).rstrip('/')}/scratch"
    return root.rstrip("/")


#: Folders made inside each open ``scratch_scope``, the innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path nobody used before, below the shared scratch folder.

    It lives as long as the innermost ``scratch_scope``, or with ``keep`` as the one around that.
    """
    folder = f"{_own_scratch(spark)}/{uuid.uuid4().hex}"
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(folder)
    return f"{folder}/{name}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the scratch tables made inside when it ends; what is to stay must be written elsewhere or kept."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for folder in _SCOPES.pop():
            delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/readgrove/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that read them must be stored before."""
    delete(spark, _own_scratch(spark))


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a shared Parquet table and read it back.

    Cuts the lineage, survives the loss of any executor, keeps column pruning, and gives the
    optimizer the real size of the table for its later joins. For ``keep`` see ``scratch_path``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What holds inside ``sparing``.
_SPARING = {
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """For the jobs run inside: tables are packed tighter, and shuffled rows are deleted as soon as their job has ended.

    Else they stay on disk until the driver happens to collect its garbage.
    """
    before = {key: spark.conf.get(key, None) for key in _SPARING}
    for key, value in _SPARING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, before their scope ends. Nothing may read them any more."""
    for table in tables:
        files = table._jdf.inputFiles()
        if len(files):
            delete(table.sparkSession, files[0].rsplit("/", 1)[0])


def materialise_parts(df: DataFrame, by: str, name: str) -> list[DataFrame]:
    """Write ``df`` like ``materialise`` in one job, and read back a table for each value of ``by``, without it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.partitionBy(by).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    found = sorted(entry.getPath().getName() for entry in entries)
    rows = spark.read.schema(df.drop(by).schema)
    return [rows.parquet(f"{path}/{part}") for part in found if part.startswith(f"{by}=")]


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast a table of that counted size if it is within the limit, else leave it as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def attach(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    rows: int,
    row_bytes: int,
    sizes: DataFrame,
    total: int,
    owner: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Inner join of ``big`` with a table holding one row per owner, by default a cluster.

    ``rows * row_bytes`` is the counted size of ``small``. Within the limit it is broadcast, so
    ``big`` is not shuffled. Beyond it, owners of at least ``total * row_bytes / limit`` of the
    ``total`` rows of ``big`` are broadcast: at most ``limit / row_bytes`` can be that heavy. The
    rest is shuffled by key, where no key is heavy any more. ``sizes`` holds the owner's columns
    and ``size``.
    """
    owner = owner or ["cluster"]
    fit = max(1, (BROADCAST_BYTES if limit is None else limit) // max(1, row_bytes))
    if rows <= fit:
        return big.join(F.broadcast(small), on)
    weighed = small.join(sizes.select(*owner, F.col("size").alias("_weight")), owner)
    heavy = weighed.where(F.col("_weight") * fit >= total).drop("_weight")
    light = weighed.where(F.col("_weight") * fit < total).drop("_weight")
    return big.join(F.broadcast(heavy), on).unionByName(big.join(light.hint("merge"), on))


def number_rows(df: DataFrame, order: list, name: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... over the whole table in the given order.

    The range-partitioned sort is written once with a row number per partition; the only global
    step is a running sum over one row per partition.
    """
    tagged = df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id())
    tagged = materialise(tagged, "numbered")
    within = (1 << 33) - 1
    part = F.shiftright("_row", 33).alias("_part")
    counts = tagged.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(
        F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = counts.select("_part", before.alias("_before"))
    joined = tagged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    number = F.col("_before") + F.col("_row").bitwiseAND(F.lit(within))
    return joined.withColumn(name, number).drop("_part", "_before", "_row")
