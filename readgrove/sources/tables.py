"""Tab-separated sources and sinks: hits, memberships and count tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from readgrove.session import materialise, number_rows, small


def _read_tsv(spark: SparkSession, path: str | list[str], first: str, second: str) -> DataFrame:
    # a schema of two columns: Spark's reader drops what follows them
    reader = spark.read.schema(f"{first} string, {second} string")
    return reader.csv(path, sep="\t", quote="", enforceSchema=True)


def read_hits(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``header_set, cluster``: the first two columns of one or many hit files."""
    return _read_tsv(spark, path, "header_set", "cluster")


def read_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``query, target``: the first two columns of one or many membership files."""
    return _read_tsv(spark, path, "query", "target")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", quote="")


def _file_of(path):
    """The table a file belongs to: its folder for Spark's part files, else the file itself."""
    return F.regexp_replace(path, "/part-[^/]*$", "")


def _name_of(table, pattern: str):
    """The table's name, from the last part of its path as written: ``cluster=16`` and ``16.txt`` are ``16``."""
    last = F.url_decode(F.replace(F.regexp_extract(table, "([^/]*)/*$", 1), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(last, pattern, 1)


def write_otu_table(wide: DataFrame, path: str) -> None:
    """A wide count table: one header line, at the head of the first part file.

    Its parts joined in name order are one plain table.
    """
    names = [F.lit(name) for name in wide.columns]
    head = wide.sparkSession.range(1).select(F.lit(0).alias("place"), F.array_join(F.array(*names), "\t").alias("value"))
    cells = [F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) for name in wide.columns]
    rows = wide.select(F.lit(1).alias("place"), F.array_join(F.array(*cells), "\t").alias("value"))
    _write_lines(head.unionByName(rows), path)


def write_counts(counts: DataFrame, path: str, row: str, column: str) -> None:
    """The long table ``row, column, n`` as the same wide text, for any number of columns.

    Columns stand in ascending order, rows too; counts that are not there are 0. Only a line is held
    at a time: the columns are numbered by a distributed sort, and a row's counts are put in
    their places by number. The header is a line of its own and as long as the table is wide.
    """
    _write_lines(_count_lines(counts.withColumn("_table", F.lit("")), row, column).drop("_table"), path)


def write_count_tables(counts: DataFrame, path: str, table: str, row: str, column: str) -> None:
    """A wide table for each value of ``table``, all in one job: the folder ``path/<table>=<value>``.

    Every table has the columns of its own counts, under a header of its own, as ``write_counts`` writes
    it. Counts without a table are left out.
    """
    named = counts.where(F.col(table).isNotNull()).withColumn("_table", F.col(table).cast("string"))
    lines = _count_lines(named.select("_table", row, column, "n"), row, column).withColumnRenamed("_table", table)
    # sorted by table, so a header is the first line of the first file of its table
    lines.orderBy(table, "place", "value").select(table, "value").write.partitionBy(table).text(path)


def _count_lines(counts: DataFrame, row: str, column: str) -> DataFrame:
    """``_table, place, value``: the lines of each table, the header at place 0."""
    keyed = counts.select("_table", F.col(row).cast("string").alias("row"), F.col(column).cast("string").alias("name"), "n")
    names = materialise(number_rows(keyed.select("_table", "name").distinct(), ["_table", "name"], "at"), "columns")
    tables = names.groupBy("_table").agg(F.min("at").alias("first"), F.count(F.lit(1)).cast("int").alias("width"))
    tables = materialise(tables, "tables")
    known = small(tables, tables.count(), 64)
    names = names.join(known, "_table").select("_table", "name", (F.col("at") - F.col("first")).alias("at"), "width")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "name"))), lambda c: c["name"])
    head = names.groupBy("_table").agg(F.concat_ws("\t", F.lit(row), listed).alias("value"))
    summed = keyed.groupBy("_table", "row", "name").agg(F.sum("n").alias("n"))
    placed = summed.join(names, ["_table", "name"]).groupBy("_table", "row", "width").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("ns"))
    lines = placed.select("_table", F.lit(1).alias("place"), _dense("row", "width", "ns.at", "ns.n").alias("value"))
    return head.select("_table", F.lit(0).alias("place"), "value").unionByName(lines)


@F.arrow_udf(StringType())
def _dense(name: pa.Array, width: pa.Array, at: pa.Array, n: pa.Array) -> pa.Array:
    """A row's name, the width of its table, the places of its counts and the counts, as a line."""
    lines = []
    for row, size, places, counts in zip(name.to_pylist(), width.to_pylist(), at, n):
        cells = np.zeros(size, np.int64)
        cells[places.values.to_numpy()] = counts.values.to_numpy()
        lines.append("\t".join([row, *map(str, cells.tolist())]))
    return pa.array(lines, pa.string())


def _write_lines(lines: DataFrame, path: str) -> None:
    lines.orderBy("place", "value").select("value").write.text(path)


def read_otu_table(
    spark: SparkSession, path: str | list[str], index: str, column: str, corner: str | None = None, table: str | None = None,
    name: str = r"([^=]*?)(?:\.[^.]*)?$",
) -> DataFrame:
    """Wide count tables as ``index, column, n`` rows, each table under its own header.

    A header is a line whose first cell is ``corner``, by default the ``index`` name; it may stand in
    any part of its table, and again. Tables of many clusters with different columns can be read
    together: a count is named by its place in the header of its own table.

    With ``table``, a column of that name tells which table a count comes from: what the first group of the
    pattern ``name`` finds in the last part of its path, by default ``16`` for the folder ``cluster=16`` and
    the file ``16.txt``. Without it, equal names in two tables cannot be told apart any more.
    """
    found_in = _file_of(F.col("_metadata.file_path"))
    lines = spark.read.text(path, recursiveFileLookup=True).select(found_in.alias("_table"), F.split("value", "\t").alias("cells"))
    is_head = F.get("cells", F.lit(0)) == (index if corner is None else corner)
    heads = lines.where(is_head).select("_table", F.posexplode("cells").alias("at", column)).where("at > 0").distinct()
    rows = lines.where(~is_head).select("_table", F.get("cells", F.lit(0)).alias(index), F.posexplode("cells").alias("at", "cell"))
    found = rows.where("at > 0").join(heads, ["_table", "at"])
    told = [] if table is None else [_name_of(F.col("_table"), name).alias(table)]
    return found.select(*told, index, column, F.col("cell").cast("double").cast("bigint").alias("n"))
