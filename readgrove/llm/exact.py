"""Exact duplicates by a tree of merged digest runs, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readgrove.llm.lists import counted
from readgrove.session import materialise

#: Binomial rounds merged at once: 2 ** ROUNDS runs become one at every level of the tree.
ROUNDS = 3
#: What says that two texts are the same: a strong digest, and two independent checks of it.
KEY = ["sha", "check", "n_bytes"]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, sha, check, n_bytes, run`` per row; ``run`` is the partition that made the row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    return rows.select(
        "doc", F.unhex(F.sha2("text", 256)).alias("sha"), F.xxhash64("text").alias("check"),
        F.octet_length("text").cast("long").alias("n_bytes"), F.spark_partition_id().alias("run"),
    )


def merge_runs(rows: DataFrame, keep: str = "smallest") -> DataFrame:
    """``sha, check, n_bytes, keep_id, group_size``: one row per different text.

    Every partition first makes a run of its own digests. In each round the runs whose numbers
    differ in the next ``ROUNDS`` bits exchange their rows by digest and are merged to one run,
    which keeps one identifier and the number of copies per verified digest. A run is spread over
    tasks by digest, so the last one is in no single task, and a text that fills a third of the rows
    is a single row of each run after the first step.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    last = rows.agg(F.max("run")).first()[0]

    def merged(runs: DataFrame, run: Column, size: Column) -> DataFrame:
        return runs.groupBy(run.alias("run"), *KEY).agg(pick("keep_id").alias("keep_id"), size.alias("group_size"))

    runs = rows.select("run", *KEY, F.col("doc").alias("keep_id"))
    runs = merged(runs, F.col("run"), F.count(F.lit(1)))
    left = last or 0
    while left:
        left >>= ROUNDS
        runs = merged(runs, F.shiftright("run", ROUNDS), F.sum("group_size"))
    return runs.drop("run")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` per row of ``docs``.

    Texts are equal if their bytes are; null counts as empty. Of equal texts the ``keep``
    ("smallest" or "largest") id stays. A null id never stays if its text has another id; if all ids
    of a text are null, ``keep_id`` is null and its rows count as kept. Rows that repeat an id and
    its text are all marked kept; ``drop_exact_duplicates`` leaves one of them. Other columns are
    ignored, an empty table gives an empty result.
    """
    rows = materialise(digests(docs, id_col, text_col), "digests")
    groups = materialise(merge_runs(rows, keep), "digest_groups")
    # both sides are plain tables here, so Spark can split the rows of a very frequent text
    joined = rows.join(groups, KEY)
    return joined.select(
        F.col("doc").alias(id_col), "keep_id", "group_size",
        F.col("doc").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of ``docs`` per different text, with the columns of ``docs``.

    The row with the ``keep`` id stays; of rows that share that id and text, or that all lack an id,
    any one. Texts are shuffled only where such repeated rows must be told apart, or where the
    list of dropped rows is too long to broadcast.
    """
    rows = materialise(digests(docs, id_col, text_col), "digests")
    groups = materialise(merge_runs(rows, keep), "digest_groups")
    marked = rows.join(groups, KEY)
    kept = F.col("doc").eqNullSafe(F.col("keep_id"))
    gone = marked.where(~kept).select("doc", "check").distinct()
    repeated = marked.where(kept & (F.col("group_size") > 1)).groupBy("doc", *KEY).agg(F.count(F.lit(1)).alias("n"))
    gone = materialise(gone, "dropped")
    again = materialise(repeated.where("n > 1").select("doc", "check").distinct(), "repeated")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))

    def listed(ids: DataFrame) -> Column:
        return docs[id_col].cast("long").eqNullSafe(ids["doc"]) & (F.xxhash64(text) == ids["check"])

    left = docs.join(counted(gone), listed(gone), "left_anti")
    if again.isEmpty():
        return left
    once = left.join(counted(again), listed(again), "left_semi").dropDuplicates([id_col, text_col])
    return left.join(counted(again), listed(again), "left_anti").unionByName(once)
