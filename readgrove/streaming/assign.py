"""New reads against landmarks that stand still, file by file as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readgrove.operators.kmers import profiles
from readgrove.operators.search import Frozen, nearest_landmark
from readgrove.sources.fasta import parse_fasta


def assign_new_files(
    spark: SparkSession, path: str, landmarks: DataFrame, sink: str, checkpoint: str, min_identity: float = 0.6, metric: str = "alignment",
    strand: str = "plus", k: int = 8, files_at_once: int | None = None,
) -> DataFrame:
    """Searches every FASTA file below ``path`` that no earlier run has seen; the rows of ``sink``, of all runs.

    Rows are ``header, cluster, lm_ord, identity, strand, batch`` as ``nearest_landmark`` gives them, one for
    every record with a hit; equal reads under other headers are searched each. The stream ends when all
    files there are done. Files done are kept in ``checkpoint``, and a batch that is run again after a
    failure replaces its own folder, so every file counts once. All three folders are shared ones.
    """
    frozen = Frozen.of(landmarks)
    lines = spark.readStream.option("lineSep", ">")
    if files_at_once:
        lines = lines.option("maxFilesPerTrigger", files_at_once)
    reads = parse_fasta(lines.text(path).where(F.length("value") > 0))

    def search(batch: DataFrame, number: int) -> None:
        profiled = profiles(batch.select(F.col("header").alias("seq_id"), "read"), k)
        found = nearest_landmark(profiled, frozen, min_identity, metric, strand, k).withColumnRenamed("seq_id", "header")
        found.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = reads.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    cluster, lm_ord = (frozen.kinds[name].simpleString() for name in ("cluster", "lm_ord"))
    schema = f"header string, cluster {cluster}, lm_ord {lm_ord}, identity double, strand string, batch bigint"
    return spark.read.schema(schema).parquet(sink)
