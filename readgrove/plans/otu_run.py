"""From raw reads to the unit table in one Spark application."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readgrove.operators.assign import assign_all, dedupe_hits
from readgrove.operators.derep import abundant, dereplicate_counted, header_sets
from readgrove.operators.kmers import profiles
from readgrove.operators.otu import number_otus, otu_counts, rename_otus
from readgrove.operators.picker import subcluster
from readgrove.operators.search import nearest_landmark
from readgrove.plans.divide import DivideParams, Division, divide
from readgrove.session import materialise
from readgrove.sources.fasta import (
    cluster_name, parse_fasta, read_fasta, reads_by_header, write_centroids, write_clusters, write_derep,
    write_landmarks, write_partition,
)
from readgrove.sources.tables import write_counts, write_tsv


@dataclass
class OtuRun:
    """Every stage of a run: ``assigned(header, read, cluster)``, ``counts(otu_num, otu, sample, n)``,
    ``stage_counts(stage, n)``."""

    stage_counts: DataFrame
    derep: DataFrame
    division: Division
    assigned: DataFrame
    members: DataFrame
    otus: DataFrame
    counts: DataFrame


def build_otus(
    reads: DataFrame,
    params: DivideParams | None = None,
    otu_identity: float = 0.97,
    hit_identity: float = 0.6,
    metric: str = "alignment",
    strand: str = "plus",
    count_centroid: bool = False,
    picker=None,
) -> OtuRun:
    """Dereplicate, divide the abundant reads, assign all reads, pick units and count them.

    ``reads`` holds ``header, read``, in their own letter case, and may have a ``position``: of records
    that repeat a header the last one stays. Reads below the abundance shape no cluster but are
    assigned.
    """
    params = params or DivideParams()
    order = F.col("position") if "position" in reads.columns else None
    derep, stages = dereplicate_counted(reads, params.abundance)
    division = divide(abundant(derep, params.abundance), params)
    searched = materialise(profiles(derep, params.word_size, params.buckets), "searched")
    landmarks = profiles(division.leaf_landmarks, params.word_size, params.buckets)
    nearest = nearest_landmark(searched, landmarks, hit_identity, metric, strand, params.word_size)
    hits = nearest.join(header_sets(reads, derep), "seq_id").select(
        F.explode("headers").alias("header"), cluster_name(F.col("cluster")).alias("cluster"), "seq_id"
    )
    by_header = materialise(dedupe_hits(hits, "seq_id"), "hits")
    assigned = materialise(assign_all(reads_by_header(reads, order), by_header, params.seed), "assigned")
    members, centroids = subcluster(assigned, otu_identity, picker)
    members, otus = materialise(members, "members"), materialise(number_otus(centroids), "otus")
    counts = otu_counts(members, otus if count_centroid else None)
    return OtuRun(stages, derep, division, assigned, members, otus, rename_otus(counts, otus))


def run_to_folders(spark: SparkSession, path: str | list[str], out: str, params: DivideParams | None = None, **options) -> OtuRun:
    """The whole job: FASTA in, and a folder below ``out`` for every result.

    ``derep``, ``partition``, ``landmarks`` and ``centroids`` are FASTA, ``clusters`` has a FASTA folder per
    cluster, ``otu_table`` is the count table of units by samples, ``stage_counts`` tells the records, unique and
    abundant reads.
    """
    raw = read_fasta(spark, path, with_position=True)
    reads = materialise(parse_fasta(raw, fold_case=False), "reads")
    run = build_otus(reads, params, **options)
    write_tsv(run.stage_counts.coalesce(1), f"{out}/stage_counts")  # three rows
    write_derep(header_sets(reads, run.derep), f"{out}/derep")
    write_partition(run.division.labels, f"{out}/partition")
    write_landmarks(run.division.leaf_landmarks, f"{out}/landmarks")
    write_clusters(run.assigned, f"{out}/clusters")
    write_centroids(run.otus, f"{out}/centroids")
    write_counts(run.counts, f"{out}/otu_table", "otu", "sample")
    return run
