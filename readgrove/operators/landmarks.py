"""Active landmark selection: few, far-apart reads that stand for a cluster.

All clusters of a tree level advance together, one landmark per step. A step reads the members
once: their distances collapse on the map side into a histogram per (cluster, bucket, distance)
that also keeps the smallest pick key of each cell. Medians, threshold and pick all come from the
histogram, whose size does not grow with the reads.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readgrove.functions.bounds import read_distances, read_lookup
from readgrove.functions.profile import distance_lookup, read_overlaps, token_profile
from readgrove.functions.sequence import pick_key
from readgrove.session import BROADCAST_BYTES, attach, materialise, small


def pick_one(df: DataFrame, by: str, seed: int, lm_ord: int = 0) -> DataFrame:
    """One pseudo-random row per ``by``: the smallest key, then the smallest ``seq_id``.

    The long key keeps the aggregation hash based, and only the matching rows are kept for ties.
    """
    keyed = df.withColumn("pick", pick_key(seed, F.col(by), lm_ord, F.col("seq_id")))
    lowest = keyed.groupBy(by).agg(F.min("pick").alias("pick"))
    tied = keyed.join(lowest, [by, "pick"])
    return tied.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("seq_id"))).where(
        F.col("rank") == 1
    ).drop("rank", "pick")


def _upper_median(cell: DataFrame, keys: list[str], value: str, count: str) -> DataFrame:
    """Marks the cell that holds element ``n div 2`` of the ascending values of its group."""
    group = Window.partitionBy(*keys)
    upto = F.sum(count).over(group.orderBy(value))
    middle = F.floor(F.sum(count).over(group) / 2)
    return cell.withColumn("is_median", (upto > middle) & (upto - F.col(count) <= middle))


def bucket_median(dist: DataFrame, value: str = "d") -> DataFrame:
    """``cluster, bucket, median``: the upper median of every non-empty bucket.

    Counted as a histogram first, so a hot bucket shrinks on the map side.
    """
    cells = dist.groupBy("cluster", "bucket", value).agg(F.count(F.lit(1)).alias("n"))
    marked = _upper_median(cells, ["cluster", "bucket"], value, "n").where("is_median")
    return marked.select("cluster", "bucket", F.col(value).alias("median"))


def median_of_medians(medians: DataFrame) -> DataFrame:
    """``cluster, mom``: upper median of the bucket medians, unweighted."""
    ordered = F.sort_array(F.collect_list("median"))
    listed = medians.groupBy("cluster").agg(ordered.alias("medians"))
    return listed.select("cluster", F.get("medians", F.floor(F.size("medians") / 2).cast("int")).alias("mom"))


def min_distance(measured: DataFrame) -> DataFrame:
    """Adds ``d_min`` to rows with ``ds`` (see ``kmers.measured``): distance to the landmark set, at most 1."""
    return measured.withColumn("d_min", F.least(F.array_min("ds.d"), F.lit(1.0)))


def _thresholds(cells: DataFrame) -> DataFrame:
    """``cluster, ord, mom, pick`` from histogram cells.

    Medians are found per cluster and bucket, the key the cells are already dealt by; only one
    row per bucket then meets by cluster.
    """
    marked = _upper_median(cells, ["cluster", "bucket"], "d_min", "n")
    moms = median_of_medians(marked.where("is_median").select("cluster", "bucket", F.col("d_min").alias("median")))
    far = cells.join(moms, "cluster").where(F.col("d_min") >= F.col("mom"))
    return far.groupBy("cluster").agg(F.min("ord").alias("ord"), F.min("pick").alias("pick"))


@dataclass(frozen=True)
class Extent:
    """Counted size of the work: clusters, most landmarks of one, their reads, longest read."""

    clusters: int
    landmarks: int
    reads: int
    longest: int

    @staticmethod
    def of(active: DataFrame, longest: int) -> "Extent":
        counted = active.agg(F.count(F.lit(1)), F.max("m"), F.sum("size")).first()
        return Extent(counted[0], counted[1] or 0, counted[2] or 0, longest)


@dataclass(frozen=True)
class _Rule:
    k: int
    seed: int
    carry: int
    distinct: bool
    metric: str
    ambiguous: str


def _beside(members: DataFrame, lists: DataFrame, done: int, extent: Extent, rule: _Rule, measure: bool = True, exact: bool = True) -> DataFrame:
    """Members with ``fresh``: distances to the landmarks of their cluster not among their ``dists`` yet.

    If not ``exact``, alignment distances above ``d_min`` may come as 1, so that most pairs need no alignment.

    The new landmarks of all clusters, at most ``carry`` of each, go to every executor once while
    their counted bytes allow it. A row holds its read; its profile is made where it is compared, since
    that takes less than to write and read the profile.
    """
    aligned = rule.metric == "alignment"
    most = F.lit(1.0) if exact else F.col("d_min")
    shown = F.transform(F.slice("lms", done + 1, extent.landmarks + 1), lambda lm: lm["read" if aligned else "profile"])
    columns = ["cluster", F.size("lms").alias("ord")]
    if rule.distinct:
        columns.append(F.transform("lms", lambda lm: lm["seq_id"]).alias("chosen"))
    per_cluster = 8 * extent.longest * min(rule.carry, max(1, extent.landmarks))
    lookup = measure and extent.clusters * per_cluster <= BROADCAST_BYTES
    if measure and not lookup:
        columns.append(shown.alias("fresh"))
    row_bytes = 256 + (per_cluster if measure and not lookup else 0)
    joined = attach(members, lists.select(*columns), ["cluster"], extent.clusters, row_bytes, lists, extent.reads)
    if lookup:
        shown = lists.select("cluster", shown.alias("fresh"))
        if aligned:
            return joined.withColumn("fresh", read_lookup(shown, "cluster", "fresh")("cluster", "read", most))
        return joined.withColumn("fresh", distance_lookup(shown, "cluster", "fresh", rule.k, rule.ambiguous)("cluster", "read"))
    if measure and aligned:
        return joined.withColumn("fresh", read_distances("read", "fresh", most))
    if measure:
        return joined.withColumn("fresh", read_overlaps(rule.k, rule.ambiguous)("cluster", "read", "fresh"))
    return joined


def _pick_next(members: DataFrame, lists: DataFrame, done: int, step: int, extent: Extent, rule: _Rule) -> DataFrame:
    """Landmark lists with one more landmark in every cluster that is still short of its number.

    The step number is read from the lists, so that all steps share their generated code.
    """
    joined = _beside(members, lists.where(F.col("m") > F.size("lms")), done, extent, rule, step > done, exact=False)
    key = pick_key(rule.seed, F.col("cluster"), F.col("ord"), F.col("seq_id"))
    d_min = F.col("d_min")
    if step > done:
        d_min = F.least("d_min", F.array_min("fresh"))
    pick = F.when(~F.array_contains("chosen", F.col("seq_id")), key) if rule.distinct else key
    scored = joined.select("cluster", "ord", "bucket", d_min.alias("d_min"), pick.alias("pick"))
    if step == 0:
        found = scored.groupBy("cluster").agg(F.min("ord").alias("ord"), F.min("pick").alias("pick"))
    else:
        cells = scored.groupBy("cluster", "bucket", "d_min").agg(
            F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"), F.min("pick").alias("pick")
        )
        found = _thresholds(cells)

    # a second, narrow read of the members fetches the picked ones
    narrow = members.select("seq_id", "read", "cluster")
    matched = attach(narrow, found, ["cluster"], extent.clusters, 64, lists, extent.reads).where(
        F.col("pick") == key
    )
    new = matched.groupBy("cluster").agg(F.min(F.struct("seq_id", "read")).alias("new"))
    landmark = F.struct("new.seq_id", "new.read", token_profile(rule.k, rule.ambiguous)("new.read").alias("profile"))
    new = new.select("cluster", landmark.alias("new"))
    grown = F.when(F.col("new").isNotNull(), F.array_append("lms", F.col("new"))).otherwise(F.col("lms"))
    new = small(new, extent.clusters, 256 + 10 * extent.longest)
    return lists.join(new, "cluster", "left").select("cluster", "size", "m", grown.alias("lms"))


def _absorb(members: DataFrame, lists: DataFrame, done: int, extent: Extent, rule: _Rule) -> DataFrame:
    """Members with the distances to all landmarks so far in ``dists`` and ``d_min``."""
    measured = _beside(members, lists, done, extent, rule)
    return measured.select(
        "seq_id",
        "read",
        "bucket",
        "cluster",
        F.concat("dists", "fresh").alias("dists"),
        F.least("d_min", F.array_min("fresh")).alias("d_min"),
    )


def select_landmarks(
    members: DataFrame,
    active: DataFrame,
    extent: Extent,
    k: int = 8,
    seed: int = 0,
    carry: int = 8,
    distinct_landmarks: bool = False,
    metric: str = "kmer",
    ambiguous: str = "as_a",
) -> tuple[DataFrame, DataFrame]:
    """Landmarks of every active cluster, and the distances of the members to them.

    Distances are of k-mers or, with ``metric="alignment"``, of alignments; then while landmarks are chosen
    only pairs are aligned that edit distance and length do not show to be farther than the nearest one.

    ``members`` holds ``seq_id, read, bucket, cluster``, ``active`` a row ``cluster, size,
    m`` per cluster to treat. The first landmark is any member; each next one is any member whose
    distance to those chosen is at least the median of the bucket medians. Returns
    ``landmarks(cluster, lm_ord, seq_id, read, profile)`` and the members of the active clusters
    with ``dists`` in landmark order. A cluster has ``m`` landmarks and as many distances.

    A step measures the landmarks since the last write anew, at most ``carry`` of them; then the
    distances are written beside the members.
    """
    if metric not in ("alignment", "kmer"):
        raise ValueError(f"unknown metric {metric!r}")
    rule = _Rule(k, seed, carry, distinct_landmarks, metric, ambiguous)
    kept = ["seq_id", "read", "bucket", "cluster"]
    members = members.select(*kept, F.array().cast("array<double>").alias("dists"), F.lit(1.0).alias("d_min"))
    empty = F.array().cast("array<struct<seq_id:string,read:string,profile:array<bigint>>>")
    lists = active.select("cluster", "size", "m", empty.alias("lms"))
    done = 0
    for step in range(extent.landmarks):
        if step - done >= carry:
            members = materialise(_absorb(members, lists, done, extent, rule), "members")
            done = step
        lists = materialise(_pick_next(members, lists, done, step, extent, rule), "landmarks")
    measured = _absorb(members, lists, done, extent, rule).drop("d_min")
    listed = lists.select("cluster", F.posexplode("lms").alias("lm_ord", "lm"))
    return listed.select("cluster", "lm_ord", "lm.seq_id", "lm.read", "lm.profile"), measured
