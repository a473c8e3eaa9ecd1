"""Active divisive clustering: split the largest cluster until a stop rule holds.

A split depends only on the members of its cluster, because picks are keyed by cluster and
landmark number. So whole batches of clusters are split by the same Spark jobs, and "largest
first" is replayed afterwards on the sizes. Without a leaf target every cluster that can be split
is split, no order matters, and the control tables stay on the cluster. With a target the replay
needs at most about that many sizes on the driver.

Reads are never moved: a round reads its clusters' rows, adds the child number, and writes them
once, without their k-mer profiles, which are made where reads are compared. What a round needs only for
itself is deleted at its end. A read's label is its row in the last round whose cluster stayed a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrove.functions.sequence import child_index, landmark_count, landmark_quota
from readgrove.operators.kmers import profiles
from readgrove.operators.landmarks import Extent, select_landmarks
from readgrove.operators.splits import bisect, landmark_graph, medoid_radius, side_of
from readgrove.session import attach, materialise, scratch_scope

#: Clusters from this number on stay leaves: their children's numbers would not fit a bigint.
DEEPEST = 1 << 61

RADIUS, SPLIT, SAME, ONE_SIDED, SMALL = "radius", "split", "inseparable", "one_sided", "small"


@dataclass(frozen=True)
class DivideParams:
    """Parameters of the clustering, with their accepted ranges."""

    word_size: int = 8
    abundance: int = 2
    radius: float = 0.15
    min_size: int = 100
    num_leaves: int = 0
    iterations: int = 10
    seed: int = 0
    buckets: int = 16
    graph_metric: str = "alignment"
    member_metric: str = "kmer"
    ambiguous: str = "as_a"
    distinct_landmarks: bool = False
    carry: int = 8

    def __post_init__(self):
        for name, good in {
            "word_size": 0 < self.word_size < 16,
            "abundance": self.abundance > 0,
            "radius": 0 < self.radius < 1,
            "min_size": self.min_size >= 0,
            "num_leaves": self.num_leaves >= 0,
            "iterations": self.iterations > 0,
        }.items():
            if not good:
                raise ValueError(f"{name} out of range: {getattr(self, name)}")


@dataclass
class Round:
    """What one batch of splits left behind, as shared tables."""

    decisions: DataFrame  # cluster, size, radius, status, left_size, right_size
    landmarks: DataFrame  # cluster, lm_ord, seq_id, read, side
    parts: DataFrame  # seq_id, read, bucket, cluster (a child number)


@dataclass
class Division:
    """Result: ``labels(seq_id, read, cluster)``, ``leaf_landmarks(cluster, lm_ord, seq_id, read)``,
    ``tree(cluster, size, radius, status, is_leaf)``."""

    labels: DataFrame
    leaf_landmarks: DataFrame
    tree: DataFrame
    rounds: list[Round] = field(default_factory=list)


def split(members: DataFrame, active: DataFrame, extent: Extent, params: DivideParams) -> Round:
    """Split every cluster of ``active(cluster, size, m)`` once; ``members`` may hold others too."""
    with scratch_scope(members.sparkSession):
        return _split(members, active, extent, params)


def _split(members: DataFrame, active: DataFrame, extent: Extent, params: DivideParams) -> Round:
    landmarks, measured = select_landmarks(
        members, active, extent, params.word_size, params.seed, params.carry, params.distinct_landmarks, params.member_metric, params.ambiguous
    )
    edges = materialise(landmark_graph(landmarks, params.graph_metric), "edges")
    sides = bisect(edges, params.iterations, params.seed)
    listed = sides.groupBy("cluster").agg(
        F.sort_array(F.collect_list(F.struct("lm_ord", "side"))).alias("sides")
    )
    status = F.when(F.col("radius") <= params.radius, RADIUS).when(F.col("sides").isNull(), SAME).otherwise(SPLIT)
    verdict = materialise(
        active.select("cluster", "size")
        .join(medoid_radius(edges), "cluster", "left")
        .join(listed, "cluster", "left")
        .withColumn("status", status),
        "verdicts",
    )

    cut = verdict.where(F.col("status") == SPLIT).select(
        "cluster", F.transform("sides", lambda s: s["side"]).alias("sides")
    )
    joined = attach(measured, cut, ["cluster"], extent.clusters, 1024, verdict, extent.reads)
    child = child_index(F.col("cluster"), side_of(F.col("dists"), F.col("sides")))
    parts = materialise(
        joined.select("seq_id", "read", "bucket", child.alias("cluster")), "parts", keep=True
    )

    # a split that moves every read to one side is none
    moved = parts.groupBy(F.shiftright("cluster", 1).alias("cluster")).agg(
        F.count_if(F.col("cluster") % 2 == 0).alias("left_size"),
        F.count_if(F.col("cluster") % 2 == 1).alias("right_size"),
    )
    one_sided = (F.col("left_size") == 0) | (F.col("right_size") == 0)
    decisions = verdict.join(moved, "cluster", "left").select(
        "cluster",
        "size",
        "radius",
        F.when(one_sided, ONE_SIDED).otherwise(F.col("status")).alias("status"),
        "left_size",
        "right_size",
    )
    side = F.get("sides", F.col("lm_ord"))["side"].alias("side")
    sided = landmarks.join(verdict.select("cluster", "sides"), "cluster").select(
        "cluster", "lm_ord", "seq_id", "read", side
    )
    return Round(materialise(decisions, "decisions", keep=True), materialise(sided, "sided_landmarks", keep=True), parts)


def _divisible(sizes: DataFrame, params: DivideParams) -> DataFrame:
    """``cluster, size, m`` of the clusters above the minimum size that get two landmarks or more.

    A cluster at level 61 stays a leaf, so a lopsided tree ends there instead of failing.
    """
    quota = sizes.select("cluster", "size", landmark_count(F.col("size")).alias("m"))
    wanted = (F.col("size") > params.min_size) & (landmark_quota(F.col("size")) > 2)
    return quota.where(wanted & (F.col("cluster") < F.lit(DEEPEST)))


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _children(decisions: DataFrame) -> DataFrame:
    """``cluster, size`` of the children of real splits."""
    both = F.array(
        F.struct((F.col("cluster") * 2).alias("cluster"), F.col("left_size").alias("size")),
        F.struct((F.col("cluster") * 2 + 1).alias("cluster"), F.col("right_size").alias("size")),
    )
    return decisions.where(F.col("status") == SPLIT).select(F.inline(both))


def _replay(known: dict, sizes: dict, params: DivideParams) -> tuple[dict, set, list]:
    """Largest-first order over what is known: final leaves, visited clusters, clusters to split next."""
    leaves, open_, visited = {1: sizes[1]}, {1}, set()
    while open_ and len(leaves) < params.num_leaves:
        largest = max(open_, key=lambda c: (leaves[c], -c))
        if leaves[largest] <= params.min_size:
            break
        if largest not in known:
            wanted = sorted((c for c in open_ if c not in known and leaves[c] > params.min_size),
                            key=lambda c: (-leaves[c], c))
            return leaves, visited, wanted[: max(1, params.num_leaves - len(leaves))]
        open_.discard(largest)
        visited.add(largest)
        if known[largest] == SPLIT:
            del leaves[largest]
            for child in (2 * largest, 2 * largest + 1):
                leaves[child] = sizes[child]
                open_.add(child)
    return leaves, visited, []


def _grow_all(start, root_size, n, longest, params):
    """Split everything that can be split. Rounds, leaves per table of reads, and no visit list."""
    rounds: list[Round] = []
    born = [root_size]
    active = _divisible(root_size, params)
    extent = Extent.of(active, longest)
    while extent.clusters:
        rounds.append(split(rounds[-1].parts if rounds else start, active, extent, params))
        born.append(_children(rounds[-1].decisions))
        active = _divisible(born[-1], params)
        extent = Extent.of(active, longest)
    leaf_tables = [
        sizes.join(r.decisions.where(F.col("status") == SPLIT), "cluster", "left_anti")
        for sizes, r in zip(born, rounds)
    ] + [born[-1]]
    return rounds, leaf_tables, None


def _numbers(spark, clusters: list[int]) -> DataFrame:
    """A table of clusters to split, at most as many as the leaf target."""
    return spark.createDataFrame([(c,) for c in clusters], "cluster bigint")


def _grow_to_target(start, root_size, n, longest, params):
    """Split in batches until the replay asks for no more. The same result as ``_grow_all``.

    Collects the outcome of each asked-for split: their number is bounded by the leaf target.
    """
    spark = start.sparkSession
    rounds: list[Round] = []
    known: dict[int, str] = {}
    sizes, home = {1: n}, {1: 0}
    leaves, visited, wanted = _replay(known, sizes, params)
    while wanted:
        asked = spark.createDataFrame([(c, sizes[c]) for c in wanted], "cluster bigint, size bigint")
        active = _divisible(asked, params)
        extent = Extent.of(active, longest)
        known.update(dict.fromkeys(wanted, SMALL))
        if extent.clusters:
            # clusters of several rounds can be due together; each is read from its own table
            tables = [start] + [r.parts for r in rounds]
            due = [
                tables[at].join(F.broadcast(_numbers(spark, [c for c in wanted if home[c] == at])), "cluster", "left_semi")
                for at in sorted({home[c] for c in wanted})
            ]
            rounds.append(split(_all(due), active, extent, params))
            for row in rounds[-1].decisions.collect():
                known[row["cluster"]] = row["status"]
                for child, size in ((0, row["left_size"]), (1, row["right_size"])):
                    sizes[2 * row["cluster"] + child] = size
                    home[2 * row["cluster"] + child] = len(rounds)
        leaves, visited, wanted = _replay(known, sizes, params)
    leaf_tables = [
        spark.createDataFrame([(c, s) for c, s in leaves.items() if s and home[c] == at], "cluster bigint, size bigint")
        for at in range(len(rounds) + 1)
    ]
    return rounds, leaf_tables, spark.createDataFrame([(c,) for c in visited], "cluster bigint")


def divide(seqs: DataFrame, params: DivideParams | None = None) -> Division:
    """Cluster ``seqs(seq_id, read)``, the abundant unique reads."""
    params = params or DivideParams()
    spark = seqs.sparkSession
    root = profiles(seqs.select("seq_id", "read"), params.word_size, params.buckets, params.ambiguous)
    # in files by its own size: every step of every round has a task for each
    start = materialise(root.drop("profile").withColumn("cluster", F.lit(1).cast("bigint")).hint("rebalance"), "root")
    n, longest = start.agg(F.count(F.lit(1)), F.max(F.length("read"))).first()
    root_size = spark.createDataFrame([(1, n)] if n else [], "cluster bigint, size bigint")
    grow = _grow_all if params.num_leaves == 0 else _grow_to_target
    rounds, leaf_tables, visited = grow(start, root_size, n, longest or 0, params)

    tables = [start] + [r.parts for r in rounds]
    labels = _all(
        [p.select("seq_id", "read", "cluster").join(t, "cluster", "left_semi") for p, t in zip(tables, leaf_tables)]
    ).select("seq_id", "read", "cluster")
    leaves_df = _all(leaf_tables)
    decisions = _all([r.decisions for r in rounds]) if rounds else spark.createDataFrame(
        [], "cluster bigint, size bigint, radius double, status string"
    )
    if visited is not None:
        decisions = decisions.join(visited, "cluster", "left_semi")
    tree = _tree(leaves_df, decisions)
    return Division(labels, _leaf_landmarks(start, root_size, longest or 0, rounds, tree, params), tree, rounds)


def _tree(leaves: DataFrame, decisions: DataFrame) -> DataFrame:
    """``cluster, size, radius, status, is_leaf`` of every inner node and leaf."""
    inner = decisions.where(F.col("status") == SPLIT).select(
        "cluster", "size", "radius", "status", F.lit(False).alias("is_leaf")
    )
    stopped = decisions.where(F.col("status") != SPLIT).select("cluster", "radius", "status")
    ends = leaves.join(stopped, "cluster", "left").select(
        "cluster", "size", "radius", F.coalesce("status", F.lit("unsplit")).alias("status"), F.lit(True).alias("is_leaf")
    )
    return materialise(inner.unionByName(ends), "tree")


def _leaf_landmarks(start, root_size, longest, rounds, tree, params) -> DataFrame:
    """A radius leaf has its own landmarks; any other leaf its side of its parent's.

    An unsplit root has no parent, so its landmarks are picked here.
    """
    columns = ["cluster", "lm_ord", "seq_id", "read"]
    ends = tree.where("is_leaf").select("cluster", "status")
    if not rounds:
        active = root_size.select("cluster", "size", landmark_count(F.col("size")).alias("m"))
        landmarks, _ = select_landmarks(
            start, active, Extent.of(active, longest), params.word_size, params.seed, params.carry, params.distinct_landmarks,
            params.member_metric, params.ambiguous,
        )
        return materialise(landmarks.select(*columns), "leaf_landmarks")
    chosen = _all([r.landmarks for r in rounds])
    own = ends.where((F.col("status") == RADIUS) | (F.col("cluster") == 1)).select("cluster")
    kept = chosen.join(own, "cluster", "left_semi").select(*columns)
    others = ends.join(own, "cluster", "left_anti").select("cluster")
    passed = chosen.where(F.col("side").isNotNull()).withColumn(
        "cluster", child_index(F.col("cluster"), F.col("side"))
    )
    inherited = passed.join(others, "cluster", "left_semi").select(*columns)
    return materialise(kept.unionByName(inherited), "leaf_landmarks")
