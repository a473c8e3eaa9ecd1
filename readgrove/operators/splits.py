"""Splitting clusters in two: landmark graph, radius stop, power-iteration bisection, assignment.

Everything here is keyed by cluster, so all clusters of a tree level are treated by one job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrove.functions.alignment import alignment_distance
from readgrove.functions.profile import overlap_distances
from readgrove.functions.sequence import child_index, depth_of, hash60
from readgrove.session import small


def landmark_graph(landmarks: DataFrame, metric: str = "alignment") -> DataFrame:
    """``cluster, src, dst, weight`` for landmarks ``src < dst`` of a cluster; weight = 1 - distance.

    A cluster of n reads has fewer than log2(n) landmarks, so its pairs are few. Alignment is work
    per pair, not per byte, hence the explicit spread over all cores.
    """
    if metric not in ("alignment", "kmer"):
        raise ValueError(f"unknown metric {metric!r}")
    value = "read" if metric == "alignment" else "profile"
    a = landmarks.select("cluster", F.col("lm_ord").alias("src"), F.col(value).alias("a"))
    b = landmarks.select("cluster", F.col("lm_ord").alias("dst"), F.col(value).alias("b"))
    pairs = a.join(b, "cluster").where(F.col("src") < F.col("dst"))
    if metric == "alignment":
        spread = pairs.repartition(landmarks.sparkSession.sparkContext.defaultParallelism)
        distance = alignment_distance("a", "b")
    else:
        spread = pairs.withColumn("pair", F.monotonically_increasing_id())
        distance = F.get(overlap_distances("pair", "a", F.array("b")), F.lit(0))
    return spread.select(
        "cluster",
        F.col("src").cast("bigint").alias("src"),
        F.col("dst").cast("bigint").alias("dst"),
        (F.lit(1.0) - distance).alias("weight"),
    )


def medoid_radius(edges: DataFrame) -> DataFrame:
    """``cluster, radius``: smallest mean distance of a landmark to the others."""
    ends = F.explode(F.array("src", "dst")).alias("v")
    sums = edges.select("cluster", "weight", ends).groupBy("cluster", "v").agg(
        F.sum(1 - F.col("weight")).alias("total"), F.count(F.lit(1)).alias("others")
    )
    return sums.groupBy("cluster").agg(F.min(F.col("total") / F.col("others")).alias("radius"))


def radius_leaf(edges: DataFrame, radius: float = 0.15) -> DataFrame:
    """``cluster, radius`` of the clusters tight enough to stay whole."""
    return medoid_radius(edges).where(F.col("radius") <= radius)


def _cut(values: np.ndarray) -> np.ndarray | None:
    """Exact two-means of numbers: the side of each, or None where they do not differ."""
    centred = values - values.mean()
    reach = np.abs(centred).max()
    if not reach > 1e-12 * np.abs(values).mean():
        return None
    centred = centred / reach
    order = np.argsort(centred, kind="stable")
    left = np.cumsum(centred[order])[:-1]
    n_left = np.arange(1, len(values))
    gain = left**2 / n_left + left**2 / (len(values) - n_left)
    side = np.empty(len(values), np.int64)
    side[order] = np.arange(len(values)) > gain.argmax()
    return side


def bisect(edges: DataFrame, iterations: int = 10, seed: int = 0) -> DataFrame:
    """``cluster, lm_ord, side`` by power iteration on the row-normalised weights.

    Starts from seeded pseudo-random values, then cuts the one-dimensional embedding by exact
    two-means. Side 0 is the one with the first landmark. Clusters whose landmarks cannot be told
    apart are missing from the result.
    """

    def start(end: str):
        text = F.concat_ws("|", F.lit(f"start|{seed}"), F.col("cluster").cast("string"), F.col(end).cast("string"))
        return (hash60(text) / F.lit(float(1 << 60))).alias(f"{end}_start")

    def one_cluster(key: tuple, graph: pd.DataFrame) -> pd.DataFrame:
        first = graph[["src", "src_start"]].set_axis(["v", "start"], axis=1)
        second = graph[["dst", "dst_start"]].set_axis(["v", "start"], axis=1)
        vertices = pd.concat([first, second]).drop_duplicates("v").sort_values("v")
        names = vertices["v"].to_numpy()
        affinity = np.zeros((len(names), len(names)))
        row, col = np.searchsorted(names, graph["src"]), np.searchsorted(names, graph["dst"])
        affinity[row, col] = affinity[col, row] = graph["weight"]
        degree = affinity.sum(axis=1)
        side = None
        if len(names) > 1 and degree.max() > 0:
            step = affinity / np.where(degree > 0, degree, 1)[:, None]
            values = vertices["start"].to_numpy()
            for _ in range(iterations):
                values = step @ values
                values = values / np.abs(values).sum()
            side = _cut(values)
        if side is None:
            return pd.DataFrame({"cluster": [], "lm_ord": [], "side": []})
        return pd.DataFrame({"cluster": key[0], "lm_ord": names, "side": side ^ side[0]})

    seeded = edges.select("*", start("src"), start("dst"))
    return seeded.groupBy("cluster").applyInPandas(one_cluster, "cluster bigint, lm_ord int, side int")


def bisect_mllib(edges: DataFrame, iterations: int = 10) -> DataFrame:
    """``lm_ord, side`` of one cluster's graph by Spark ML's power iteration clustering."""
    from pyspark.ml.clustering import PowerIterationClustering

    model = PowerIterationClustering(k=2, maxIter=iterations, srcCol="src", dstCol="dst", weightCol="weight")
    found = model.assignClusters(edges.select("src", "dst", "weight"))
    return found.select(F.col("id").cast("int").alias("lm_ord"), F.col("cluster").alias("side"))


def assign_side(measured: DataFrame, sides: DataFrame) -> DataFrame:
    """``seq_id, cluster, side``: the landmark side with the smaller mean distance; ties go left.

    ``measured`` has ``ds`` (see ``kmers.measured``), ``sides`` a row per landmark, a logarithm of
    the reads; the sides of a cluster are one array beside the distances, so no read moves to be
    averaged. Means are rounded to 12 places before they are compared, because sums of doubles
    depend on their order.
    """
    listed = sides.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("lm_ord", "side"))).alias("sides"))
    listed = listed.select("cluster", F.transform("sides", lambda s: s["side"]).alias("sides"))
    joined = measured.join(small(listed, listed.count(), 256), "cluster")
    return joined.select("seq_id", "cluster", side_of(F.col("ds.d"), F.col("sides")).alias("side"))


def side_of(dists, sides):
    """The side of a row's distances, given the sides of the landmarks in the same order."""

    def mean(side: int):
        pairs = F.zip_with(dists, sides, lambda d, s: F.when(s == side, d))
        kept = F.filter(pairs, lambda d: d.isNotNull())
        return F.round(F.aggregate(kept, F.lit(0.0), lambda x, y: x + y) / F.size(kept), 12)

    return F.when(mean(0) <= mean(1), 0).otherwise(1)


def attach_cluster(seqs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels as a column of their reads; both have one row per ``seq_id``."""
    return seqs.join(labels, "seq_id")


def children(assigned: DataFrame) -> DataFrame:
    """``seq_id, cluster`` with the heap number of the child each read moves to."""
    return assigned.select("seq_id", child_index(F.col("cluster"), F.col("side")).alias("cluster"))


def side_summary(sides: DataFrame) -> DataFrame:
    """``child, landmarks``: the landmark numbers that go to each child."""
    child = child_index(F.col("cluster"), F.col("side")).alias("child")
    return sides.groupBy(child).agg(F.sort_array(F.collect_list("lm_ord")).alias("landmarks"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def largest_cluster(sizes: DataFrame) -> DataFrame:
    """The one largest cluster; of equal ones the lowest number."""
    return sizes.orderBy(F.desc("size"), "cluster").limit(1)


def in_cluster(labels: DataFrame, cluster: int) -> DataFrame:
    """Members of one cluster."""
    return labels.where(F.col("cluster") == cluster)


def cluster_tree(sizes: DataFrame) -> DataFrame:
    """``cluster, parent, depth, size`` of every node above and including the given leaves.

    Works on the leaf sizes: each leaf adds its size to its ancestors, one per level.
    """
    levels = F.sequence(F.lit(0), depth_of(F.col("cluster")))
    nodes = F.transform(levels, lambda up: F.call_function("shiftright", F.col("cluster"), up))
    spread = sizes.select(F.explode(nodes).alias("cluster"), "size")
    rolled = spread.groupBy("cluster").agg(F.sum("size").alias("size"))
    parent = F.when(F.col("cluster") > 1, F.shiftright("cluster", 1))
    return rolled.select("cluster", parent.alias("parent"), depth_of(F.col("cluster")).alias("depth"), "size")

