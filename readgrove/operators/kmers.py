"""K-mer windows, counts, profiles and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrove.functions.profile import distance_lookup, overlap_distances, token_profile
from readgrove.functions.sequence import BASES, bucket_of, kmers
from readgrove.session import BROADCAST_BYTES, attach, materialise, small


def kmer_windows(seqs: DataFrame, k: int = 8, ambiguous: str = "as_a") -> DataFrame:
    """``seq_id, pos, kmer``: every overlapping window, positions from 0.

    Letters outside the four bases count as A; with ``ambiguous="skip"`` windows that hold one are left out.
    """
    rows = seqs.select("seq_id", "read", F.posexplode(kmers(F.col("read"), k)).alias("pos", "kmer"))
    if ambiguous == "skip":
        rows = rows.where(~F.substr("read", F.col("pos") + 1, F.lit(k)).rlike(f"[^{BASES}{BASES.lower()}]"))
    return rows.drop("read")


def profiles(seqs: DataFrame, k: int = 8, buckets: int = 16, ambiguous: str = "as_a") -> DataFrame:
    """Adds ``profile`` (see ``functions.profile``) and the median ``bucket``.

    Reads shorter than ``k`` have no k-mer and are left out; ``short_reads`` counts them. A read all of
    whose windows are skipped stays, with an empty profile at distance 1 from all others.
    """
    long_enough = seqs.where(F.length("read") >= k)
    return long_enough.withColumn("profile", token_profile(k, ambiguous)("read")).withColumn(
        "bucket", bucket_of(F.col("read"), buckets)
    )


def short_reads(seqs: DataFrame, k: int = 8) -> DataFrame:
    """How many reads ``profiles`` leaves out."""
    return seqs.agg(F.count_if(F.length("read") < k).alias("n_short"))


def kmer_counts(seqs: DataFrame, k: int = 8, ambiguous: str = "as_a") -> DataFrame:
    """``seq_id, kmer, cnt`` for the k-mers a read holds.

    A token whose next occurrence is missing is the last of its k-mer, so its occurrence number
    is the count: nothing is shuffled.
    """
    step = F.lit(4**k).cast("bigint")
    last = F.array_except(
        F.col("profile"), F.transform(F.filter("profile", lambda t: t >= step), lambda t: t - step)
    )
    tokens = profiles(seqs, k, ambiguous=ambiguous).select("seq_id", F.explode(last).alias("token"))
    return tokens.select(
        "seq_id", (F.col("token") % step).alias("kmer"), (F.floor(F.col("token") / step) + 1).alias("cnt")
    )


def landmark_lists(landmarks: DataFrame, key: str = "cluster") -> DataFrame:
    """One row per cluster with its landmarks in order, at most log2 of the cluster size."""
    entry = F.struct("lm_ord", "seq_id", "profile")
    return landmarks.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("lms"))


def measured(members: DataFrame, landmarks: DataFrame) -> DataFrame:
    """``members`` with ``ds``: ``lm_ord, d`` of each landmark of their cluster, in order.

    The landmarks are counted: within the broadcast limit they are sent to every executor once and
    no row moves, else they are joined by cluster. Members of clusters without landmarks are left
    out.
    """
    lists = materialise(landmark_lists(landmarks), "landmark_lists")
    size = F.aggregate("lms", F.lit(0), lambda n, lm: n + F.size(lm["profile"]) + 16)
    n_lists, tokens, most = lists.agg(F.count(F.lit(1)), F.sum(size), F.max(size)).first()
    ords = lists.select("cluster", F.col("lms.lm_ord").alias("ords"))
    if 8 * (tokens or 0) <= BROADCAST_BYTES:
        distances = distance_lookup(lists.withColumn("profiles", F.col("lms.profile")), "cluster", "profiles")
        joined = members.join(small(ords, n_lists, 256), "cluster").withColumn("d", distances("cluster", "profile"))
    else:
        owned = materialise(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster_sizes")
        total = owned.agg(F.sum("size")).first()[0] or 0
        beside = attach(members, lists, ["cluster"], n_lists, 8 * (most or 0) + 256, owned, total)
        joined = beside.withColumn("ords", F.col("lms.lm_ord")).withColumn(
            "d", overlap_distances("cluster", "profile", F.col("lms.profile"))
        ).drop("lms")
    pairs = F.zip_with("ords", "d", lambda o, d: F.struct(o.alias("lm_ord"), d.alias("d")))
    return joined.withColumn("ds", pairs).drop("ords", "d")


def landmark_distances(members: DataFrame, landmarks: DataFrame) -> DataFrame:
    """``seq_id, cluster, lm_ord, d``: distance of each member to each landmark of its cluster."""
    rows = measured(members.select("seq_id", "cluster", "profile"), landmarks)
    return rows.select("seq_id", "cluster", F.inline("ds"))
