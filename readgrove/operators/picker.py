"""Picking units inside the clusters: length-sorted greedy centroids, or a picker of your own."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from readgrove.functions.bounds import identity_from
from readgrove.functions.profile import list_array, token_profile
from readgrove.session import BROADCAST_BYTES, materialise, materialise_parts, number_rows, release, small, sparing

#: Reads that a picker of one's own gets of each cluster in its first round, and in any.
FIRST_BATCH, LARGEST_BATCH = 32, 1024
#: K-mers that more than this share of all units have come last among a unit's keys; at most that many times a read's k-mers.
COMMON = 64
#: Most misses of a read that is found by segments; longer reads are found by k-mers.
SEGMENTED = 4
#: Units with one segment in common, beyond which they are told apart by k-mers besides.
HOT = 1024
#: Reads of the clusters that are picked at a time, and how many times that is done at most, about.
BATCH_READS, BATCHES = 1 << 21, 64

Picker = Callable[[DataFrame, DataFrame], DataFrame]


def length_rank(reads: DataFrame) -> DataFrame:
    """``rank`` of each read in its cluster: longest first, then by header.

    Numbered over all clusters by one range-partitioned sort, so a cluster is in no single task.
    """
    numbered = number_rows(reads, ["cluster", F.desc(F.length("read")), "header"], "_number")
    first = materialise(numbered.groupBy("cluster").agg(F.min("_number").alias("_first")), "first_numbers")
    ranked = numbered.join(small(first, first.count(), 64), "cluster")
    return ranked.withColumn("rank", (F.col("_number") - F.col("_first") + 1).cast("int")).drop("_number", "_first")


# ---- which reads can be that much alike


def key_size(identity: float) -> int:
    """Letters of the k-mers by which pairs of that identity are found, so that most of them survive the misses."""
    return int(np.clip(0.4 * identity / max(1 - identity, 1e-9), 4, 12))


def _mixed(tokens: np.ndarray) -> np.ndarray:
    h = (tokens.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def pair_keys(identity: float, k: int, common):
    """Column function: (profile, length) -> keys of which two reads of at least ``identity`` share one.

    A read of n letters allows for ``m = n * (1 - identity) / identity`` misses, each of which spoils at
    most k of its w windows, so partners share ``w - k * m`` k-mers and, in any common order, one among
    the first ``k * m + 1``. The order is by hash, with the ``common`` k-mers (a broadcast) last.
    Reads too short for that bound share the key -1 besides; equal reads are not looked for.
    """

    @F.arrow_udf(ArrayType(LongType()))
    def keys(profile: pa.Array, length: pa.Array) -> pa.Array:
        windows = pc.list_value_length(profile).to_numpy(zero_copy_only=False).astype(np.int64)
        misses = np.floor(length.to_numpy(zero_copy_only=False) * (1 - identity) / identity + 1e-9).astype(np.int64)
        tokens = profile.flatten().to_numpy()
        row = np.repeat(np.arange(len(windows)), windows)
        order = np.lexsort((_mixed(tokens), np.isin(tokens, common.value), row))
        tokens, row = tokens[order], row[order]
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(windows) - windows, windows)
        keep = (place <= k * misses[row]) & (misses[row] > 0)
        meets_all = np.flatnonzero((windows < k * misses + 1) & (misses > 0))
        tokens, row = np.concatenate([tokens[keep], np.full(len(meets_all), -1)]), np.concatenate([row[keep], meets_all])
        order = np.argsort(row, kind="stable")
        counts = np.bincount(row, minlength=len(windows))
        return list_array(np.concatenate([[0], np.cumsum(counts)]), tokens[order].astype(np.int64))

    return keys


def misses_of(length: int, identity: float) -> int:
    """Columns without a match that a read of that length allows for."""
    return int(np.floor(length * (1 - identity) / identity + 1e-9))


def segments_of(length: int, identity: float) -> list[tuple[int, int]]:
    """Place and size of a read's segments, one more than it allows for misses, so that a partner has one of them whole."""
    n = misses_of(length, identity) + 1
    ends = [i * length // n for i in range(n + 1)]
    return [(start, stop - start) for start, stop in zip(ends, ends[1:])]


def segment_places(length: int, lengths: list[int], identity: float) -> list[tuple[int, int, int, int]]:
    """``of, nth, at, size``: where a read of that length can hold a whole segment of an earlier one of a length ``of``.

    Of m + 1 segments and at most m misses there is a whole one with no more misses before it than segments before it,
    and none more after it than segments after it: the first with fewer misses up to its end than segments. These bound
    how far it is moved.
    """
    places = []
    for of in lengths:
        if 0 <= of - length <= misses_of(length, identity):
            segments = segments_of(of, identity)
            for nth, (start, size) in enumerate(segments):
                after = len(segments) - 1 - nth
                moves = range(max(-nth, length - of - after), min(nth, length - of + after) + 1)
                places += [(of, nth, start + move, size) for move in moves if 0 <= start + move <= length - size]
    return places


def _segment_keys(units: DataFrame, plan: dict[int, list], kind: str) -> DataFrame:
    """``key, number``: the segments of every unit at the places that ``plan`` has for its length."""
    rows = [(length, [tuple(place) for place in places]) for length, places in plan.items()]
    # a row for each length that allows for few misses
    places = units.sparkSession.createDataFrame(rows, f"length int, {kind} array<struct<of:int,nth:int,at:int,size:int>>")
    placed = units.withColumn("length", F.length("text")).join(F.broadcast(places), "length")
    one = placed.select("number", "cluster", "text", F.explode(kind).alias("place"))
    segment = F.substr("text", F.col("place.at") + 1, F.col("place.size"))
    return one.select(F.xxhash64("cluster", "place.of", "place.nth", segment).alias("key"), "number")


def _narrowed(keys: DataFrame, hot: DataFrame, fine: DataFrame) -> DataFrame:
    """``keys`` with each hot one cut up by the k-mers of its units."""
    cut = keys.join(hot, "key", "left_semi").join(fine.withColumnRenamed("key", "fine"), "number")
    return keys.join(hot, "key", "left_anti").unionByName(cut.select(F.xxhash64("key", "fine").alias("key"), "number"))


class _Keys:
    """The keys a unit is found by, and those by which it finds earlier, so not shorter, ones: ``key, number``.

    A unit that allows for few misses is found by its segments, which are few and tell more than k-mers; of a segment
    that very many have, only those count as found that share one of their k-mers besides. Others are found by k-mers.
    Segments are many and quickly made, so they are made anew for the units asked for and never written.
    """

    def __init__(self, units: DataFrame, n_units: int, identity: float) -> None:
        spans = units.groupBy(F.length("text").alias("length")).agg(F.count(F.lit(1)).alias("n"))
        # lengths of reads that allow for few misses, and whether there are others
        misses = F.floor(F.length("text") * F.lit((1 - identity) / identity) + F.lit(1e-9))
        most = F.floor(F.col("length") * F.lit((1 - identity) / identity) + F.lit(1e-9))
        spans = materialise(spans.withColumn("misses", most), "spans")
        if not spans.where(F.col("length").isNull()).isEmpty():
            raise ValueError("a read without text cannot be compared")
        short = sorted(r["length"] for r in spans.where(F.col("misses").between(1, SEGMENTED)).select("length").collect())
        self.units, self.hot, self.fine, self.long = units, None, None, None
        self.whole = {length: [(length, nth, *place) for nth, place in enumerate(segments_of(length, identity))] for length in short}
        self.places = {length: segment_places(length, short, identity) for length in short}
        whole, places = self._segments(units, self.whole), self._segments(units, self.places)
        self.counts = materialise(whole.groupBy("key").agg(F.min("number").alias("other"), F.count(F.lit(1)).alias("n")), "segment_counts")
        hot = materialise(self.counts.where(F.col("n") > HOT).select("key"), "hot_segments")
        if hot.isEmpty():
            release(hot)
        else:
            some = whole.join(hot, "key", "left_semi").select("number").unionByName(places.join(hot, "key", "left_semi").select("number"))
            fine = materialise(_unit_keys(units.join(some.distinct(), "number", "left_semi"), n_units, identity), "fine_keys")
            self.hot, self.fine = hot, fine
        if not spans.where(F.col("misses") > SEGMENTED).isEmpty():
            # a read that is found by segments can still find one that is found by k-mers
            reach = [n for n in short if misses_of(n + misses_of(n, identity), identity) > SEGMENTED]
            long = units.where((misses > SEGMENTED) | F.length("text").isin(reach))
            self.long = materialise(_unit_keys(long, n_units, identity), "unit_keys")
            others = units.where(~F.length("text").isin(short)).select("number")
            self.found_long = self.long.join(others, "number", "left_semi").select("key", "number")
        release(spans)

    def _segments(self, units: DataFrame, plan: dict[int, list]) -> DataFrame:
        return _segment_keys(units, plan, "whole" if plan is self.whole else "places")

    def _of(self, plan: dict[int, list], long: DataFrame | None, some: DataFrame | None) -> DataFrame:
        keys = self._segments(self.units if some is None else some, plan)
        if self.hot is not None:
            keys = _narrowed(keys, self.hot, self.fine)
        if long is None:
            return keys
        # of one unit there can be very many
        own = long if some is None else long.join(some.select("number"), "number", "left_semi").select("key", "number")
        return keys.unionByName(own)

    def found(self, some: DataFrame | None = None) -> DataFrame:
        """The keys by which all units are found, or some of them."""
        return self._of(self.whole, None if self.long is None else self.found_long, some)

    def asked(self, some: DataFrame | None = None) -> DataFrame:
        """The keys by which all units find earlier ones, or some of them do."""
        return self._of(self.places, self.long, some)

    def first(self) -> DataFrame | None:
        """``key, other``: the first of all units that is found by each key, if that came with their count."""
        return self.counts.select("key", "other") if self.hot is None and self.long is None else None

    def release(self) -> None:
        release(self.counts, *(t for t in (self.hot, self.fine, self.long) if t is not None))


def _unit_keys(units: DataFrame, n_units: int, identity: float) -> DataFrame:
    """``key, number``: the k-mer keys of every unit, told apart by cluster."""
    k = key_size(identity)
    profiled = units.select("number", "cluster", F.length("text").alias("length"), token_profile(k)("text").alias("profile"))
    share = max(2, n_units // COMMON)
    often = profiled.select(F.explode("profile").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
    # at most COMMON k-mers for each k-mer of a read
    common = units.sparkSession.sparkContext.broadcast(np.array([r["token"] for r in often.select("token").collect()], np.int64))
    keyed = profiled.select("number", "cluster", F.explode(pair_keys(identity, k, common)("profile", "length")).alias("token"))
    return keyed.select(F.xxhash64("cluster", "token").alias("key"), "number")


# ---- greedy centroids


def _alike(pairs: DataFrame, texts: DataFrame, identity: float, others: DataFrame | None = None) -> DataFrame:
    """``number, other, identity`` of those distinct pairs that are in one cluster and that much alike.

    ``others`` has the texts of all that are named as ``other``, if they are not sought in ``texts``.
    A unit that many pairs name is unique in ``texts``, so the joins can split it.
    """
    mine = texts.select("number", F.col("cluster").alias("c"), F.col("text").alias("left"))
    others = texts if others is None else others
    theirs = others.select(F.col("number").alias("other"), F.col("cluster").alias("d"), F.col("text").alias("right"))
    beside = pairs.join(mine, "number").join(theirs, "other").where("c = d")
    found = beside.select("number", "other", identity_from(identity)("left", "right").alias("identity"))
    return found.where("identity is not null")


def _batches(reads: DataFrame) -> list[DataFrame]:
    """``reads`` written by whole clusters, so many at a time that what is written to pick from them is bounded.

    A cluster that is larger is a batch by itself.
    """
    sizes = materialise(reads.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster_sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    most = max(BATCH_READS, -(-total // BATCHES))
    if total <= most:
        release(sizes)
        return [materialise(reads, "assigned_reads")]
    # at most twice BATCHES of them
    large = [r["cluster"] for r in sizes.where(F.col("size") > most // 2).select("cluster").collect()]
    number = F.lit(-1)
    for i, cluster in enumerate(large):
        number = F.when(F.col("cluster").eqNullSafe(F.lit(cluster)), i).otherwise(number)
    rest = sizes.where(number < 0).agg(F.sum("size")).first()[0] or 0
    release(sizes)
    parts = max(1, -(-rest // most))
    batch = F.when(number < 0, len(large) + F.pmod(F.xxhash64("cluster"), F.lit(parts))).otherwise(number)
    return materialise_parts(reads.withColumn("batch", batch.cast("int")), "batch", "assigned_reads")


def greedy_centroids(assigned: DataFrame, identity: float = 0.97) -> tuple[DataFrame, DataFrame]:
    """Greedy clustering of every cluster: ``members`` and ``centroids``.

    Reads come longest first, then by header. A read joins the earliest centroid with at least
    ``identity``, else it becomes one. ``assigned`` holds ``cluster, header, read`` with distinct
    headers. Returns ``members(cluster, query, target, identity)``, without the centroids
    themselves, and ``centroids(cluster, centroid, read)``.

    A read is a centroid if and only if no earlier centroid is that much alike. So in a round all open reads
    without an earlier open read alike become centroids at once, and all reads alike to these are
    settled: the rounds follow chains of reads alike, not the number of centroids, and the result is
    the sequential one. Reads alike share a key (``_Keys``). Each is first compared with the
    first open read of its keys, which settles groups of any size without their pairs; only reads that
    found none are compared with all earlier ones of their keys. Equal reads are one unit.

    Clusters do not meet, so they are picked in batches; both tables are written, and all others deleted.
    """
    named = assigned.select(F.col("cluster").cast("string").alias("cluster"), "header", "read")
    with sparing(assigned.sparkSession):
        picked = [_pick(reads, identity) for reads in _batches(named)]
    members, centroids = zip(*picked, strict=True)
    return reduce(DataFrame.unionByName, members), reduce(DataFrame.unionByName, centroids)


def _pick(reads: DataFrame, identity: float) -> tuple[DataFrame, DataFrame]:
    """``members`` and ``centroids`` of whole clusters, whose ``reads`` are deleted."""
    text = F.upper("read")
    # the text of a unit is that of its read
    units = reads.groupBy(text.alias("text"), "cluster").agg(F.min(F.struct("header", "read")).alias("first"))
    unique = materialise(units.select("cluster", "first.header", "first.read"), "unique")
    # numbers only have to be in order
    ordered = unique.withColumn("length", F.length(text)).orderBy("cluster", F.desc("length"), "header").drop("length")
    units = materialise(ordered.withColumn("number", F.monotonically_increasing_id()), "units")
    release(unique)
    texts = units.select("number", "cluster", text.alias("text"))
    keys = _Keys(texts, units.count(), identity)

    open_units, open_numbers = None, units.select("number")
    heads, settled = [], []
    while True:
        scratch = [] if open_units is None else [open_units, open_numbers]

        def kept(df: DataFrame, name: str) -> DataFrame:
            scratch.append(materialise(df, name))
            return scratch[-1]

        # the first open read of each key; of those of its own segments a read is compared with the earliest
        leaders = keys.first() if open_units is None else None
        if leaders is None:
            leaders = kept(keys.found(open_units).groupBy("key").agg(F.min("number").alias("other")), "leaders")
        led = keys.found(open_units).join(leaders, "key").where("other < number").groupBy("number").agg(F.min("other").alias("other"))
        led = kept(led, "led")
        named = kept(led.select(F.col("other").alias("number")).distinct(), "named")
        few = named.count() * 64 <= BROADCAST_BYTES
        others = texts.join(F.broadcast(named), "number", "left_semi") if few else texts
        compared, alike = led, kept(_alike(led, texts, identity, others), "held")
        free = kept(open_numbers.join(alike, "number", "left_anti"), "free")
        # those not alike to it, with the first open read of all of their keys
        free_texts = kept(texts.join(small(free, free.count(), 64), "number", "left_semi"), "free_texts")
        asks = kept(keys.asked(free_texts).join(leaders, "key").where("other < number"), "asks")
        led = kept(asks.select("number", "other").distinct().join(compared, ["number", "other"], "left_anti"), "led")
        if not led.isEmpty():
            held = kept(_alike(led, texts, identity), "held")
            compared, alike = compared.unionByName(led), alike.unionByName(held)
            free = kept(free.join(held, "number", "left_anti"), "free")
        # those that found none, against all earlier ones
        asks = kept(asks.join(free, "number", "left_semi").select("key", "number"), "asks")
        if not asks.isEmpty():
            beside = keys.found(open_units).withColumnRenamed("number", "other")
            rest = asks.join(beside, "key").where("other < number").select("number", "other").distinct()
            rest = kept(rest.join(compared, ["number", "other"], "left_anti"), "rest")
            held = kept(_alike(rest, texts, identity), "held")
            alike, free = alike.unionByName(held), free.join(held, "number", "left_anti")
        centroids = kept(free, "round_centroids")
        heads.append(materialise(units.join(small(centroids, centroids.count(), 64), "number", "left_semi"), "heads"))
        # whoever is alike to one of them; a read settled before may find an earlier centroid
        head_texts = heads[-1].select("number", "cluster", text.alias("text"))
        known = alike.join(centroids.withColumnRenamed("number", "other"), "other", "left_semi")
        known = kept(known.select("number", "other", "identity"), "known")
        before = reduce(DataFrame.unionByName, settled, known).groupBy("number").agg(F.min("other").alias("earliest"))
        near = keys.asked().join(keys.found(head_texts).withColumnRenamed("number", "other"), "key").where("other < number")
        near = near.select("number", "other").distinct().join(before, "number", "left").where("earliest is null or earliest > other")
        near = kept(near.drop("earliest"), "near")
        settled.append(materialise(_alike(near, texts, identity, head_texts).unionByName(known), "settled"))
        done = settled[-1].select("number").unionByName(centroids).distinct()
        left = materialise(open_numbers.join(done, "number", "left_anti"), "open")
        release(*scratch)
        open_numbers = left
        if open_numbers.isEmpty():
            release(open_numbers)
            break
        open_units = materialise(texts.join(open_numbers, "number", "left_semi"), "open_units")

    keys.release()
    chosen = reduce(DataFrame.unionByName, heads)
    # a handful of centroids for each unit
    every = reduce(DataFrame.unionByName, settled).groupBy("number").agg(F.array_min(F.collect_list(F.struct("other", "identity"))).alias("best"))
    targets = every.select("number", F.col("best.other").alias("target_number"), "best.identity")
    targets = targets.unionByName(chosen.select("number", F.col("number").alias("target_number"), F.lit(1.0).alias("identity")))
    uid = F.unhex(F.md5(text)).alias("uid")
    names = chosen.select(F.col("number").alias("target_number"), F.col("header").alias("target"))
    placed = targets.join(units.select("number", "cluster", uid), "number").join(names, "target_number")
    placed = materialise(placed.select("cluster", "uid", "target", "identity"), "placed")
    release(units, *settled)
    # a unit is once in ``placed``, so one of very many equal reads can be split
    members = reads.select("cluster", uid, "header").join(placed, ["uid", "cluster"]).where(F.col("header") != F.col("target"))
    members = materialise(members.select("cluster", F.col("header").alias("query"), "target", "identity"), "picked_members")
    centroids = materialise(chosen.select("cluster", F.col("header").alias("centroid"), "read"), "picked_centroids")
    release(reads, placed, *heads)
    return members, centroids


# ---- a picker of one's own


def pick_in_rounds(assigned: DataFrame, picker: Picker) -> tuple[DataFrame, DataFrame]:
    """Units by a picker that works on DataFrames, a bounded head of every cluster at a time.

    Reads come longest first, then by header. In each round ``picker(heads, open_reads)`` gets the first
    open reads of every cluster, twice as many as before up to ``LARGEST_BATCH``, and all open reads,
    both as ``cluster, header, read, rank``. It returns claims ``cluster, query, target, identity``:
    at least one for every head, which is its own target if it is a centroid, and any for other open reads.
    Of several targets the one of the lowest rank counts. Claimed reads are not open any more. No cluster is
    ever in one task unless the picker puts it there.
    """
    named = assigned.select(F.col("cluster").cast("string").alias("cluster"), "header", "read")
    ranked = materialise(length_rank(named), "ranked")
    order = Window.partitionBy("cluster").orderBy("rank")
    ranks = ranked.select("cluster", F.col("header").alias("target"), F.col("rank").alias("target_rank"))
    open_reads, claimed, batch = ranked, [], FIRST_BATCH
    while True:
        # the rank limit is applied before the shuffle, so a hot cluster sends few rows
        heads = open_reads.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= batch).drop("_nth")
        heads = materialise(heads, "heads")
        if heads.isEmpty():
            break
        claims = picker(heads, open_reads).select(F.col("cluster").cast("string").alias("cluster"), "query", "target", F.col("identity").cast("double").alias("identity"))
        claims = claims.join(open_reads.select("cluster", F.col("header").alias("query")), ["cluster", "query"], "left_semi")
        # the targets by themselves: one of very many claims is ranked once
        targets = materialise(claims.select("cluster", "target").distinct().join(ranks, ["cluster", "target"]), "targets")
        longest = targets.agg(F.max(F.length("cluster") + F.length("target"))).first()[0] or 0
        claims = claims.join(small(targets, targets.count(), 64 + 4 * longest), ["cluster", "target"])
        first = F.array_min(F.collect_list(F.struct("target_rank", "target", "identity"))).alias("first")
        claims = claims.groupBy("cluster", "query").agg(first).select("cluster", "query", "first.target", "first.identity")
        claims = materialise(claims, "claims")
        taken = claims.select("cluster", F.col("query").alias("header"))
        missing = heads.join(taken, ["cluster", "header"], "left_anti").first()
        if missing is not None:
            raise ValueError(f"the picker left the head {missing['header']!r} of cluster {missing['cluster']!r} without a claim")
        claimed.append(claims)
        open_reads = materialise(open_reads.join(taken, ["cluster", "header"], "left_anti"), "open_reads")
        batch = min(2 * batch, LARGEST_BATCH)

    if not claimed:
        empty = "cluster string, query string, target string, identity double"
        claimed = [assigned.sparkSession.createDataFrame([], empty)]
    picked = reduce(DataFrame.unionByName, claimed)
    own = picked.where(F.col("query") == F.col("target")).select("cluster", F.col("target").alias("header"))
    centroids = named.join(own, ["cluster", "header"], "left_semi").select("cluster", F.col("header").alias("centroid"), "read")
    return picked.where(F.col("query") != F.col("target")), centroids


def subcluster(assigned: DataFrame, identity: float = 0.97, picker: Picker | None = None) -> tuple[DataFrame, DataFrame]:
    """Pick units in every cluster with the built-in greedy rule, or with ``picker`` in rounds."""
    return greedy_centroids(assigned, identity) if picker is None else pick_in_rounds(assigned, picker)
