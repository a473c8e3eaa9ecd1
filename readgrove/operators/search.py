"""Nearest leaf landmark of every unique read, abundant or not, on one strand or both."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from readgrove.functions.alignment import align_batch
from readgrove.functions.bounds import COUNTED, edit_distances, least_misses, most_identity
from readgrove.functions.profile import token_profile
from readgrove.functions.sequence import reverse_complement
from readgrove.session import BROADCAST_BYTES, materialise

TOKEN_BYTES = 16
#: Cells of the table of k-mers in common, reads by landmarks, that are counted at once.
CELLS = 1 << 22
PLUS, MINUS = "+", "-"


@dataclass
class Index:
    """Landmarks by cluster and number, and for each token the landmarks that have it."""

    clusters: list
    lm_ord: np.ndarray
    reads: list[str]
    length: np.ndarray
    windows: np.ndarray
    tokens: np.ndarray
    first: np.ndarray
    owner: np.ndarray

    @staticmethod
    def of(landmarks: pa.Table) -> Index:
        profile = landmarks["profile"].combine_chunks()
        windows = pc.list_value_length(profile).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, owner = profile.flatten().to_numpy(), np.repeat(np.arange(len(windows), dtype=np.int32), windows)
        order = np.argsort(flat, kind="stable")
        tokens, first = np.unique(flat[order], return_index=True)
        reads = landmarks["read"].to_pylist()
        return Index(
            landmarks["cluster"].to_pylist(), landmarks["lm_ord"].to_numpy(), reads, np.array([len(r) for r in reads], np.int64),
            windows, tokens, np.append(first, len(flat)), owner[order],
        )

    def shared(self, profile: pa.ListArray) -> np.ndarray:
        """K-mers that each read has in common with each landmark, as multisets."""
        n, size = len(profile), len(self.reads)
        flat = profile.flatten().to_numpy()
        row = np.repeat(np.arange(n), pc.list_value_length(profile).to_numpy(zero_copy_only=False))
        if not len(self.tokens) or not len(flat):
            return np.zeros((n, size), np.int64)
        slot = np.minimum(np.searchsorted(self.tokens, flat), len(self.tokens) - 1)
        known = self.tokens[slot] == flat
        slot, row = slot[known], row[known]
        times = self.first[slot + 1] - self.first[slot]
        entry = np.repeat(self.first[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.bincount(np.repeat(row, times) * size + self.owner[entry], minlength=n * size).reshape(n, size)


@dataclass
class _Best:
    """Per read the best hit so far: identity, landmark and strand; landmark -1 is none."""

    identity: np.ndarray
    landmark: np.ndarray
    strand: np.ndarray

    @staticmethod
    def none(n: int) -> _Best:
        return _Best(np.full(n, -1.0), np.full(n, -1), np.zeros(n, np.int64))

    def beaten_by(self, row: np.ndarray, identity: np.ndarray, landmark: np.ndarray, strand: np.ndarray) -> np.ndarray:
        """Which candidates come first with that identity: the higher, the earlier landmark, the plus strand."""
        mine = self.identity[row]
        sooner = (landmark < self.landmark[row]) | ((landmark == self.landmark[row]) & (strand < self.strand[row]))
        return (identity > mine) | ((identity == mine) & sooner)

    def take(self, row: np.ndarray, identity: np.ndarray, landmark: np.ndarray, strand: np.ndarray) -> None:
        """The best of each row's candidates, if it beats what is there."""
        order = np.lexsort((strand, landmark, -identity, row))
        row, identity, landmark, strand = (x[order] for x in (row, identity, landmark, strand))
        lead = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        row, identity, landmark, strand = row[lead], identity[lead], landmark[lead], strand[lead]
        better = self.beaten_by(row, identity, landmark, strand)
        row = row[better]
        self.identity[row], self.landmark[row], self.strand[row] = identity[better], landmark[better], strand[better]


def _by_kmers(shared: list[np.ndarray], windows: np.ndarray, index: Index, min_identity: float) -> _Best:
    best = _Best.none(len(windows))
    for strand, table in enumerate(shared):
        row, landmark = np.nonzero(table)
        identity = np.round(table[row, landmark] / np.minimum(windows[row], index.windows[landmark]), 12)
        good = identity >= min_identity
        best.take(row[good], identity[good], landmark[good], np.full(int(good.sum()), strand))
    return best


def _by_alignment(shared: list[np.ndarray], reads: list[list[str]], index: Index, min_identity: float, k: int) -> tuple[_Best, int]:
    """Branch and bound: likely landmarks first, and none that cannot beat the best hit so far.

    Also says how many pairs were aligned.
    """
    length = np.array([len(r) for r in reads[0]], np.int64)
    best = _Best.none(len(length))
    cells = [np.nonzero(table) for table in shared]
    row = np.concatenate([c[0] for c in cells])
    landmark = np.concatenate([c[1] for c in cells])
    strand = np.repeat(np.arange(len(shared)), [len(c[0]) for c in cells])
    common = np.concatenate([table[c] for table, c in zip(shared, cells, strict=True)])
    misses = least_misses(common, length[row], index.length[landmark], k)
    bound = np.round(most_identity(misses, length[row], index.length[landmark]), 12)
    aligned = 0
    counted = np.zeros(len(row), bool)
    step = 1
    rest = np.flatnonzero(bound >= min_identity)
    # likeliest first
    rest = rest[np.lexsort((strand[rest], landmark[rest], -bound[rest], row[rest]))]
    while len(rest):
        # the next few of each row
        lead = np.flatnonzero(np.concatenate([[True], row[rest][1:] != row[rest][:-1]]))
        place = np.arange(len(rest)) - np.repeat(lead, np.diff(np.append(lead, len(rest))))
        now, rest = rest[place < step], rest[place >= step]
        left = [reads[strand[i]][row[i]] for i in now]
        identity = np.round(1 - align_batch(left, [index.reads[landmark[i]] for i in now]), 12)
        aligned += len(now)
        good = identity >= min_identity
        best.take(row[now[good]], identity[good], landmark[now[good]], strand[now[good]])
        rest = rest[best.beaten_by(row[rest], bound[rest], landmark[rest], strand[rest])]
        # what k-mers leave open is bounded by edit distance before it is aligned
        ask = rest[~counted[rest] & (np.maximum(length[row[rest]], index.length[landmark[rest]]) <= COUNTED)]
        if len(ask):
            edits = edit_distances([reads[strand[i]][row[i]] for i in ask], [index.reads[landmark[i]] for i in ask])
            tighter = most_identity(np.maximum(edits, misses[ask]), length[row[ask]], index.length[landmark[ask]])
            bound[ask], counted[ask] = np.round(tighter, 12), True
            rest = rest[(bound[rest] >= min_identity) & best.beaten_by(row[rest], bound[rest], landmark[rest], strand[rest])]
            rest = rest[np.lexsort((strand[rest], landmark[rest], -bound[rest], row[rest]))]
        step = min(2 * step, 64)
    return best, aligned


def _hits(batches: Iterator[pa.RecordBatch], shared, min_identity: float, metric: str, k: int, names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows ``seq_id``, then read and profile of each strand, to the best hit of each read that has one."""
    index = Index(**shared.value)
    for batch in batches:
        step = max(1, CELLS // max(1, len(index.reads)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            profiles = [part.column(n) for n in range(2, part.num_columns, 2)]
            tables = [index.shared(p) for p in profiles]
            if metric == "kmer":
                best = _by_kmers(tables, pc.list_value_length(profiles[0]).to_numpy(zero_copy_only=False), index, min_identity)
            else:
                reads = [part.column(n).to_pylist() for n in range(1, part.num_columns, 2)]
                best, _ = _by_alignment(tables, reads, index, min_identity, k)
            hit = np.flatnonzero(best.landmark >= 0)
            landmark = best.landmark[hit]
            columns = [
                part.column(0).take(pa.array(hit)), pa.array([index.clusters[n] for n in landmark], schema.field("cluster").type),
                pa.array(index.lm_ord[landmark], schema.field("lm_ord").type), pa.array(best.identity[hit]),
                pa.array([(PLUS, MINUS)[s] for s in best.strand[hit]], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


@dataclass
class Frozen:
    """Landmarks made ready for any number of searches: an index for each part, sent to every executor once."""

    parts: list
    schema: pa.Schema
    kinds: dict

    @staticmethod
    def of(landmarks: DataFrame, limit: int = BROADCAST_BYTES) -> Frozen:
        """Parts whose counted tokens and letters have at most ``limit`` bytes."""
        context = landmarks.sparkSession.sparkContext
        index = materialise(landmarks.select("cluster", "lm_ord", "read", "profile"), "landmark_index")
        size = F.size("profile") * TOKEN_BYTES + F.length("read") + 64
        total = index.agg(F.sum(size)).first()[0] or 0
        n = -(-total // limit) or 1
        # hashes deal unevenly, so parts are half full
        n = 1 if n == 1 else 2 * n
        key = F.pmod(F.xxhash64("cluster", "lm_ord"), F.lit(n))
        tables = (index.where(key == part).orderBy("cluster", "lm_ord").toArrow() for part in range(n))
        parts = [context.broadcast(vars(Index.of(table))) for table in tables]
        return Frozen(parts, index.limit(0).toArrow().schema, {f.name: f.dataType for f in index.schema})


def nearest_landmark(
    reads: DataFrame, landmarks: DataFrame | Frozen, min_identity: float = 0.6, metric: str = "alignment", strand: str = "plus", k: int = 8,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """``seq_id, cluster, lm_ord, identity, strand`` of each read's best landmark; none, no row.

    ``reads`` holds ``seq_id, read, profile``, ``landmarks`` ``cluster, lm_ord, read, profile``, with
    profiles of ``k`` letters. Every landmark with a k-mer in common counts, the read as it is
    (``+``) or, with ``strand="both"``, its reverse complement (``-``). The best has the highest identity of
    at least ``min_identity``, then the first cluster and number, then ``+``. Identity is that of the
    alignment, or with ``metric="kmer"`` the share of k-mers in common.

    The landmarks, if they are not ``Frozen`` yet, are sent to every executor as one index from k-mer to
    landmarks, in parts of at most ``limit`` bytes; reads stay where they are. Of many parts, each gives its
    best hit of a read.
    """
    if metric not in ("alignment", "kmer"):
        raise ValueError(f"unknown metric {metric!r}")
    if strand not in ("plus", "both"):
        raise ValueError(f"unknown strand {strand!r}")
    rows = reads.select("seq_id", "read", "profile")
    if strand == "both":
        turned = reverse_complement(F.col("read"))
        rows = rows.withColumn("turned", turned).withColumn("turned_profile", token_profile(k)("turned"))
    frozen = landmarks if isinstance(landmarks, Frozen) else Frozen.of(landmarks, limit)
    out = StructType().add("seq_id", reads.schema["seq_id"].dataType).add("cluster", frozen.kinds["cluster"]).add("lm_ord", frozen.kinds["lm_ord"])
    out = out.add("identity", "double").add("strand", "string")
    options = {"min_identity": min_identity, "metric": metric, "k": k, "names": out.names, "schema": frozen.schema}
    found = [rows.mapInArrow(partial(_hits, shared=part, **options), out) for part in frozen.parts]
    if len(found) == 1:
        return found[0]
    hits = reduce(DataFrame.unionByName, found)
    order = F.struct((-F.col("identity")).alias("behind"), "cluster", "lm_ord", F.when(F.col("strand") == PLUS, 0).otherwise(1).alias("turn"))
    # at most one hit of each part
    best = hits.groupBy("seq_id").agg(F.array_min(F.collect_list(F.struct(order.alias("order"), "identity", "strand"))).alias("best"))
    return best.select("seq_id", "best.order.cluster", "best.order.lm_ord", "best.identity", "best.strand")
