"""Global alignment distance of read pairs: all pairs of an Arrow batch advance together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Alignment scores. A gap of length g costs OPEN + g * EXTEND, end gaps too.
MATCH, MISMATCH, OPEN, EXTEND = 5, -4, 10, 1

# One state of a cell is one integer: score, then rank among equal scores, then the number of
# miss columns and match columns on the path that reached it. Taking the maximum picks the best
# predecessor under the tie rule and carries its counts along, so no traceback is stored.
_MISS, _RANK, _SCORE = 16, 33, 35
_LIMIT = (1 << _MISS) - 1
_KEEP = ~np.int64(((1 << (_SCORE - _RANK)) - 1) << _RANK)
_NEVER = np.int64(-100_000_000) << _SCORE
_CELLS = 1 << 16


def _best(first, second, third):
    """Largest state, equal scores decided in the order given."""
    top = np.maximum(first + (np.int64(2) << _RANK), second + (np.int64(1) << _RANK))
    return np.maximum(top, third) & _KEEP


def _gap(score: int) -> np.int64:
    return (np.int64(-score) << _SCORE) + (np.int64(1) << _MISS)


def _sweep(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Distances for reads given as (position, pair) letters; walks the anti-diagonals."""
    rows, cols, pairs = a.shape[0], b.shape[0], a.shape[1]
    hit = (np.int64(MATCH) << _SCORE) + 1
    miss = (np.int64(MISMATCH) << _SCORE) + (np.int64(1) << _MISS)
    longer, opened = _gap(EXTEND), _gap(OPEN + EXTEND)
    flipped = b[::-1]
    out = np.empty(pairs)
    ends = la + lb

    diagonal = [np.full((rows + 1, pairs), _NEVER) for _ in range(3)]
    before = [np.full((rows + 1, pairs), _NEVER) for _ in range(3)]
    for state in diagonal:
        state[0] = 0
    for d in range(1, rows + cols + 1):
        fresh = [np.full((rows + 1, pairs), _NEVER) for _ in range(3)]
        low, high = max(1, d - cols), min(rows, d - 1)
        if low <= high:
            here, up = slice(low, high + 1), slice(low - 1, high)
            # letters a[i-1] against b[d-i-1], for i = low..high
            same = a[up] == flipped[cols - d + low : cols - d + high + 1]
            both, skip_a, skip_b = before
            fresh[0][here] = _best(both[up], skip_a[up], skip_b[up]) + np.where(same, hit, miss)
            both, skip_a, skip_b = diagonal
            fresh[1][here] = _best(both[here] + opened, skip_a[here] + longer, skip_b[here] + opened)
            fresh[2][here] = _best(both[up] + opened, skip_a[up] + opened, skip_b[up] + longer)
        edge = (np.int64(-OPEN - d * EXTEND) << _SCORE) + (np.int64(d) << _MISS)
        if d <= cols:
            fresh[1][0] = edge
        if d <= rows:
            fresh[2][d] = edge
        before, diagonal = diagonal, fresh
        done = np.flatnonzero(ends == d)
        if len(done):
            both, skip_a, skip_b = (state[la[done], done] for state in diagonal)
            last = _best(skip_a, skip_b, both)
            missed, matched = (last >> _MISS) & ((1 << (_RANK - _MISS)) - 1), last & _LIMIT
            out[done] = missed / (missed + matched)
    return out


def _first_best(*states):
    """``_best`` for states of two planes, score and counts: the first one of the largest score."""
    score, counts = states[0]
    for other, other_counts in states[1:]:
        better = other > score
        score, counts = np.where(better, other, score), np.where(better, other_counts, counts)
    return score, counts


def _sweep_long(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """``_sweep`` for reads of any length: scores and counts (misses << 32 | matches) on two planes."""
    rows, cols, pairs = a.shape[0], b.shape[0], a.shape[1]
    flipped, out, ends = b[::-1], np.empty(pairs), la + lb
    one_miss = np.int64(1) << 32

    def empty():
        return np.full((rows + 1, pairs), np.int64(-(1 << 60))), np.zeros((rows + 1, pairs), np.int64)

    def plus(state, at, score, counts=one_miss):
        return state[0][at] + score, state[1][at] + counts

    diagonal, before = [empty() for _ in range(3)], [empty() for _ in range(3)]
    for score, _ in diagonal:
        score[0] = 0
    for d in range(1, rows + cols + 1):
        fresh = [empty() for _ in range(3)]
        low, high = max(1, d - cols), min(rows, d - 1)
        if low <= high:
            here, up = slice(low, high + 1), slice(low - 1, high)
            same = a[up] == flipped[cols - d + low : cols - d + high + 1]
            score, counts = _first_best(*(plus(s, up, 0, 0) for s in before))
            found = [(score + np.where(same, MATCH, MISMATCH), counts + np.where(same, 1, one_miss))]
            both, skip_a, skip_b = diagonal
            longer, opened = -EXTEND, -OPEN - EXTEND
            found.append(_first_best(plus(both, here, opened), plus(skip_a, here, longer), plus(skip_b, here, opened)))
            found.append(_first_best(plus(both, up, opened), plus(skip_a, up, opened), plus(skip_b, up, longer)))
            for state, (score, counts) in zip(fresh, found):
                state[0][here], state[1][here] = score, counts
        for state, at in ((fresh[1], 0 if d <= cols else None), (fresh[2], d if d <= rows else None)):
            if at is not None:
                state[0][at], state[1][at] = -OPEN - d * EXTEND, d * one_miss
        before, diagonal = diagonal, fresh
        done = np.flatnonzero(ends == d)
        if len(done):
            both, skip_a, skip_b = ((score[la[done], done], counts[la[done], done]) for score, counts in diagonal)
            counts = _first_best(skip_a, skip_b, both)[1]
            missed, matched = counts >> 32, counts & ((1 << 32) - 1)
            out[done] = missed / (missed + matched)
    return out


def _letters(reads: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Reads as a (position, pair) array of code points, padded, with their lengths."""
    lengths = np.array([len(read) for read in reads])
    width = max(1, int(lengths.max()))
    return np.array(reads, dtype=f"<U{width}").view(np.uint32).reshape(len(reads), width).T.copy(), lengths


def align_batch(left: list[str], right: list[str]) -> np.ndarray:
    """(mismatches + gap columns) / columns of the best global alignment of each pair.

    Two reads of one length that differ in at most two places need no sweep: their ungapped
    alignment loses at most 18 points against perfection, any gapped one at least 27.
    """
    out = np.empty(len(left))
    if len(left) == 0:
        return out
    sizes = np.array([max(len(x), len(y)) for x, y in zip(left, right)])
    order = np.argsort(sizes, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * (sizes[order[stop]] + 1) <= _CELLS:
            stop += 1
        chunk = order[start:stop]
        a, la = _letters([left[i] for i in chunk])
        b, lb = _letters([right[i] for i in chunk])
        near = np.zeros(len(chunk), bool)
        if a.shape == b.shape:
            differ = (a != b).sum(axis=0)
            near = (la == lb) & (differ <= 2)
            out[chunk[near]] = differ[near] / np.maximum(la[near], 1)
        far = ~near
        if far.any():
            # an alignment has at most both lengths of misses
            sweep = _sweep if int((la + lb)[far].max()) <= _LIMIT else _sweep_long
            out[chunk[far]] = sweep(a[:, far], b[:, far], la[far], lb[far])
        start = stop
    return out


@F.pandas_udf(DoubleType())
def alignment_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Alignment distance of two reads, none of them empty."""
    return pd.Series(align_batch(left.tolist(), right.tolist()))
