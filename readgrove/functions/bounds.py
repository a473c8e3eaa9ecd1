"""How alike two reads can be at most, from cheap counts, so that few pairs are ever aligned.

A column of an alignment that is no match costs one edit, and it spoils at most k of the windows of k
letters on either side. So both the edit distance and the k-mers in common give a least number of such
columns, and that a largest possible identity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from readgrove.functions.alignment import align_batch
from readgrove.functions.profile import list_array

#: Longest read whose edit distance is counted; longer ones go by their k-mers alone.
COUNTED = 1024
WORD = 64
#: Pairs whose bit vectors are advanced together.
PAIRS = 1 << 13


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distance of each pair: a column of the table at once as two bit vectors, all pairs together."""
    out = np.zeros(len(left), np.int64)
    order = np.argsort([max(len(a), len(b)) for a, b in zip(left, right, strict=True)], kind="stable")
    for at in range(0, len(order), PAIRS):
        chunk = order[at : at + PAIRS]
        out[chunk] = _edits([left[i] for i in chunk], [right[i] for i in chunk])
    return out


def mismatches(left: list[str], right: list[str]) -> np.ndarray:
    """Places in which the reads of each pair differ, counted over the longer one."""
    out = np.zeros(len(left), np.int64)
    for at in range(0, len(left), PAIRS):
        a, b = left[at : at + PAIRS], right[at : at + PAIRS]
        codes = _codes(a + b)[0]
        out[at : at + PAIRS] = (codes[: len(a)] != codes[len(a) :]).sum(axis=1)
    return out


def _codes(reads: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in reads])
    width = max(1, int(lengths.max()))
    return np.array(reads, dtype=f"<U{width}").view(np.uint32).reshape(len(reads), width), lengths


def _edits(left: list[str], right: list[str]) -> np.ndarray:
    a, la = _codes(left)
    b, lb = _codes(right)
    pairs, words = len(left), -(-a.shape[1] // WORD)
    one = np.uint64(1)
    letters, number = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)
    of_a, of_b = number[: a.size].reshape(a.shape), number[a.size :].reshape(b.shape)
    # for each letter the places of the left read that have it
    places = np.zeros((words, len(letters), pairs), np.uint64)
    rows = np.arange(pairs)
    for i in range(a.shape[1]):
        places[i // WORD, of_a[:, i], rows] |= np.where(i < la, one << np.uint64(i % WORD), np.uint64(0))
    up = np.full((words, pairs), ~np.uint64(0))
    down = np.zeros((words, pairs), np.uint64)
    score = la.copy()
    last_word, last_bit = np.maximum(la - 1, 0) // WORD, (np.maximum(la - 1, 0) % WORD).astype(np.uint64)
    top = np.uint64(WORD - 1)
    out = np.where(lb == 0, la, 0)
    for j in range(b.shape[1]):
        carry_up, carry_down = np.ones(pairs, np.uint64), np.zeros(pairs, np.uint64)  # the row above grows by one a column
        for w in range(words):
            match = places[w, of_b[:, j], rows]
            vertical, up_w, down_w = match | down[w], up[w], down[w]
            match = match | carry_down
            across = (((match & up_w) + up_w) ^ up_w) | match
            plus = down_w | ~(across | up_w)
            minus = up_w & across
            ends = last_word == w
            score = score + np.where(ends, ((plus >> last_bit) & one).astype(np.int64) - ((minus >> last_bit) & one).astype(np.int64), 0)
            next_up, next_down = plus >> top, minus >> top
            plus, minus = (plus << one) | carry_up, (minus << one) | carry_down
            carry_up, carry_down = next_up, next_down
            up[w] = minus | ~(vertical | plus)
            down[w] = plus & vertical
        out = np.where(lb == j + 1, score, out)
    return np.where(la == 0, lb, out)


def least_misses(shared: np.ndarray, length: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Columns without a match that reads of these lengths have at least, with so many k-mers in common."""
    windows = np.maximum(np.maximum(length, other) - k + 1, 0)
    by_kmers = np.ceil((windows - shared) / k - 1e-9)
    return np.maximum(np.maximum(by_kmers, 0), np.abs(length - other)).astype(np.int64)


def most_identity(misses: np.ndarray, length: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The largest identity of an alignment with at least so many columns that are no match.

    Matches take a letter of each read, other columns at least one letter of one.
    """
    matches = np.minimum(np.minimum(length, other), (length + other - misses) // 2)
    columns = np.maximum(matches + misses, 1)
    return np.where(matches + misses > 0, np.maximum(matches, 0) / columns, 1.0)


def identities(left: list[str], right: list[str], at_least: float | np.ndarray) -> np.ndarray:
    """Alignment identity of each pair, rounded to 12 places; not a number where it is below ``at_least``.

    Pairs that cannot reach it by length or edit distance are not aligned.
    """
    out = np.full(len(left), np.nan)
    if not len(left):
        return out
    la, lb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    bound = np.broadcast_to(np.asarray(at_least, float), len(left)) - 1e-11
    rest = np.flatnonzero(most_identity(np.abs(la - lb), la, lb) >= bound)
    short = rest[np.maximum(la, lb)[rest] <= COUNTED]
    if len(short):
        # two places at most in which reads of one length differ are the misses, see ``align_batch``
        differ = mismatches([left[i] for i in short], [right[i] for i in short])
        near = (la == lb)[short] & (differ <= 2)
        out[short[near]] = np.round(1 - differ[near] / np.maximum(la[short[near]], 1), 12)
        out[short[near][out[short[near]] < bound[short[near]]]] = np.nan
        rest, short = np.setdiff1d(rest, short[near], assume_unique=True), short[~near]
    if len(short):
        edits = edit_distances([left[i] for i in short], [right[i] for i in short])
        far = short[most_identity(edits, la[short], lb[short]) < bound[short]]
        rest = np.setdiff1d(rest, far, assume_unique=True)
    found = np.round(1 - align_batch([left[i] for i in rest], [right[i] for i in rest]), 12)
    good = found >= bound[rest]
    out[rest[good]] = found[good]
    return out


def identity_from(at_least: float):
    """Column function: two reads -> their alignment identity, or null where it is below ``at_least``."""

    @F.arrow_udf(DoubleType())
    def identity(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array(identities(left.to_pylist(), right.to_pylist(), at_least), from_pandas=True)

    return identity


def _distances(reads: list[str], others: list[list[str]], most: np.ndarray) -> pa.Array:
    sizes = np.array([len(o) for o in others])
    left = [read for read, o in zip(reads, others, strict=True) for _ in o]
    right = [text for o in others for text in o]
    found = identities(left, right, np.repeat(1 - most, sizes))
    return list_array(np.concatenate(([0], np.cumsum(sizes))), np.where(np.isnan(found), 1.0, np.round(1 - found, 12)))


@F.arrow_udf(ArrayType(DoubleType()))
def read_distances(read: pa.Array, others: pa.Array, most: pa.Array) -> pa.Array:
    """Alignment distance of a read to each of ``others``, in order; one above ``most`` may come as 1 unaligned."""
    return _distances(read.to_pylist(), others.to_pylist(), most.to_numpy(zero_copy_only=False))


def read_lookup(lists: DataFrame, key: str, reads: str):
    """Column function: (key, read, most) -> ``read_distances`` to the key's ``reads``.

    ``lists`` has one row per key and is sent to every executor once; the caller has counted that it fits.
    """
    rows = lists.select(key, reads).toArrow()
    shared = lists.sparkSession.sparkContext.broadcast(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)))

    @F.arrow_udf(ArrayType(DoubleType()))
    def distances(keys: pa.Array, read: pa.Array, most: pa.Array) -> pa.Array:
        others = [shared.value.get(k, []) for k in keys.to_pylist()]
        return _distances(read.to_pylist(), others, most.to_numpy(zero_copy_only=False))

    return distances
