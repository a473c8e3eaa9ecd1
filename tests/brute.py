"""Slow, plain-Python versions of the rules, written apart from the library."""

import hashlib
import math
from collections import Counter
from functools import lru_cache

NEVER = -(10**9)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def key60(text):
    return int(md5(text)[:15], 16)


def kmer_distance(a, b, k):
    count = lambda r: Counter(r[i : i + k] for i in range(len(r) - k + 1))
    shared = sum((count(a) & count(b)).values())
    return 1 - shared / (min(len(a), len(b)) - k + 1)


@lru_cache(maxsize=None)
def alignment_distance(a, b):
    """Three tables of scores, then a walk back that recomputes which neighbour gave each score."""
    n, m = len(a), len(b)
    score = {}
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 and j == 0:
                score[i, j] = {"M": 0, "X": 0, "Y": 0}
            elif j == 0:
                score[i, j] = {"M": NEVER, "X": NEVER, "Y": -10 - i}
            elif i == 0:
                score[i, j] = {"M": NEVER, "X": -10 - j, "Y": NEVER}
            else:
                gain = 5 if a[i - 1] == b[j - 1] else -4
                score[i, j] = {
                    "M": max(score[i - 1, j - 1].values()) + gain,
                    "X": max(score[i, j - 1][s] - (1 if s == "X" else 11) for s in "MXY"),
                    "Y": max(score[i - 1, j][s] - (1 if s == "Y" else 11) for s in "MXY"),
                }
    i, j = n, m
    state = max("XYM", key=lambda s: score[i, j][s])
    same = different = 0
    while i > 0 and j > 0:
        if state == "M":
            same, different = (same + 1, different) if a[i - 1] == b[j - 1] else (same, different + 1)
            i, j = i - 1, j - 1
            state = max("MXY", key=lambda s: score[i, j][s])
        elif state == "X":
            different, j = different + 1, j - 1
            state = max("MXY", key=lambda s: score[i, j][s] - (1 if s == "X" else 11))
        else:
            different, i = different + 1, i - 1
            state = max("MXY", key=lambda s: score[i, j][s] - (1 if s == "Y" else 11))
    different += i + j
    return different / (different + same)


def quota(size):
    return 0 if size < 2 else math.ceil(round(math.log2(size), 9))


def upper_median(values):
    return sorted(values)[len(values) // 2]


def landmarks_of(cluster, reads, k, seed, buckets):
    """Landmark reads of one cluster, in order."""
    m = max(1, quota(len(reads)) - 1)
    pick = lambda step, pool: min(pool, key=lambda r: (key60(f"{seed}|{cluster}|{step}|{md5(r)}"), md5(r)))
    chosen = [pick(0, reads)]
    nearest = dict.fromkeys(reads, 1.0)
    for step in range(1, m):
        for read in reads:
            nearest[read] = min(nearest[read], kmer_distance(read, chosen[-1], k))
        by_bucket = {}
        for read in reads:
            by_bucket.setdefault(int(md5(read)[:8], 16) % buckets, []).append(nearest[read])
        limit = upper_median([upper_median(v) for v in by_bucket.values()])
        chosen.append(pick(step, [r for r in reads if nearest[r] >= limit]))
    return chosen


def bisect(cluster, weights, m, iterations, seed):
    x = [key60(f"start|{seed}|{cluster}|{i}") / 2**60 for i in range(m)]
    degree = [sum(weights[i][j] for j in range(m)) for i in range(m)]
    if max(degree) == 0:
        return None
    for _ in range(iterations):
        y = [sum(weights[i][j] * x[j] for j in range(m)) / (degree[i] or 1) for i in range(m)]
        total = sum(abs(v) for v in y)
        x = [v / total for v in y]
    mean = sum(x) / m
    u = [v - mean for v in x]
    if not max(map(abs, u)) > 1e-12 * sum(map(abs, x)) / m:
        return None
    top = max(map(abs, u))
    u = [v / top for v in u]
    order = sorted(range(m), key=lambda i: (u[i], i))

    def spread(part):
        centre = sum(u[i] for i in part) / len(part)
        return sum((u[i] - centre) ** 2 for i in part)

    best = min(range(1, m), key=lambda s: (round(spread(order[:s]) + spread(order[s:]), 12), s))
    side = [0] * m
    for i in order[best:]:
        side[i] = 1
    return [s ^ side[0] for s in side]


def divide(reads, k, radius, min_size, num_leaves, iterations=10, seed=0, buckets=16):
    """Labels by read and landmarks by leaf, one split after the other, largest cluster first."""
    clusters, open_, notes = {1: sorted(reads)}, {1}, {}
    while open_ and (num_leaves == 0 or len(clusters) < num_leaves):
        c = max(open_, key=lambda i: (len(clusters[i]), -i))
        members = clusters[c]
        if len(members) <= min_size:
            break
        open_.discard(c)
        chosen = landmarks_of(c, members, k, seed, buckets)
        m = len(chosen)
        if m < 2:
            continue
        d = [[0.0 if i == j else alignment_distance(*((chosen[i], chosen[j]) if i < j else (chosen[j], chosen[i])))
              for j in range(m)] for i in range(m)]
        if min(sum(row) for row in d) / (m - 1) <= radius:
            notes[c] = chosen
            continue
        side = bisect(c, [[0 if i == j else 1 - d[i][j] for j in range(m)] for i in range(m)], m, iterations, seed)
        if side is None:
            if c == 1:
                notes[c] = chosen
            continue
        parts = ([], [])
        for read in members:
            mean = [
                round(sum(v) / len(v), 12)
                for v in ([kmer_distance(read, chosen[i], k) for i in range(m) if side[i] == s] for s in (0, 1))
            ]
            parts[0 if mean[0] <= mean[1] else 1].append(read)
        if not parts[0] or not parts[1]:
            if c == 1:
                notes[c] = chosen
            continue
        del clusters[c]
        notes.pop(c, None)
        for s in (0, 1):
            clusters[2 * c + s] = parts[s]
            notes[2 * c + s] = [chosen[i] for i in range(m) if side[i] == s]
            open_.add(2 * c + s)
    if 1 in clusters and 1 not in notes:
        notes[1] = landmarks_of(1, clusters[1], k, seed, buckets)
    return {r: c for c, rs in clusters.items() for r in rs}, notes


def greedy(reads, identity):
    """``(members, centroids)`` of one cluster of ``(header, read)``."""
    centroids, members = [], {}
    for header, read in sorted(reads, key=lambda x: (-len(x[1]), x[0])):
        for name, text in centroids:
            value = round(1 - alignment_distance(read, text), 12)
            if value >= identity:
                members[header] = (name, value)
                break
        else:
            centroids.append((header, read))
    return members, centroids
