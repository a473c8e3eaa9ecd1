"""Edit distances, bounds and what is built on them, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readgrove.functions import bounds
from readgrove.functions.alignment import align_batch
from readgrove.operators import landmarks, splits
from readgrove.operators.derep import dereplicate_counted, stage_counts
from readgrove.operators.kmers import kmer_counts, kmer_windows, profiles
from readgrove.operators.search import nearest_landmark
from readgrove.sources.fasta import write_fasta
from readgrove.streaming.assign import assign_new_files
from tests import brute
from tests.reads import families, random_read


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(11)
    left, right = [], []
    for _ in range(500):
        a = random_read(rng, rng.choice([1, 5, 30, 63, 64, 65, 90, 128, 129]))
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            place = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b.insert(place, rng.choice("ACGTN"))
            elif len(b) > 1:
                del b[min(place, len(b) - 1)]
        left.append(a)
        right.append("".join(b) if rng.random() < 0.8 else random_read(rng, rng.randint(1, 150)))
    return left, right


def test_edit_distances(pairs, monkeypatch):
    left, right = pairs[0] + ["", "ACGT", ""], pairs[1] + ["ACG", "", ""]
    want = [edits(a, b) for a, b in zip(left, right)]
    assert bounds.edit_distances(left, right).tolist() == want
    monkeypatch.setattr(bounds, "PAIRS", 7)
    assert bounds.edit_distances(left, right).tolist() == want


def test_bounds_are_never_passed(pairs):
    found = 1 - align_batch(*pairs)
    la, lb = (np.array([len(x) for x in side]) for side in pairs)
    distance = bounds.edit_distances(*pairs)
    assert (bounds.most_identity(distance, la, lb) >= found - 1e-12).all()
    for k in (2, 4, 8):
        count = lambda r: {r[i : i + k]: sum(r[j : j + k] == r[i : i + k] for j in range(len(r) - k + 1)) for i in range(len(r) - k + 1)}
        shared = np.array([sum(min(n, count(b).get(w, 0)) for w, n in count(a).items()) for a, b in zip(*pairs)])
        misses = bounds.least_misses(shared, la, lb, k)
        assert (misses <= distance).all() and (bounds.most_identity(misses, la, lb) >= found - 1e-12).all()


@pytest.mark.parametrize("counted", [1024, 50])
def test_identities_leave_out_only_what_is_too_low(pairs, monkeypatch, counted):
    monkeypatch.setattr(bounds, "COUNTED", counted)
    found = np.round(1 - align_batch(*pairs), 12)
    for least in (0.0, 0.6, 0.97):
        assert np.array_equal(bounds.identities(*pairs, least), np.where(found >= least, found, np.nan), equal_nan=True)
    each = np.linspace(0, 1, len(found))
    assert np.array_equal(bounds.identities(*pairs, each), np.where(found >= each - 1e-11, found, np.nan), equal_nan=True)
    assert len(bounds.identities([], [], 0.5)) == 0


def test_landmarks_by_alignment(spark, monkeypatch):
    reads = sorted(families(31, 3, 12, 40, 4))
    table = profiles(spark.createDataFrame([(brute.md5(r), r) for r in reads], "seq_id string, read string"), 4)
    members = table.withColumn("cluster", F.lit(1).cast("bigint"))
    active = splits.cluster_sizes(members).select("cluster", "size", F.lit(5).alias("m"))
    extent = landmarks.Extent.of(active, 60)
    monkeypatch.setattr(brute, "kmer_distance", lambda a, b, k: round(brute.alignment_distance(a, b), 12))
    monkeypatch.setattr(brute, "quota", lambda n: 6)
    want = brute.landmarks_of(1, reads, 4, 0, 16)
    for room in (1 << 28, 1):
        monkeypatch.setattr(landmarks, "BROADCAST_BYTES", room)
        for carry in (8, 2):
            chosen, measured = landmarks.select_landmarks(members, active, extent, 4, carry=carry, metric="alignment")
            assert [r["read"] for r in chosen.orderBy("lm_ord").collect()] == want
            for row in measured.collect():
                assert row["dists"] == [round(brute.alignment_distance(row["read"], t), 12) for t in want]


def test_windows_with_odd_letters_are_skipped(spark):
    reads = ["ACGTNACGTAC", "acgtacgt", "NNNNN", "ACGXACG", "ACGTACGTN", "AC"]
    seqs = spark.createDataFrame([(r, r) for r in reads], "seq_id string, read string")
    code = lambda w: sum("ACGT".index(c) * 4 ** (len(w) - 1 - i) for i, c in enumerate(w))
    windows = {(r, i, code(r[i : i + 3].upper())) for r in reads for i in range(len(r) - 2) if not set(r[i : i + 3].upper()) - set("ACGT")}
    assert {tuple(r) for r in kmer_windows(seqs, 3, "skip").collect()} == windows
    counts = {}
    for r, _, kmer in windows:
        counts[r, kmer] = counts.get((r, kmer), 0) + 1
    assert {(r["seq_id"], r["kmer"]): r["cnt"] for r in kmer_counts(seqs, 3, "skip").collect()} == counts
    sizes = {r["seq_id"]: len(r["profile"]) for r in profiles(seqs, 3, ambiguous="skip").collect()}
    assert sizes == {r: sum(q == r for q, _, _ in windows) for r in reads if len(r) >= 3}
    assert kmer_windows(seqs, 3).count() == sum(max(0, len(r) - 2) for r in reads)
    with pytest.raises(ValueError, match="letters"):
        profiles(seqs, 3, ambiguous="drop")


def test_counts_of_the_pass_that_writes(spark):
    rows = [("a_1", "ACGT"), ("a_1", "acgt"), ("a_2", "ACGT"), ("a_1", "GGGG")]
    reads = spark.createDataFrame(rows, "header string, read string").repartition(3)
    unique, counts = dereplicate_counted(reads)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, stage_counts(reads, unique).collect()))
    assert {r["read"]: r["abundance"] for r in unique.collect()} == {"ACGT": 2, "GGGG": 1}
    empty, none = dereplicate_counted(reads.limit(0))
    assert empty.count() == 0 and {tuple(r) for r in none.collect()} == {("input", 0), ("unique", 0), ("abundant", 0)}


def test_new_files_are_searched_once(spark, tmp_path):
    rng = random.Random(12)
    reads = [(f"s_{i}", r) for i, r in enumerate([*sorted(families(8, 3, 10, 40, 6)), random_read(rng, 3)])]
    marks = profiles(spark.createDataFrame([(i, 0, r) for i, (_, r) in enumerate(reads[::6])], "cluster bigint, lm_ord int, read string"), 4)
    table = spark.createDataFrame(reads, "header string, read string")
    batch = nearest_landmark(profiles(table.withColumnRenamed("header", "seq_id"), 4), marks, k=4, strand="both")
    want = sorted(map(tuple, batch.collect()))
    source, sink, seen = (str(tmp_path / n) for n in ("in", "out", "seen"))
    run = lambda: assign_new_files(spark, source, marks, sink, seen, strand="both", k=4, files_at_once=1)
    half = table.where(F.substring("header", -1, 1) < "5")
    write_fasta(half.repartition(3), source)
    first = run()
    assert sorted(tuple(r)[:5] for r in first.collect()) == [w for w in want if w[0][-1] < "5"]
    write_fasta(table.subtract(half).repartition(2), str(tmp_path / "more"))
    for n, part in enumerate((tmp_path / "more").glob("part-*")):
        part.rename(tmp_path / "in" / f"part-9{n}.txt")
    assert sorted(tuple(r)[:5] for r in run().collect()) == want
    assert sorted(tuple(r)[:5] for r in run().collect()) == want
