import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readgrove.functions import alignment
from readgrove.functions import sequence as S
from readgrove.operators.kmers import kmer_counts, kmer_windows, landmark_distances, profiles, short_reads
from tests import brute
from tests.reads import mutate, random_read


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_base_code_maps_everything_else_to_zero(spark):
    assert one(spark, S.base_code(F.lit("ACGTNU"))) == "012300"
    assert one(spark, S.base_code(F.lit("acgt2x3é"))) == "01230000"


def test_pack_is_big_endian(spark):
    assert one(spark, S.pack(F.lit("ACGT"))) == 27
    assert one(spark, S.pack(F.lit("T" * 15))) == 4**15 - 1


def test_quota_and_landmark_count(spark):
    sizes = list(range(0, 70)) + [2**i + d for i in range(7, 62) for d in (-1, 0, 1)]
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint").select(
        "n", S.landmark_quota(F.col("n")).alias("q"), S.landmark_count(F.col("n")).alias("m")
    )
    for n, q, m in df.collect():
        assert q == (0 if n < 2 else (n - 1).bit_length())
        assert m == max(1, q - 1)


def test_child_and_depth(spark):
    assert one(spark, S.child_index(F.lit(5).cast("bigint"), F.lit(1))) == 11
    assert one(spark, S.child_index(F.lit(2**61).cast("bigint"), F.lit(1))) == 2**62 + 1
    assert one(spark, S.depth_of(F.lit(1).cast("bigint"))) == 0
    assert one(spark, S.depth_of(F.lit(37).cast("bigint"))) == 5


@pytest.mark.parametrize("bad", ["nounderscore", "a_b_c"])
def test_sample_needs_one_underscore(spark, bad):
    assert one(spark, S.sample_of(F.lit("s1_77"))) == "s1"
    with pytest.raises(Exception, match="exactly one underscore"):
        one(spark, S.sample_of(F.lit(bad)))


def test_header_set_round_trip_and_error(spark):
    text = S.strip_blanks(S.format_header_set(F.array(F.lit("a_1"), F.lit("b_2"))))
    assert one(spark, text) == "Set(a_1,b_2)"
    assert one(spark, S.parse_header_set(text)) == ["a_1", "b_2"]
    with pytest.raises(Exception, match="not a header set"):
        one(spark, S.parse_header_set(F.lit("a_1,b_2")))


def sequences(spark, reads):
    return spark.createDataFrame([(str(i), r) for i, r in enumerate(reads)], "seq_id string, read string")


@pytest.mark.parametrize("k", [1, 3, 8, 15])
def test_profiles_and_counts_match_counters(spark, k):
    rng = random.Random(k)
    reads = [random_read(rng, n) for n in (1, 14, 15, 16, 200)] + ["A" * 60, "ACAC" * 30, "acgtNNacgt" * 5]
    seqs = sequences(spark, reads)
    coded = [r.upper().replace("N", "A") for r in reads]
    number = lambda word: int("".join(str("ACGT".index(c)) for c in word), 4)
    want = {
        (str(i), number(w)): c
        for i, r in enumerate(coded)
        for w, c in Counter(r[j : j + k] for j in range(len(r) - k + 1)).items()
    }
    got = {(r["seq_id"], r["kmer"]): r["cnt"] for r in kmer_counts(seqs, k).collect()}
    assert got == want
    windows = Counter((r["seq_id"], r["kmer"]) for r in kmer_windows(seqs, k).collect())
    assert dict(windows) == want
    for row in profiles(seqs, k).collect():
        tokens = row["profile"]
        assert tokens == sorted(set(tokens)) and len(tokens) == len(reads[int(row["seq_id"])]) - k + 1
    assert short_reads(seqs, k).first()[0] == sum(len(r) < k for r in reads)


def test_landmark_distances_match_brute_force(spark):
    rng = random.Random(5)
    reads = [random_read(rng, rng.randint(8, 60)) for _ in range(40)] + ["A" * 30, "A" * 12]
    members = profiles(sequences(spark, reads), 4).withColumn("cluster", F.col("seq_id").cast("bigint") % 3)
    lms = members.where(F.col("seq_id").cast("int") < 12).withColumn("lm_ord", F.col("seq_id").cast("int"))
    rows = landmark_distances(members, lms.select("cluster", "lm_ord", "seq_id", "profile")).collect()
    assert len(rows) == len(reads) * 4
    for row in rows:
        want = brute.kmer_distance(reads[int(row["seq_id"])], reads[row["lm_ord"]], 4)
        assert row["d"] == pytest.approx(want, abs=1e-12)
        if row["seq_id"] == str(row["lm_ord"]):
            assert row["d"] == 0


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.tuples(st.text("ACGT", min_size=1, max_size=14), st.text("ACGT", min_size=1, max_size=14)), min_size=1, max_size=6))
def test_alignment_matches_brute_force(pairs):
    got = alignment.align_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [brute.alignment_distance(a, b) for a, b in pairs]


def test_alignment_of_related_reads():
    rng = random.Random(2)
    left = [random_read(rng, rng.randint(20, 70)) for _ in range(40)]
    right = [mutate(rng, a, rng.randint(0, 8)) for a in left]
    got = alignment.align_batch(left, right)
    assert got.tolist() == [brute.alignment_distance(a, b) for a, b in zip(left, right)]


def test_sweep_for_long_reads_equals_the_packed_one():
    rng = random.Random(4)
    left = [random_read(rng, rng.randint(1, 40)) for _ in range(60)]
    right = [mutate(rng, a, rng.randint(0, 12)) or "A" for a in left]
    a, la = alignment._letters(left)
    b, lb = alignment._letters(right)
    assert np.array_equal(alignment._sweep_long(a, b, la, lb), alignment._sweep(a, b, la, lb))
    long = "ACGT" * 17_500
    assert alignment.align_batch([long], [long[:8]])[0] == 1 - 8 / 70_000


def test_alignment_shortcut_equals_the_sweep():
    rng = random.Random(3)
    left = [random_read(rng, 30) for _ in range(60)]
    right = []
    for read in left:
        letters = list(read)
        for at in rng.sample(range(30), 2):
            letters[at] = rng.choice("ACGT")
        right.append("".join(letters))
    a, la = alignment._letters(left)
    b, lb = alignment._letters(right)
    assert np.array_equal(alignment.align_batch(left, right), alignment._sweep(a, b, la, lb))
