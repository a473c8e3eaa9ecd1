import pytest
from pyspark.sql import functions as F

import readgrove.session as session
from readgrove.operators import landmarks as L
from readgrove.operators import splits
from readgrove.operators.kmers import profiles
from readgrove.plans import divide as plan
from readgrove.plans.divide import DivideParams, divide
from tests import brute
from tests.reads import families

READS = sorted(families(11, 6, 26, 44, 4))
SETTINGS = dict(word_size=4, min_size=9, radius=0.12)


def seqs_of(spark, reads, partitions=4):
    df = spark.createDataFrame([(r,) for r in reads], "read string").repartition(partitions)
    return df.select(F.md5("read").alias("seq_id"), "read")


def outcome(division):
    labels = {r["read"]: r["cluster"] for r in division.labels.collect()}
    marks = {}
    for row in division.leaf_landmarks.orderBy("cluster", "lm_ord").collect():
        marks.setdefault(row["cluster"], []).append(row["read"])
    return labels, marks


@pytest.mark.parametrize("num_leaves", [0, 2, 6])
def test_divide_equals_one_split_at_a_time(spark, num_leaves):
    division = divide(seqs_of(spark, READS), DivideParams(num_leaves=num_leaves, carry=3, **SETTINGS))
    labels, marks = outcome(division)
    want_labels, want_marks = brute.divide(READS, 4, 0.12, 9, num_leaves)
    assert labels == want_labels
    assert marks == want_marks
    sizes = {r["cluster"]: r["size"] for r in division.tree.where("is_leaf").collect()}
    assert sum(sizes.values()) == len(READS)
    assert set(labels.values()) == set(sizes)
    if num_leaves:
        assert len(sizes) <= num_leaves


def test_result_does_not_depend_on_partitions(spark):
    seen = []
    for partitions in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            division = divide(seqs_of(spark, READS[:70], partitions), DivideParams(num_leaves=3, **SETTINGS))
            seen.append(outcome(division))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert seen[0] == seen[1]


def test_large_control_tables_are_shuffled_with_the_same_result(spark, monkeypatch):
    import readgrove.session as session

    params = DivideParams(num_leaves=4, **SETTINGS)
    want = brute.divide(READS[:60], 4, 0.12, 9, 4)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 2000)
    assert outcome(divide(seqs_of(spark, READS[:60]), params)) == want


def test_few_reads_are_few_files_however_they_come(spark, monkeypatch):
    """Every step of every round has a task for each file of the root."""
    files = []

    def seen(df, name, **options):
        table = session.materialise(df, name, **options)
        if name == "root":
            files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(plan, "materialise", seen)
    rows = [(f"r{i}", r) for i, r in enumerate(sorted(families(3, 2, 20, 60, 2)))]
    divide(spark.createDataFrame(rows, "seq_id string, read string").repartition(40), DivideParams(min_size=1000))
    assert files[0] <= spark.sparkContext.defaultParallelism


def test_root_of_exactly_the_minimum_size_stays_whole(spark):
    reads = READS[:9]
    labels, marks = outcome(divide(seqs_of(spark, reads), DivideParams(**SETTINGS)))
    assert set(labels.values()) == {1} and set(labels) == set(reads)
    assert marks == brute.divide(reads, 4, 0.12, 9, 0)[1]
    labels, _ = outcome(divide(seqs_of(spark, READS), DivideParams(num_leaves=1, **SETTINGS)))
    assert set(labels.values()) == {1}


@pytest.mark.parametrize("size", [1, 2, 4, 5])
def test_tiny_clusters(spark, size):
    params = DivideParams(word_size=4, min_size=0, radius=0.01)
    labels, marks = outcome(divide(seqs_of(spark, READS[::30][:size]), params))
    assert len(labels) == size and marks
    if size <= 4:
        assert set(labels.values()) == {1}


def test_no_reads(spark):
    division = divide(seqs_of(spark, ["AC"]), DivideParams(**SETTINGS))
    assert division.labels.count() == 0 and division.leaf_landmarks.count() == 0


def test_parameters_are_checked():
    for bad in ({"word_size": 16}, {"word_size": 0}, {"abundance": 0}, {"radius": 1.0}, {"min_size": -1},
                {"num_leaves": -1}, {"iterations": 0}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            DivideParams(**bad)


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "cluster bigint, src bigint, dst bigint, weight double")


def test_bisect_separates_blocks_and_skips_what_cannot_be_separated(spark):
    blocks = [(1, i, j, 0.95 if (i < 4) == (j < 4) else 0.05) for i in range(8) for j in range(i + 1, 8)]
    zero = [(2, i, j, 0.0) for i in range(4) for j in range(i + 1, 4)]
    found = splits.bisect(edges_of(spark, blocks + zero)).collect()
    assert {r["cluster"] for r in found} == {1}
    assert {r["lm_ord"]: r["side"] for r in found} == {i: int(i >= 4) for i in range(8)}
    by_ml = {r["lm_ord"]: r["side"] for r in splits.bisect_mllib(edges_of(spark, blocks[1:])).collect()}
    assert len({by_ml[i] for i in range(4)}) == 1 and len({by_ml[i] for i in range(4, 8)}) == 1
    assert by_ml[0] != by_ml[7]


def test_radius_is_the_medoid_mean(spark):
    rows = [(1, 0, 1, 0.9), (1, 0, 2, 0.8), (1, 1, 2, 0.6)]
    assert splits.medoid_radius(edges_of(spark, rows)).first()["radius"] == pytest.approx(0.15)
    assert splits.radius_leaf(edges_of(spark, rows), 0.1).count() == 0
    assert splits.radius_leaf(edges_of(spark, rows), 0.1501).count() == 1


def test_row_form_of_the_side_equals_the_joined_form(spark):
    rows = [("a", [0.1, 0.5, 0.3]), ("b", [0.9, 0.2, 0.4]), ("c", [0.4, 0.4, 0.4])]
    wide = spark.createDataFrame(rows, "seq_id string, dists array<double>")
    sides = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 0)], "cluster bigint, lm_ord int, side int")
    row_form = wide.select("seq_id", splits.side_of(F.col("dists"), F.array(F.lit(0), F.lit(1), F.lit(0))).alias("side"))
    pairs = F.transform("dists", lambda d, i: F.struct(i.alias("lm_ord"), d.alias("d")))
    measured = wide.select("seq_id", F.lit(1).cast("bigint").alias("cluster"), pairs.alias("ds"))
    joined = splits.assign_side(measured, sides).select("seq_id", "side")
    assert sorted(map(tuple, row_form.collect())) == sorted(map(tuple, joined.collect())) == [("a", 0), ("b", 1), ("c", 0)]


def test_distinct_landmarks(spark):
    # equal distances everywhere: the threshold is 0 after the first pick, so repeats are possible
    reads = ["ACGT" * 6 + c for c in "ACGT"] + ["ACGT" * 6 + a + b for a in "ACGT" for b in "ACGT"]
    members = profiles(seqs_of(spark, reads), 2).withColumn("cluster", F.lit(1).cast("bigint"))
    active = spark.createDataFrame([(1, len(reads), 12)], "cluster bigint, size bigint, m int")
    extent = L.Extent.of(active, 26)
    chosen, _ = L.select_landmarks(members, active, extent, k=2, distinct_landmarks=True)
    picked = [r["seq_id"] for r in chosen.collect()]
    assert len(picked) == 12 == len(set(picked))
