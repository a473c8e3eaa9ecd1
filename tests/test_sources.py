import pytest
from pyspark.sql import functions as F

from readgrove.operators import otu
from readgrove.operators.derep import abundant, dereplicate, header_sets, stage_counts
from readgrove.sources import fasta, tables


def parsed(spark, tmp_path, text, **options):
    path = tmp_path / "in.fa"
    path.write_bytes(text.encode())
    df = fasta.parse_fasta(fasta.read_fasta(spark, str(path)), **options)
    return sorted((r["header"], r["read"]) for r in df.collect())


def test_many_lines_and_case(spark, tmp_path):
    assert parsed(spark, tmp_path, ">s1_1\nACGT\nacgtn\n") == [("s1_1", "ACGTACGTN")]
    assert parsed(spark, tmp_path, ">s1_1\nacgT\n", fold_case=False) == [("s1_1", "acgT")]


def test_mark_inside_a_header_splits_the_record(spark, tmp_path):
    text = ">s1_1 a>b\nACGT\n"
    with pytest.raises(Exception, match="without bases"):
        parsed(spark, tmp_path, text)
    assert parsed(spark, tmp_path, text, mode="dropmalformed") == [("b", "ACGT")]


@pytest.mark.parametrize("text", [">s2_3\n\n", ">s2_4\n", ">s2_5"])
def test_records_without_bases(spark, tmp_path, text):
    with pytest.raises(Exception, match="without bases"):
        parsed(spark, tmp_path, text)
    assert parsed(spark, tmp_path, text, mode="dropmalformed") == []


def test_empty_header_with_bases_is_kept(spark, tmp_path):
    assert parsed(spark, tmp_path, ">\nACGT\n") == [("", "ACGT")]


def test_carriage_returns(spark, tmp_path):
    text = ">s1_1\r\nAC\r\nGT\r\n"
    assert parsed(spark, tmp_path, text) == [("s1_1", "ACGT")]
    assert parsed(spark, tmp_path, text, strip_cr=False) == [("s1_1\r", "AC\rGT\r")]


def test_records_survive_many_small_splits(spark, tmp_path):
    path = tmp_path / "big.fa"
    path.write_text("".join(f">s{i % 7}_{i}\n{'ACGT' * (i % 9 + 1)}\nGG\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        raw = fasta.read_fasta(spark, str(path))
        assert raw.rdd.getNumPartitions() > 50
        rows = {r["header"]: r["read"] for r in fasta.parse_fasta(raw).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {f"s{i % 7}_{i}": "ACGT" * (i % 9 + 1) + "GG" for i in range(3000)}


def test_last_of_repeated_headers(spark):
    rows = [("h_1", "AC", 1), (" h_1 ", "AA", 2), ("h_2", "gt", 3)]
    reads = spark.createDataFrame(rows, "header string, read string, line int")
    last = {r["header"]: r["read"] for r in fasta.reads_by_header(reads, F.col("line")).collect()}
    assert last == {"h_1": "AA", "h_2": "gt"}
    greatest = {r["header"]: r["read"] for r in fasta.reads_by_header(reads).collect()}
    assert greatest["h_1"] == "AC"


def test_centroid_names_from_files(spark, tmp_path):
    (tmp_path / "cluster_5_centroids.fa").write_text(">c_1\nAC\ngt\n")
    (tmp_path / "cluster=cluster_6").mkdir()
    (tmp_path / "cluster=cluster_6" / "part-0.txt").write_text(">c_2\nAA\n")
    paths = [str(tmp_path / "cluster_5_centroids.fa"), str(tmp_path / "cluster=cluster_6" / "part-0.txt")]
    rows = {tuple(r) for r in fasta.read_centroids(spark, paths).collect()}
    assert rows == {("cluster_5", "c_1", "ACgt"), ("cluster_6", "c_2", "AA")}


def test_wide_table_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("s.1", 3, 0), ("s2", 0, 5)], "sample string, `c.1` bigint, c2 bigint")
    tables.write_otu_table(wide, str(tmp_path / "t"))
    long = {tuple(r) for r in tables.read_otu_table(spark, str(tmp_path / "t"), "sample", "centroid").collect()}
    assert long == {("s.1", "c.1", 3), ("s.1", "c2", 0), ("s2", "c.1", 0), ("s2", "c2", 5)}


def test_tables_of_other_columns_are_read_under_their_own_headers(spark, tmp_path):
    for name, rows in {"a": [("s1", "c1", 3), ("s2", "c2", 4)], "b": [("s1", "c8", 7), ("s1", "c9", 8)]}.items():
        counts = spark.createDataFrame(rows, "sample string, centroid string, n bigint")
        tables.write_counts(counts, str(tmp_path / name), "sample", "centroid")
    both = tables.read_otu_table(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "sample", "centroid")
    assert {tuple(r) for r in both.where("n > 0").collect()} == {("s1", "c1", 3), ("s2", "c2", 4), ("s1", "c8", 7), ("s1", "c9", 8)}
    text = "".join(p.read_text() for p in sorted((tmp_path / "a").glob("part-*")))
    assert text == "sample\tc1\tc2\ns1\t3\t0\ns2\t0\t4\n"


def test_counts_keep_the_table_they_come_from(spark, tmp_path):
    rows = [(4, "s1", "c1", 3), (4, "s2", "c2", 4), (5, "s1", "c1", 7), (5, "s3", "c9", 8), (None, "s1", "c1", 9), (6, "s1", "c1", 1)]
    counts = spark.createDataFrame(rows, "cluster bigint, sample string, centroid string, n bigint")
    tables.write_count_tables(counts, str(tmp_path / "t"), "cluster", "sample", "centroid")
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.is_dir()) == ["cluster=4", "cluster=5", "cluster=6"]
    text = "".join(p.read_text() for p in sorted((tmp_path / "t" / "cluster=5").glob("part-*")))
    assert text == "sample\tc1\tc9\ns1\t7\t0\ns3\t0\t8\n"
    found = tables.read_otu_table(spark, str(tmp_path / "t"), "sample", "centroid", table="cluster").where("n > 0")
    assert {tuple(r) for r in found.collect()} == {(str(c), s, m, n) for c, s, m, n in rows if c is not None}
    (tmp_path / "cluster_7_table.txt").write_text("\tc1\tc3\ns1\t5\t0\n")
    one = tables.read_otu_table(spark, str(tmp_path / "cluster_7_table.txt"), "sample", "centroid", corner="", table="cluster", name="(cluster_[0-9]+)_table")
    assert {tuple(r) for r in one.collect()} == {("cluster_7", "s1", "c1", 5), ("cluster_7", "s1", "c3", 0)}


def test_two_clusters_that_name_a_centroid_alike_are_two_units(spark, tmp_path):
    rows = [(4, "s1", "c1", 3), (5, "s1", "c1", 7), (5, "s2", "c2", 1)]
    counts = spark.createDataFrame(rows, "cluster bigint, sample string, centroid string, n bigint")
    tables.write_count_tables(counts, str(tmp_path / "t"), "cluster", "sample", "centroid")
    read = tables.read_otu_table(spark, str(tmp_path / "t"), "sample", "centroid", table="cluster")
    heads = spark.createDataFrame([(4, "c1", "ACGT"), (5, "c1", "ACG"), (5, "c2", "AC")], "cluster bigint, centroid string, read string")
    merged = otu.merge_otu_tables([read], otu.number_otus(heads)).where("n > 0")
    assert {(r["otu"], r["sample"], r["n"]) for r in merged.collect()} == {("OTU_0", "s1", 3), ("OTU_1", "s1", 7), ("OTU_2", "s2", 1)}


def test_a_table_of_very_many_columns(spark, tmp_path):
    counts = spark.range(20_000).selectExpr("concat('s', id % 3) sample", "concat('c', id) centroid", "id + 1 n")
    tables.write_counts(counts, str(tmp_path / "t"), "sample", "centroid")
    long = tables.read_otu_table(spark, str(tmp_path / "t"), "sample", "centroid").where("n > 0")
    assert long.count() == 20_000 and long.join(counts, ["sample", "centroid", "n"]).count() == 20_000


def reads_of(spark, rows):
    return spark.createDataFrame(rows, "header string, read string")


def test_abundance_counts_distinct_headers(spark):
    reads = reads_of(spark, [("a_1", "ACGT"), ("a_1", "acgt"), ("a_2", "ACGT"), ("a_1", "GGGG")])
    found = {r["read"]: r["abundance"] for r in dereplicate(reads).collect()}
    assert found == {"ACGT": 2, "GGGG": 1}
    assert [r["read"] for r in abundant(dereplicate(reads)).collect()] == ["ACGT"]
    counts = {r["stage"]: r["n"] for r in stage_counts(reads, dereplicate(reads)).collect()}
    assert counts == {"input": 4, "unique": 2, "abundant": 1}


def test_hot_read_is_shared_out_whole(spark):
    rows = [(f"s_{i}", "ACGT") for i in range(1000)] * 2 + [("t_1", "GG"), ("t_2", "GG")]
    reads = reads_of(spark, rows)
    sets = header_sets(reads, dereplicate(reads), max_headers=100).collect()
    hot = [r for r in sets if r["read"] == "ACGT"]
    assert len(hot) == 10 and max(len(r["headers"]) for r in hot) < 300
    assert sorted(h for r in hot for h in r["headers"]) == sorted({h for h, r in rows if r == "ACGT"})
    assert [(r["part"], r["headers"]) for r in sets if r["read"] == "GG"] == [(0, ["t_1", "t_2"])]
    assert len(header_sets(reads, dereplicate(reads)).collect()) == 2


def test_a_read_of_many_headers_is_one_record(spark, tmp_path):
    reads = reads_of(spark, [(f"s_{i}", "ACGT") for i in range(300)] + [("t_1", "GG")])
    fasta.write_derep(header_sets(reads, dereplicate(reads), max_headers=50), str(tmp_path / "d"))
    found = {r["read"]: r["header"] for r in fasta.parse_fasta(fasta.read_fasta(spark, str(tmp_path / "d"))).collect()}
    names = ", ".join(sorted(f"s_{i}" for i in range(300)))
    assert found == {"ACGT": f"Set({names})", "GG": "Set(t_1)"}
