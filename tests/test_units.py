import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import readgrove.session as session
from readgrove.operators import assign, otu, picker, search
from readgrove.operators.kmers import profiles
from readgrove.operators.search import nearest_landmark
from readgrove.plans.divide import DivideParams
from readgrove.plans.otu_run import run_to_folders
from readgrove.sources import fasta, tables
from tests import brute
from tests.reads import families, mutate, random_read


def test_number_rows_over_many_partitions(spark):
    rng = random.Random(1)
    values = [rng.randrange(10**6) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint").repartition(7)
    got = sorted((r["n"], r["v"]) for r in session.number_rows(df, ["v"], "n").collect())
    assert got == list(enumerate(sorted(values)))


def test_attach_beyond_the_limit(spark):
    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("cluster"))
    small = spark.range(50).select(F.col("id").alias("cluster"), (F.col("id") * 10).alias("x"))
    sizes = big.groupBy("cluster").agg(F.count("*").alias("size"))
    want = sorted(map(tuple, big.join(small, "cluster").collect()))
    for limit in (10**9, 700, 1):
        got = session.attach(big, small, ["cluster"], 50, 100, sizes, 3000, limit=limit)
        assert sorted(map(tuple, got.select("cluster", "id", "x").collect())) == want


def turned(read):
    return read[::-1].translate(str.maketrans("ACGTacgt", "TGCAtgca"))


def best_landmark(read, landmarks, metric, k, strands, floor=0.6):
    """The best of all landmarks that share a k-mer, by comparing with every one."""
    found = []
    for cluster, ord_, text in landmarks:
        for turn, strand in enumerate(strands):
            mine = turned(read) if strand == "-" else read
            similarity = round(1 - brute.kmer_distance(mine, text, k), 12)
            if similarity > 0:
                value = similarity if metric == "kmer" else round(1 - brute.alignment_distance(mine, text), 12)
                if value >= floor:
                    found.append((-value, cluster, ord_, turn, strand))
    if not found:
        return None
    value, cluster, ord_, _, strand = min(found)
    return cluster, ord_, -value, strand


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(4)
    reads = sorted(families(7, 5, 14, 36, 9)) + [random_read(rng, n) for n in (4, 7, 20, 50, 80)]
    landmarks = [(i % 6 + 2, i // 6, r) for i, r in enumerate(reads[::4] + [reads[0], random_read(rng, 9)])]
    return sorted({turned(r) if i % 3 == 0 else r for i, r in enumerate(reads)}), landmarks


@pytest.mark.parametrize("metric", ["kmer", "alignment"])
@pytest.mark.parametrize("strand", ["plus", "both"])
@pytest.mark.parametrize("limit", [1 << 28, 2000])
def test_nearest_landmark_matches_brute_force(spark, searched, metric, strand, limit):
    k, (reads, landmarks) = 4, searched
    seqs = spark.createDataFrame([(r, r) for r in reads], "seq_id string, read string").repartition(3)
    marks = spark.createDataFrame(landmarks, "cluster bigint, lm_ord int, read string")
    found = nearest_landmark(profiles(seqs, k), profiles(marks, k), 0.6, metric, strand, k, limit).collect()
    got = {r["seq_id"]: (r["cluster"], r["lm_ord"], r["identity"], r["strand"]) for r in found}
    strands = "+-" if strand == "both" else "+"
    want = {r: best_landmark(r, landmarks, metric, k, strands) for r in reads}
    assert len(found) == len(got)
    assert got == {r: v for r, v in want.items() if v is not None}
    assert {r["strand"] for r in found} == set(strands)


def test_the_search_stops_early_and_shuffles_no_tokens(spark, searched):
    k, (reads, landmarks) = 4, searched
    seqs = profiles(spark.createDataFrame([(r, r) for r in reads], "seq_id string, read string"), k)
    marks = profiles(spark.createDataFrame(landmarks, "cluster bigint, lm_ord int, read string"), k)
    plan = nearest_landmark(seqs, marks, k=k, strand="both")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index = search.Index.of(marks.orderBy("cluster", "lm_ord").toArrow())
    rows = seqs.where(F.length("read") >= k).toArrow()
    texts = rows["read"].to_pylist()
    table = index.shared(rows["profile"].combine_chunks())
    assert all(table[i, j] == round((1 - brute.kmer_distance(texts[i], index.reads[j], k)) * (min(len(texts[i]), len(index.reads[j])) - k + 1))
               for i in range(0, len(texts), 7) for j in range(len(index.reads)))
    best, aligned = search._by_alignment([table], [texts], index, 0.6, k)
    assert 0 < aligned < 0.5 * (table > 0).sum()
    # some reads only find their best landmark after the likeliest one
    windows = np.maximum(0, np.minimum.outer([len(t) for t in texts], index.length) - k + 1)
    likeliest = (table / np.maximum(windows, 1)).argmax(axis=1)
    hit = best.landmark >= 0
    assert (likeliest[hit] != best.landmark[hit]).any()


def test_hits_and_fallback(spark):
    hits = spark.createDataFrame(
        [("Set(a_1,b_2)", "cluster_4", 1), ("Set(b_2,c_3,zz_9)", "cluster_5", 2)], "header_set string, cluster string, line int"
    )
    by_header = assign.dedupe_hits(assign.explode_header_sets(hits), "line")
    assert {tuple(r) for r in by_header.collect()} == {
        ("a_1", "cluster_4"), ("b_2", "cluster_5"), ("c_3", "cluster_5"), ("zz_9", "cluster_5"),
    }
    reads = spark.createDataFrame([(h, "ACGT") for h in ("a_1", "b_2", "c_3", "d_4", "e_5")], "header string, read string")
    placed = {r["header"]: r["cluster"] for r in assign.assign_all(reads, by_header).collect()}
    clusters = ["cluster_4", "cluster_5"]
    want = {h: clusters[brute.key60(f"fallback|0|{h}") % 2] for h in ("d_4", "e_5")}
    assert placed == {"a_1": "cluster_4", "b_2": "cluster_5", "c_3": "cluster_5", **want}
    assert {r["header"] for r in assign.unassigned(reads, by_header).collect()} == {"d_4", "e_5"}
    assert {r["header"] for r in assign.assigned(reads, by_header).collect()} == {"a_1", "b_2", "c_3"}
    assert assign.count_clusters(assign.assign_all(reads, by_header)).first()[0] == 2
    with pytest.raises(ValueError, match="no hit"):
        assign.assign_all(reads, by_header.limit(0))


def test_fallback_without_broadcast(spark, monkeypatch):
    hits = spark.createDataFrame([(f"h_{i}", f"c{i % 5}") for i in range(20)], "header string, cluster string")
    reads = spark.createDataFrame([(f"h_{i}", "ACGT") for i in range(200)], "header string, read string")
    want = sorted(map(tuple, assign.assign_all(reads, hits).collect()))
    monkeypatch.setattr(assign, "BROADCAST_BYTES", 1)
    assert sorted(map(tuple, assign.assign_all(reads, hits).collect())) == want


@pytest.fixture(scope="module")
def assigned_rows():
    found = families(21, 4, 22, 60, 3)
    rows = []
    for i, (read, family) in enumerate(sorted(found.items())):
        for copy in range(i % 3 + 1):
            rows.append((f"cluster_{family % 3 + 4}", f"s{i % 4}_{i}{copy}", read if i % 5 else read.lower()))
    return rows


@pytest.mark.parametrize("common", [64, 1 << 20])
def test_greedy_centroids_match_the_sequential_rule(spark, assigned_rows, monkeypatch, common):
    monkeypatch.setattr(picker, "COMMON", common)
    df = spark.createDataFrame(assigned_rows, "cluster string, header string, read string")
    members, centroids = picker.subcluster(df, 0.95)
    want_members, want_centroids = {}, set()
    for cluster in {r[0] for r in assigned_rows}:
        found, heads = brute.greedy([(h, r.upper()) for c, h, r in assigned_rows if c == cluster], 0.95)
        want_members.update({(cluster, q): t for q, t in found.items()})
        want_centroids |= {(cluster, h) for h, _ in heads}
    got = {(r["cluster"], r["query"]): (r["target"], round(r["identity"], 12)) for r in members.collect()}
    assert got == want_members
    assert {(r["cluster"], r["centroid"]) for r in centroids.collect()} == want_centroids
    original = {h: r for _, h, r in assigned_rows}
    assert all(r["read"] == original[r["centroid"]] for r in centroids.collect())


def test_reads_shorter_than_a_kmer_are_picked_too(spark):
    rows = [("c", "s_1", "ACGTA"), ("c", "s_2", "ACGTA"), ("c", "s_3", "ACGTT"), ("c", "s_4", "ACGTACGTAC"),
            ("c", "s_5", "A"), ("d", "s_6", "AC")]
    df = spark.createDataFrame(rows, "cluster string, header string, read string")
    members, centroids = picker.subcluster(df)
    assert [(m["query"], m["target"], m["identity"]) for m in members.collect()] == [("s_2", "s_1", 1.0)]
    assert {r["centroid"] for r in centroids.collect()} == {"s_1", "s_3", "s_4", "s_5", "s_6"}
    nothing, none = picker.subcluster(df.limit(0))
    assert nothing.count() == 0 and none.count() == 0


@pytest.mark.parametrize("identity", [0.9, 0.8, 0.6])
def test_chains_of_reads_alike_are_settled_in_order(spark, identity):
    """Random walks: each read is alike to the last few, so centroids depend on centroids before them."""
    rng, rows = random.Random(int(100 * identity)), []
    for cluster in range(3):
        for walk in range(4):
            read = list(random_read(rng, 40))
            for step in range(25):
                rows.append((cluster, f"s{walk}_{rng.randrange(10**9)}", "".join(read)))
                place = rng.randrange(len(read))
                if rng.random() < 0.4:
                    read.insert(place, rng.choice("ACGT"))
                elif rng.random() < 0.4 and len(read) > 8:
                    del read[place]
                else:
                    read[place] = rng.choice("ACGT")
    members, centroids = picker.greedy_centroids(spark.createDataFrame(rows, "cluster int, header string, read string"), identity)
    want_members, want_centroids = {}, set()
    for cluster in range(3):
        found, heads = brute.greedy([(h, r) for c, h, r in rows if c == cluster], identity)
        want_members.update({(str(cluster), q): t for q, t in found.items()})
        want_centroids |= {(str(cluster), h) for h, _ in heads}
    assert {(r["cluster"], r["query"]): (r["target"], round(r["identity"], 12)) for r in members.collect()} == want_members
    assert {(r["cluster"], r["centroid"]) for r in centroids.collect()} == want_centroids and len(want_centroids) > 12


@pytest.mark.parametrize("segmented, hot", [(4, 1024), (4, 1), (2, 1), (1, 3)])
def test_reads_found_by_segments_and_by_kmers(spark, monkeypatch, segmented, hot):
    """Chains whose lengths cross the bound between the two kinds of keys, with segments that are hot."""
    monkeypatch.setattr(picker, "SEGMENTED", segmented)
    monkeypatch.setattr(picker, "HOT", hot)
    rng, rows = random.Random(17), []
    for walk in range(4):
        read = list(random_read(rng, 44))
        for step in range(40):
            rows.append(("c", f"s{walk}_{rng.randrange(10**9)}", "".join(read)))
            place, kind = rng.randrange(len(read)), rng.random()
            if kind < 0.35:
                read.insert(place, rng.choice("ACGT"))
            elif kind < 0.7 and len(read) > 30:
                del read[place]
            else:
                read[place] = rng.choice("ACGT")
    members, centroids = picker.greedy_centroids(spark.createDataFrame(rows, "cluster string, header string, read string"), 0.94)
    found, heads = brute.greedy([(h, r) for _, h, r in rows], 0.94)
    assert {r["query"]: (r["target"], round(r["identity"], 12)) for r in members.collect()} == found
    assert {r["centroid"] for r in centroids.collect()} == {h for h, _ in heads} and len(heads) > 12


@pytest.mark.parametrize("length, misses", [(130, 4), (128, 3), (66, 2), (40, 1)])
def test_a_partner_has_a_whole_segment_at_one_of_its_places(length, misses):
    rng = random.Random(length)
    assert picker.misses_of(length, 0.97) == misses
    for _ in range(2000):
        read = random_read(rng, length)
        other = mutate(rng, read, misses)
        read, other = sorted((read, other), key=len, reverse=True)
        lengths = [n for n in range(30, 140) if picker.misses_of(n, 0.97) <= 4]
        if len(read) - len(other) > picker.misses_of(len(other), 0.97) or picker.misses_of(len(other), 0.97) < misses or len(read) not in lengths:
            continue
        whole = {(nth, read[at : at + size]) for nth, (at, size) in enumerate(picker.segments_of(len(read), 0.97))}
        places = picker.segment_places(len(other), lengths, 0.97)
        assert whole & {(nth, other[at : at + size]) for of, nth, at, size in places if of == len(read)}


def test_reads_of_common_words_are_not_compared(spark):
    """Of reads made of the same words each has k-mers in common with very many, but no segment."""
    rng = random.Random(3)
    words = [random_read(rng, 16) for _ in range(64)]
    rows = [("c", f"a_{i}", "".join(rng.choice(words) for _ in range(8))) for i in range(2000)]
    led = []

    def seen(df, name):
        written = session.materialise(df, name)
        if name == "led":
            led.append(written.count())
        return written

    kept, picker.materialise = picker.materialise, seen
    try:
        _, centroids = picker.greedy_centroids(spark.createDataFrame(rows, "cluster string, header string, read string"))
    finally:
        picker.materialise = kept
    assert centroids.count() == 2000 and sum(led) < 4000


def test_many_reads_far_from_one_another_are_one_round(spark):
    """20,000 centroids in one cluster, beside a group of reads alike to one of them."""
    rng = random.Random(5)
    alone = [("c", f"a_{i:05d}", random_read(rng, 100)) for i in range(20_000)]
    base = alone[777][2]
    alike = [("c", f"b_{i}", base[:i] + ("A" if base[i] != "A" else "C") + base[i + 1 :]) for i in range(100)]
    rounds = []
    kept, picker.materialise = picker.materialise, lambda df, name: rounds.append(name) or session.materialise(df, name)
    try:
        members, centroids = picker.greedy_centroids(spark.createDataFrame(alone + alike, "cluster string, header string, read string"))
    finally:
        picker.materialise = kept
    assert rounds.count("round_centroids") == 1 and centroids.count() == 20_000
    assert {(m["query"], m["target"]) for m in members.collect()} == {(h, "a_00777") for _, h, _ in alike}


def scratch_tables(spark):
    root = session._own_scratch(spark).removeprefix("file:")
    return {folder for folder, _, files in os.walk(root) if any(f.endswith(".parquet") for f in files)}


def shuffled_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for folder in folders for _, _, files in os.walk(folder.getPath()) for f in files if f.startswith("shuffle_")}


def test_only_what_was_picked_stays_on_disk(spark, assigned_rows):
    df = spark.createDataFrame(assigned_rows, "cluster string, header string, read string")
    before, shuffled = scratch_tables(spark), shuffled_files(spark)
    members, centroids = picker.greedy_centroids(df, 0.95)
    assert {os.path.basename(t) for t in scratch_tables(spark) - before} <= {"picked_members", "picked_centroids"}
    for _ in range(50):  # files are deleted beside the next job
        if not (left := shuffled_files(spark) - shuffled):
            break
        time.sleep(0.1)
    assert not left and members.count() > 0 and centroids.count() > 0
    assert spark.conf.get("spark.sql.parquet.compression.codec") == "snappy"


def test_clusters_are_picked_in_batches(spark, assigned_rows, monkeypatch):
    """Three clusters that are a batch each, and small ones that share some."""
    rows = [*assigned_rows, *((f"d_{i}", f"s_{i}", "ACGTTGCA" * 5) for i in range(20)), (None, "s_x", "ACGT"), (None, "s_y", "ACGT")]
    df = spark.createDataFrame(rows, "cluster string, header string, read string")
    whole = [sorted(map(repr, t.collect())) for t in picker.greedy_centroids(df, 0.95)]
    seen = []
    pick = picker._pick
    monkeypatch.setattr(picker, "_pick", lambda reads, identity: seen.append({r["cluster"] for r in reads.select("cluster").collect()}) or pick(reads, identity))
    monkeypatch.setattr(picker, "BATCH_READS", 20)
    assert [sorted(map(repr, t.collect())) for t in picker.greedy_centroids(df, 0.95)] == whole
    assert 4 <= len(seen) <= 5 and sum(map(len, seen)) == len({c for c, _, _ in rows}) == len(set().union(*seen))


def first_takes_all(heads, open_reads):
    first = heads.where(F.col("rank") == 1).select("cluster", F.col("header").alias("target"))
    return open_reads.join(first, "cluster").select("cluster", F.col("header").alias("query"), "target", F.lit(1.0).alias("identity"))


def same_start(heads, open_reads):
    """A read joins the first read of the cluster that begins with the same letters."""
    start = F.substring(F.upper("read"), 1, 2)
    lead = Window.partitionBy("cluster", start).orderBy("rank")
    first = heads.withColumn("nth", F.row_number().over(lead)).where("nth = 1").select("cluster", start.alias("start"), F.col("header").alias("target"))
    named = open_reads.withColumn("start", start)
    return named.join(first, ["cluster", "start"]).select("cluster", F.col("header").alias("query"), "target", F.lit(0.5).alias("identity"))


def test_a_picker_that_takes_everything(spark, assigned_rows):
    df = spark.createDataFrame(assigned_rows, "cluster string, header string, read string")
    members, centroids = picker.subcluster(df, picker=first_takes_all)
    assert centroids.count() == 3 and members.count() == len(assigned_rows) - 3
    for row in centroids.collect():
        mine = sorted((-len(r), h) for c, h, r in assigned_rows if c == row["cluster"])
        assert row["centroid"] == mine[0][1]


def test_a_target_of_many_claims_is_ranked_once(spark, assigned_rows, monkeypatch):
    written = []

    def seen(df, name):
        table = session.materialise(df, name)
        written.append((name, table.count()))
        return table

    monkeypatch.setattr(picker, "materialise", seen)
    picker.subcluster(spark.createDataFrame(assigned_rows, "cluster string, header string, read string"), picker=first_takes_all)
    assert [n for name, n in written if name == "targets"] == [3]


def test_a_read_without_text_is_an_error(spark):
    rows = spark.createDataFrame([("c", "s_1", "ACGT" * 20), ("c", "s_2", None)], "cluster string, header string, read string")
    with pytest.raises(ValueError, match="without text"):
        picker.subcluster(rows)


def test_a_picker_works_in_rounds_and_must_claim_its_heads(spark, assigned_rows, monkeypatch):
    monkeypatch.setattr(picker, "FIRST_BATCH", 1)
    monkeypatch.setattr(picker, "LARGEST_BATCH", 2)
    df = spark.createDataFrame(assigned_rows, "cluster string, header string, read string")
    members, centroids = picker.subcluster(df, picker=same_start)
    first = {}
    for cluster, header, read in sorted(assigned_rows, key=lambda r: (r[0], -len(r[2]), r[1])):
        first.setdefault((cluster, read[:2].upper()), header)
    assert {(r["cluster"], r["centroid"]) for r in centroids.collect()} == {(c, h) for (c, _), h in first.items()}
    found = {(r["cluster"], r["query"]): r["target"] for r in members.collect()}
    assert found == {(c, h): first[c, r[:2].upper()] for c, h, r in assigned_rows if first[c, r[:2].upper()] != h}
    with pytest.raises(ValueError, match="without a claim"):
        picker.subcluster(df, picker=lambda heads, reads: first_takes_all(heads, reads).where("query = target"))
    nothing, none = picker.subcluster(df.limit(0), picker=first_takes_all)
    assert nothing.count() == 0 and none.count() == 0


def test_tables(spark):
    members = spark.createDataFrame(
        [("c4", "s1_1", "s1_9"), ("c4", "s1_2", "s1_9"), ("c4", "s2_1", "s1_9"), ("c5", "s2_7", "s3_3")],
        "cluster string, query string, target string",
    )
    centroids = spark.createDataFrame(
        [("c4", "s1_9", "ACG"), ("c5", "s3_3", "AC"), ("c5", "s4_4", "ACGT")], "cluster string, centroid string, read string"
    )
    otus = otu.number_otus(centroids)
    assert {r["centroid"]: r["otu"] for r in otus.collect()} == {"s1_9": "OTU_0", "s4_4": "OTU_1", "s3_3": "OTU_2"}
    counts = otu.otu_counts(members)
    partial = {r["sample"]: r.asDict() for r in otu.otu_pivot(counts).collect()}
    assert partial["s1"] == {"sample": "s1", "s1_9": 2, "s3_3": 0}
    parts = [counts.where("cluster = 'c4'"), counts.where("cluster = 'c5'")]
    table = otu.otu_table(otu.merge_otu_tables(parts, otus))
    assert [tuple(r) for r in table.collect()] == [("OTU_0", 2, 1), ("OTU_2", 0, 1)]
    with_own = {(r["centroid"], r["sample"]): r["n"] for r in otu.otu_counts(members, centroids).collect()}
    assert with_own[("s1_9", "s1")] == 3 and with_own[("s4_4", "s4")] == 1


def test_run_keeps_every_read_and_mixes_no_families(spark, tmp_path):
    found = families(31, 4, 25, 60, 1)
    rows = []
    for i, read in enumerate(sorted(found)):
        rows += [(f"s{j % 3}_{i}x{j}", read) for j in range(1 + i % 3)]
    first = rows[0][0]
    # a repeated header: the record that comes last in the file stays
    (tmp_path / "in.fa").write_text(f">{first}\n{rows[-1][1]}\n" + "".join(f">{h}\n{r}\n" for h, r in rows))
    run = run_to_folders(spark, str(tmp_path / "in.fa"), str(tmp_path / "out"), DivideParams(word_size=6, min_size=10, num_leaves=3))
    assert {(r["header"], r["read"]) for r in run.assigned.collect()} == set(rows)
    family = {h: found[r] for h, r in rows}
    members = run.members.collect()
    assert all(family[m["query"]] == family[m["target"]] for m in members)
    names = [r["centroid"] for r in run.otus.collect()]
    assert sorted([m["query"] for m in members] + names) == sorted(family)
    assert sum(r["n"] for r in run.counts.collect()) == len(members)
    table = tables.read_otu_table(spark, str(tmp_path / "out" / "otu_table"), "otu", "sample")
    assert sum(r["n"] for r in table.collect()) == len(members)
    assert fasta.read_clusters(spark, str(tmp_path / "out" / "clusters")).count() == len(rows)
    assert fasta.read_fasta(spark, str(tmp_path / "out" / "derep")).count() == len(found)
