"""One query per operator, each over whole tables. The matching SQL is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readgrove.functions import sequence as S
from readgrove.functions.alignment import alignment_distance
from readgrove.operators import assign, derep, kmers, landmarks, otu, picker, search, splits
from readgrove.plans.divide import DivideParams, divide, split
from readgrove.plans.otu_run import build_otus
from readgrove.session import materialise, scratch_path, small
from readgrove.sources import fasta, tables
from readgrove.streaming.assign import assign_new_files
from readgrove.workload import fixtures as X

K, FAMILIES, SAMPLES = X.K, X.FAMILIES, X.SAMPLES
TIGHT_RADIUS = 0.0123
ITERATIONS = 10
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- sources -------------------------------------------------------------------------------


def _fasta_of(reads: DataFrame, name: str) -> str:
    path = scratch_path(reads.sparkSession, name)
    fasta.write_fasta(reads, path)
    return path


@query
def fasta_scan(spark: SparkSession, sf: str) -> DataFrame:
    return fasta.read_fasta(spark, _fasta_of(X.reads_syn(spark, sf), "reads"))


@query
def fasta_parse(spark: SparkSession, sf: str) -> DataFrame:
    folded = F.regexp_replace(F.lower("read"), "(.{60})", "$1\n")
    path = _fasta_of(X.reads_any(spark, sf).withColumn("read", folded), "folded")
    return fasta.parse_fasta(fasta.read_fasta(spark, path))


@query
def header_lookup(spark: SparkSession, sf: str) -> DataFrame:
    path = _fasta_of(X.reads_syn(spark, sf), "reads")
    return fasta.reads_by_header(fasta.parse_fasta(fasta.read_fasta(spark, path), fold_case=False))


def _hits_path(hits: DataFrame) -> str:
    path = scratch_path(hits.sparkSession, "hits")
    tables.write_tsv(hits.select("header_set", "cluster", F.lit("97.5"), F.lit("128")), path)
    return path


@query
def hits_scan(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read_hits(spark, _hits_path(X.hits_syn(spark, sf)))


@query
def hits_union(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.reads_any(spark, sf).select(
        F.concat(F.lit("Set("), F.col("header"), F.lit(")")).alias("header_set"), F.col("source").alias("cluster")
    )
    return tables.read_hits(spark, [_hits_path(X.hits_syn(spark, sf)), _hits_path(docs)])


@query
def members_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "members")
    tables.write_tsv(X.members_syn(spark, sf).select("query", "target", "identity"), path)
    return tables.read_members(spark, path)


@query
def centroid_scan(spark: SparkSession, sf: str) -> DataFrame:
    folded = F.regexp_replace("read", "(.{50})", "$1\n")
    path = scratch_path(spark, "centroids")
    cents = X.centroids_syn(spark, sf).select("cluster", F.col("centroid").alias("header"), folded.alias("read"))
    fasta.write_clusters(cents, path)
    return fasta.read_centroids(spark, f"{path}/*")


@query
def otu_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "partial")
    tables.write_counts(otu.otu_counts(X.members_syn(spark, sf)), path, "sample", "centroid")
    return tables.read_otu_table(spark, path, "sample", "centroid")


@query
def otu_table_merge(spark: SparkSession, sf: str) -> DataFrame:
    """One written table per cluster, each with columns of its own, read back together."""
    path = scratch_path(spark, "partial_tables")
    tables.write_count_tables(otu.otu_counts(X.members_syn(spark, sf)), path, "cluster", "sample", "centroid")
    counts = tables.read_otu_table(spark, path, "sample", "centroid", table="cluster")
    return otu.merge_otu_tables([counts], otu.number_otus(X.centroids_syn(spark, sf))).where("n > 0")


# ---- sinks ---------------------------------------------------------------------------------


@query
def derep_sink(spark: SparkSession, sf: str) -> DataFrame:
    reads = X.reads_syn(spark, sf)
    path = scratch_path(spark, "derep")
    unique = materialise(derep.dereplicate(reads), "unique")
    fasta.write_derep(derep.header_sets(reads, unique), path)
    return fasta.parse_fasta(fasta.read_fasta(spark, path)).withColumnRenamed("header", "header_set")


@query
def partition_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "partition")
    fasta.write_partition(X.members_fixed(spark, sf), path)
    return fasta.parse_fasta(fasta.read_fasta(spark, path))


@query
def landmark_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "landmarks")
    fasta.write_landmarks(X.family_landmarks(X.members_fixed(spark, sf)), path)
    return fasta.parse_fasta(fasta.read_fasta(spark, path))


def _named(assigned: DataFrame) -> DataFrame:
    return assigned.withColumn("cluster", fasta.cluster_name(F.col("cluster")))


@query
def cluster_fanout_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "clusters")
    fasta.write_clusters(_named(X.assigned_syn(spark, sf)), path)
    return fasta.read_clusters(spark, path)


@query
def cluster_union(spark: SparkSession, sf: str) -> DataFrame:
    paths = [scratch_path(spark, "clusters"), scratch_path(spark, "clusters")]
    fasta.write_clusters(_named(X.assigned_syn(spark, sf)), paths[0])
    fasta.write_clusters(X.reads_any(spark, sf).withColumnRenamed("source", "cluster"), paths[1])
    return fasta.read_clusters(spark, paths)


@query
def cluster_count(spark: SparkSession, sf: str) -> DataFrame:
    return assign.count_clusters(X.assigned_syn(spark, sf))


@query
def centroid_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "otus")
    fasta.write_centroids(otu.number_otus(X.centroids_syn(spark, sf)), path)
    return fasta.parse_fasta(fasta.read_fasta(spark, path)).withColumnRenamed("header", "otu")


def _table_syn(spark: SparkSession, sf: str) -> DataFrame:
    counts = otu.otu_counts(X.members_syn(spark, sf))
    long = otu.merge_otu_tables([counts], otu.number_otus(X.centroids_syn(spark, sf)))
    return otu.otu_table(long, SAMPLES)


@query
def otu_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table_syn(spark, sf)


@query
def otu_table_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "otu_table")
    tables.write_otu_table(_table_syn(spark, sf), path)
    return tables.read_otu_table(spark, path, "otu", "sample")


# ---- projections and filters ---------------------------------------------------------------


@query
def abundance_filter(spark: SparkSession, sf: str) -> DataFrame:
    return derep.abundant(derep.dereplicate(X.reads_syn(spark, sf))).select("seq_id", "abundance")


@query
def base_code(spark: SparkSession, sf: str) -> DataFrame:
    ambiguous = F.translate(F.lower("read"), "g", "n")
    return X.reads_any(spark, sf).select("header", S.base_code(ambiguous).alias("code"))


@query
def kmer_index(spark: SparkSession, sf: str) -> DataFrame:
    starts = F.sequence(F.lit(1), F.length("read") - F.lit(K - 1))
    words = F.transform(starts, lambda at: F.substr("read", at, F.lit(K)))
    distinct = X.reads_doc(spark, sf).select(F.explode(words).alias("word")).distinct()
    return distinct.select("word", S.pack(F.col("word")).alias("kmer"))


@query
def kmer_explode(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.kmer_windows(X.seqs_doc(spark, sf), K)


@query
def strip_blanks(spark: SparkSession, sf: str) -> DataFrame:
    reads = X.reads_syn(spark, sf)
    sets = derep.header_sets(reads, materialise(derep.dereplicate(reads), "unique"))
    return sets.select("seq_id", S.strip_blanks(S.format_header_set(F.col("headers"))).alias("header_set"))


@query
def header_set_explode(spark: SparkSession, sf: str) -> DataFrame:
    return assign.explode_header_sets(X.hits_syn(spark, sf)).select("header", "cluster")


@query
def sample_extract(spark: SparkSession, sf: str) -> DataFrame:
    heads = X.reads_any(spark, sf).select("header").unionByName(X.reads_syn(spark, sf).select("header"))
    return heads.select("header", S.sample_of(F.col("header")).alias("sample"))


@query
def cluster_filter(spark: SparkSession, sf: str) -> DataFrame:
    return splits.in_cluster(X.members_fixed(spark, sf).select("seq_id", "cluster"), FAMILIES)


@query
def landmark_quota(spark: SparkSession, sf: str) -> DataFrame:
    sizes = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("size")).distinct()
    return sizes.select(
        "size", S.landmark_quota(F.col("size")).alias("quota"), S.landmark_count(F.col("size")).alias("m")
    )


# ---- distances and joins -------------------------------------------------------------------


@query
def attach_cluster(spark: SparkSession, sf: str) -> DataFrame:
    seqs = X.seqs_syn(spark, sf)
    labels = seqs.select("seq_id", (F.col("fam") + FAMILIES).alias("cluster"))
    return splits.attach_cluster(seqs.select("seq_id", "abundance"), labels)


def _root(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    members = materialise(X.members_fixed(spark, sf), "members")
    # the root is the ancestor four levels up
    return members.withColumn("cluster", F.shiftright("cluster", 4)), X.top_landmarks(members)


@query
def kmer_distance(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.landmark_distances(*_root(spark, sf)).withColumn("d", F.round("d", 9))


@query
def assign_side(spark: SparkSession, sf: str) -> DataFrame:
    measured = kmers.measured(*_root(spark, sf))
    sides = spark.range(FAMILIES).select(
        F.lit(1).cast("bigint").alias("cluster"), F.col("id").cast("int").alias("lm_ord"), (F.col("id") % 2).alias("side")
    )
    return splits.assign_side(measured, sides)


def _family(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    members = materialise(X.members_fixed(spark, sf), "members")
    return members, materialise(X.family_landmarks(members), "landmarks")


@query
def min_distance(spark: SparkSession, sf: str) -> DataFrame:
    nearest = landmarks.min_distance(kmers.measured(*_family(spark, sf)))
    return nearest.select("seq_id", "cluster", F.round("d_min", 9).alias("d_min"))


def _bucketed(spark: SparkSession, sf: str) -> DataFrame:
    nearest = landmarks.min_distance(kmers.measured(*_family(spark, sf)))
    return nearest.select("seq_id", "cluster", "bucket", F.col("d_min").alias("d"))


@query
def bucket_median(spark: SparkSession, sf: str) -> DataFrame:
    return landmarks.bucket_median(_bucketed(spark, sf)).withColumn("median", F.round("median", 9))


@query
def median_of_medians(spark: SparkSession, sf: str) -> DataFrame:
    medians = landmarks.bucket_median(_bucketed(spark, sf))
    return landmarks.median_of_medians(medians).withColumn("mom", F.round("mom", 9))


@query
def alignment_distances(spark: SparkSession, sf: str) -> DataFrame:
    members, lms = _family(spark, sf)
    n_landmarks, longest = lms.agg(F.count(F.lit(1)), F.max(F.length("read"))).first()
    texts = lms.select("cluster", "lm_ord", F.col("read").alias("landmark"))
    pairs = members.select("seq_id", "cluster", "read").join(small(texts, n_landmarks, 64 + (longest or 0)), "cluster")
    return pairs.select("seq_id", "lm_ord", F.round(alignment_distance("read", "landmark"), 9).alias("d"))


@query
def alignment_sweep(spark: SparkSession, sf: str) -> DataFrame:
    pairs = X.pairs_syn(spark, sf)
    return pairs.select("pair", F.round(alignment_distance("a", "b"), 9).alias("d"))


def _family_graph(spark: SparkSession, sf: str) -> DataFrame:
    return splits.landmark_graph(_family(spark, sf)[1])


@query
def landmark_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _family_graph(spark, sf).withColumn("weight", F.round("weight", 9))


@query
def landmark_graph_kmer(spark: SparkSession, sf: str) -> DataFrame:
    return splits.landmark_graph(_family(spark, sf)[1], "kmer").withColumn("weight", F.round("weight", 9))


@query
def medoid_radius(spark: SparkSession, sf: str) -> DataFrame:
    return splits.medoid_radius(_family_graph(spark, sf)).withColumn("radius", F.round("radius", 9))


@query
def radius_stop(spark: SparkSession, sf: str) -> DataFrame:
    leaves = splits.radius_leaf(_family_graph(spark, sf), TIGHT_RADIUS)
    return leaves.withColumn("radius", F.round("radius", 9))


@query
def pic_bisect(spark: SparkSession, sf: str) -> DataFrame:
    return splits.bisect(_family_graph(spark, sf), ITERATIONS)


def _search(spark: SparkSession, sf: str, metric: str) -> DataFrame:
    unique = X.either_strand(X.unique_syn(spark, sf).select("seq_id", "read"))
    reads = materialise(kmers.profiles(unique, K), "reads")
    found = search.nearest_landmark(reads, _family(spark, sf)[1], metric=metric, strand="both", k=K)
    return found.withColumn("identity", F.round("identity", 9))


@query
def nearest_landmark(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "kmer")


@query
def nearest_landmark_aligned(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "alignment")


@query
def nearest_landmark_short(spark: SparkSession, sf: str) -> DataFrame:
    """The best of few landmarks for short irregular reads: the likeliest by k-mers often is not."""
    reads = kmers.profiles(X.pairs_syn(spark, sf).select(F.col("pair").alias("seq_id"), F.col("a").alias("read")), 4)
    marks = kmers.profiles(X.segment_landmarks(spark, sf), 4)
    found = search.nearest_landmark(reads, marks, 0.5, strand="both", k=4)
    return found.withColumn("identity", F.round("identity", 9))


@query
def nearest_landmark_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The search of ``nearest_landmark_aligned`` over files of reads that come in as a stream."""
    path = scratch_path(spark, "incoming")
    reads = X.either_strand(X.unique_syn(spark, sf).select("seq_id", "read"))
    fasta.write_fasta(reads.withColumnRenamed("seq_id", "header").repartition(4), path)
    sink, checkpoint = scratch_path(spark, "found"), scratch_path(spark, "stream")
    found = assign_new_files(spark, path, _family(spark, sf)[1], sink, checkpoint, strand="both", k=K, files_at_once=2)
    found = found.withColumnRenamed("header", "seq_id").drop("batch")
    return found.withColumn("identity", F.round("identity", 9))


def _header_hits(spark: SparkSession, sf: str, reads: DataFrame | None = None) -> DataFrame:
    hits = assign.explode_header_sets(X.hits_syn(spark, sf, reads))
    return materialise(assign.dedupe_hits(hits, "seq_id"), "hits")


@query
def hit_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return _header_hits(spark, sf)


@query
def assign_all(spark: SparkSession, sf: str) -> DataFrame:
    reads = materialise(X.reads_syn(spark, sf), "reads")
    return assign.assign_all(fasta.reads_by_header(reads), _header_hits(spark, sf, reads))


@query
def unassigned_reads(spark: SparkSession, sf: str) -> DataFrame:
    reads = materialise(X.reads_syn(spark, sf), "reads")
    return assign.unassigned(fasta.reads_by_header(reads), _header_hits(spark, sf, reads))


@query
def assigned_reads(spark: SparkSession, sf: str) -> DataFrame:
    reads = materialise(X.reads_syn(spark, sf), "reads")
    return assign.assigned(fasta.reads_by_header(reads), _header_hits(spark, sf, reads))


@query
def observed_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return assign.observed_clusters(X.hits_syn(spark, sf))


@query
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    return assign.cluster_members(X.assigned_syn(spark, sf))


# ---- aggregations --------------------------------------------------------------------------


@query
def stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    reads = X.reads_syn(spark, sf)
    return derep.stage_counts(reads, derep.dereplicate(reads))


@query
def dereplicate(spark: SparkSession, sf: str) -> DataFrame:
    reads = X.reads_syn(spark, sf)
    unique = materialise(derep.dereplicate(reads), "unique")
    sets = derep.header_sets(reads, unique)
    return sets.join(unique.select("seq_id", "abundance"), "seq_id").select(
        "seq_id", F.concat_ws(",", "headers").alias("headers"), "abundance"
    )


@query
def abundance(spark: SparkSession, sf: str) -> DataFrame:
    return X.seqs_doc(spark, sf).select("seq_id", "abundance")


@query
def kmer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.kmer_counts(X.seqs_doc(spark, sf), K)


@query
def kmer_counts_strict(spark: SparkSession, sf: str) -> DataFrame:
    """K-mer counts of reads with letters outside the four bases, whose windows are left out."""
    reads = X.reads_doc(spark, sf).withColumn("read", F.translate("read", "G", "N"))
    return kmers.kmer_counts(derep.dereplicate(reads), K, ambiguous="skip")


@query
def stage_counts_observed(spark: SparkSession, sf: str) -> DataFrame:
    return derep.dereplicate_counted(X.reads_syn(spark, sf))[1]


@query
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return splits.cluster_sizes(X.members_fixed(spark, sf))


@query
def largest_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return splits.largest_cluster(splits.cluster_sizes(X.members_fixed(spark, sf)))


@query
def side_summary(spark: SparkSession, sf: str) -> DataFrame:
    sides = _family(spark, sf)[1].select("cluster", "lm_ord", (F.col("lm_ord") % 2).alias("side"))
    return splits.side_summary(sides).withColumn("landmarks", F.concat_ws(",", "landmarks"))


@query
def cluster_tree(spark: SparkSession, sf: str) -> DataFrame:
    return splits.cluster_tree(splits.cluster_sizes(X.members_fixed(spark, sf)))


@query
def otu_counts(spark: SparkSession, sf: str) -> DataFrame:
    return otu.otu_counts(X.members_syn(spark, sf))


@query
def otu_counts_with_centroid(spark: SparkSession, sf: str) -> DataFrame:
    return otu.otu_counts(X.members_syn(spark, sf), X.centroids_syn(spark, sf))


@query
def otu_pivot(spark: SparkSession, sf: str) -> DataFrame:
    by_cluster = otu.otu_counts(X.members_syn(spark, sf)).withColumn("centroid", F.concat(F.lit("c"), "cluster"))
    return otu.otu_pivot(by_cluster, [f"c{c}" for c in range(FAMILIES, 2 * FAMILIES)])


@query
def otu_rename(spark: SparkSession, sf: str) -> DataFrame:
    counts = otu.otu_counts(X.members_syn(spark, sf))
    return otu.rename_otus(counts, otu.number_otus(X.centroids_syn(spark, sf)))


# ---- picks and orders ----------------------------------------------------------------------


@query
def seeded_pick(spark: SparkSession, sf: str) -> DataFrame:
    return landmarks.pick_one(X.members_fixed(spark, sf).select("seq_id", "cluster", "read"), "cluster", 0)


@query
def length_rank(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.reads_any(spark, sf).withColumnRenamed("source", "cluster")
    return picker.length_rank(docs).select("cluster", "header", "rank")


@query
def otu_numbering(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.reads_any(spark, sf).select(F.col("source").alias("cluster"), F.col("header").alias("centroid"), "read")
    return otu.number_otus(docs).select("cluster", "centroid", "otu_num", "otu")


# ---- iterative -----------------------------------------------------------------------------


def _active(members: DataFrame) -> tuple[DataFrame, landmarks.Extent]:
    sizes = splits.cluster_sizes(members)
    active = materialise(sizes.select("cluster", "size", S.landmark_count(F.col("size")).alias("m")), "active")
    longest = members.agg(F.max(F.length("read"))).first()[0] or 0
    return active, landmarks.Extent.of(active, longest)


@query
def select_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    members = materialise(X.members_fixed(spark, sf), "members")
    chosen, _ = landmarks.select_landmarks(members, *_active(members), k=K)
    return chosen.select("cluster", "lm_ord", "seq_id")


@query
def select_landmarks_aligned(spark: SparkSession, sf: str) -> DataFrame:
    members = materialise(X.members_fixed(spark, sf), "members")
    chosen, _ = landmarks.select_landmarks(members, *_active(members), k=K, metric="alignment")
    return chosen.select("cluster", "lm_ord", "seq_id")


@query
def split_once(spark: SparkSession, sf: str) -> DataFrame:
    members = materialise(X.members_fixed(spark, sf), "members")
    params = DivideParams(radius=TIGHT_RADIUS, iterations=ITERATIONS)
    done = split(members, *_active(members), params)
    return done.decisions.withColumn("radius", F.round("radius", 9))


def _division(spark: SparkSession, sf: str, num_leaves: int = 8):
    return divide(X.seqs_syn(spark, sf), DivideParams(num_leaves=num_leaves))


@query
def divide_reads(spark: SparkSession, sf: str) -> DataFrame:
    return _division(spark, sf).labels.select("seq_id", "cluster")


@query
def divide_unlimited(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for any division, of one without a leaf target: one row of counts."""
    done = divide(X.seqs_syn(spark, sf), DivideParams(num_leaves=0, radius=TIGHT_RADIUS))
    leaves = done.tree.where("is_leaf").select("cluster", "size")
    inner = splits.cluster_tree(leaves).join(leaves.select("cluster"), "cluster", "left_anti").select("cluster")
    sizes = leaves.agg(F.sum("size").alias("in_leaves"))
    labels = done.labels.agg(F.count(F.lit(1)).alias("labels"), F.count_distinct("seq_id").alias("reads"))
    # labels under a cluster that is split further, or that is no leaf
    wrong = done.labels.join(leaves, "cluster", "left_anti").agg(F.count(F.lit(1)).alias("outside_leaves"))
    nested = inner.join(done.labels, "cluster", "left_semi").agg(F.count(F.lit(1)).alias("nested"))
    tables = [t.withColumn("one", F.lit(1)) for t in (labels, sizes, wrong, nested)]
    joined = tables[0]
    for t in tables[1:]:
        joined = joined.join(t, "one")
    return joined.drop("one")


@query
def short_reads(spark: SparkSession, sf: str) -> DataFrame:
    letters = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    return kmers.short_reads(X.table(spark, sf, "documents").select(letters.alias("read")), K)


@query
def subcluster_picker(spark: SparkSession, sf: str) -> DataFrame:
    """Units by a picker of one's own, in rounds: the first read of a cluster takes all others."""

    def first_takes_all(heads, open_reads):
        first = heads.where(F.col("rank") == 1).select("cluster", F.col("header").alias("target"))
        claims = open_reads.join(small(first, first.count(), 128), "cluster")
        return claims.select("cluster", F.col("header").alias("query"), "target", F.lit(1.0).alias("identity"))

    return picker.subcluster(X.assigned_syn(spark, sf), picker=first_takes_all)[0]


@query
def subcluster_many(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy units where a cluster has very many centroids."""
    members, _ = picker.subcluster(X.reads_many(spark, sf).drop("fam"))
    return members.withColumn("identity", F.round("identity", 9))


@query
def leaf_landmarks(spark: SparkSession, sf: str) -> DataFrame:
    return _division(spark, sf).leaf_landmarks


@query
def subcluster(spark: SparkSession, sf: str) -> DataFrame:
    members, _ = picker.subcluster(X.assigned_syn(spark, sf))
    return members.withColumn("identity", F.round("identity", 9))


@query
def otu_end_to_end(spark: SparkSession, sf: str) -> DataFrame:
    reads = materialise(X.reads_syn(spark, sf).select("header", "read"), "reads")
    return build_otus(reads, DivideParams(num_leaves=8)).counts


#: Four leaves by k-mer graphs, a division that SQL can follow split by split.
FOUR = DivideParams(num_leaves=4, graph_metric="kmer")


@query
def divide_kmer(spark: SparkSession, sf: str) -> DataFrame:
    return divide(X.seqs_syn(spark, sf), FOUR).labels.select("seq_id", "cluster")


@query
def leaf_landmarks_kmer(spark: SparkSession, sf: str) -> DataFrame:
    return divide(X.seqs_syn(spark, sf), FOUR).leaf_landmarks


@query
def otu_end_to_end_kmer(spark: SparkSession, sf: str) -> DataFrame:
    reads = materialise(X.reads_syn(spark, sf).select("header", "read"), "reads")
    return build_otus(reads, FOUR, metric="kmer").counts


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """``cluster, size, n_landmarks`` of the leaves of the divided reads."""
    done = _division(spark, sf)
    counts = done.leaf_landmarks.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_landmarks"))
    return done.tree.where("is_leaf").select("cluster", "size").join(counts, "cluster", "left")


QUERIES["divide"] = QUERIES.pop("divide_reads")
QUERIES["alignment_distance"] = QUERIES.pop("alignment_distances")
