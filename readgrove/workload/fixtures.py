"""Reads derived from the given tables: planted families from ``lineitem``, whole ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readgrove.functions.sequence import landmark_count, reverse_complement
from readgrove.operators.derep import abundant, dereplicate, header_sets
from readgrove.operators.kmers import profiles
from readgrove.session import materialise, small

K = 8
FAMILIES = 16
SAMPLES = [f"s{i}" for i in range(8)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a given table in one task, so that what a task sorts does not grow with the table. Written as they are, they
#: are as many files, of which a task reads a bounded number whatever their size, as Spark reckons 4 MB to open one.
TASK_ROWS = 250_000


def tasks_for(df: DataFrame) -> int:
    """How many tasks a given table is dealt to, counted from the footers of its files."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a given table, which can be a single file, over all cores and in parts of bounded size."""
    return df.repartition(tasks_for(df))


def by_key(reads: DataFrame, spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    """Reads of line items dealt by key in parts of bounded size, in which they can be grouped by it as they are."""
    return reads.repartition(tasks_for(table(spark, sf_dir, "lineitem")), *keys)


def reads_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fam, header, read``: a read of 128 bases per line item, one substitution from its family."""
    place = (F.col("l_suppkey") % 128).cast("int") + 1
    letter = F.substr(F.lit("ACGT"), (F.col("l_linenumber") % 4).cast("int") + 1, F.lit(1))
    header = F.concat(
        F.lit("s"), (F.col("l_suppkey") % 8).cast("string"), F.lit("_"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string"),
    )
    lines = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    lines = lines.select(
        (F.col("l_partkey") % FAMILIES).alias("fam"), header.alias("header"), place.alias("place"), letter.alias("letter")
    )
    quarters = [F.md5(F.concat(F.lit(letter), F.col("fam").cast("string"))) for letter in "abcd"]
    base = F.translate(F.concat(*quarters), "0123456789abcdef", "ACGTACGTACGTACGT")
    # one row per family, and there are FAMILIES of them
    fams = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % FAMILIES).alias("fam"))
    bases = fams.distinct().withColumn("base", base)
    read = F.concat(
        F.substr("base", F.lit(1), F.col("place") - 1), F.col("letter"), F.substr("base", F.col("place") + 1)
    )
    return lines.join(F.broadcast(bases), "fam").select("fam", "header", read.alias("read"))


def either_strand(reads: DataFrame) -> DataFrame:
    """About half the reads, by the first digit of ``seq_id``, as their reverse complement."""
    read = F.when(F.substr("seq_id", F.lit(1), F.lit(1)) < "8", reverse_complement(F.col("read"))).otherwise(F.col("read"))
    return reads.withColumn("read", read)


def reads_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster, fam, header, read``: four clusters with a family of reads for each part, nearly all unique."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    sample, number = (F.col("l_suppkey") % 8), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    place, letter = (F.col("l_orderkey") % 128).cast("int") + 1, F.substr(F.lit("ACGT"), (F.col("l_linenumber") % 4).cast("int") + 1, F.lit(1))
    # what a header is made of is dealt in its place, and none where there is no header
    known = F.col("l_partkey").isNotNull() & sample.isNotNull() & number.isNotNull()
    rows = lines.select("l_partkey", F.when(known, sample).alias("sample"), F.when(known, number).alias("number"), place.alias("place"), letter.alias("letter"))
    dealt = by_key(rows, spark, sf_dir, "l_partkey", "sample", "number")
    part = F.col("l_partkey").cast("string")
    base = F.translate(F.concat(*(F.md5(F.concat(F.lit(x), part)) for x in "abcd")), "0123456789abcdef", "ACGTACGTACGTACGT")
    read = F.concat(F.substr("base", F.lit(1), F.col("place") - 1), F.col("letter"), F.substr("base", F.col("place") + 1))
    reads = dealt.withColumn("base", base).withColumn("read", read).groupBy("l_partkey", "sample", "number").agg(F.max("read").alias("read"))
    header = F.concat(F.lit("s"), F.col("sample").cast("string"), F.lit("_"), F.col("number").cast("string"), F.lit("p"), part)
    return reads.select((F.col("l_partkey") % 4).alias("cluster"), F.col("l_partkey").alias("fam"), header.alias("header"), "read")


def reads_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``header, read, source``: the base letters of every whole document, where there are enough for a k-mer."""
    return reads_any(spark, sf_dir).where(F.length("read") >= K)


def reads_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``header, read, source``: the base letters of every whole document that has one."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    read = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    header = F.concat_ws("_", "source", F.col("doc_id").cast("string"))
    return docs.select(header.alias("header"), read.alias("read"), "source").where(F.length("read") > 0)


def pairs_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pair, a, b``: irregular short reads of every customer, unrelated or one cut out of the other."""
    key = F.col("c_custkey")
    bases = lambda name: F.translate(F.md5(name), "0123456789abcdef", "ACGTACGTACGTACGT")
    first = F.substr(bases(F.col("c_name")), F.lit(1), (key % 13 + 12).cast("int"))
    other = F.substr(bases(F.concat(F.col("c_name"), F.lit("x"))), F.lit(1), (key % 11 + 12).cast("int"))
    cut = (key % 5 + 3).cast("int")
    mended = F.concat(F.substr(first, F.lit(1), cut), F.substr(first, cut + (key % 4).cast("int") + 1), F.substr(other, F.lit(1), (key % 3).cast("int")))
    second = F.when(key % 2 == 0, other).otherwise(mended)
    return spread(table(spark, sf_dir, "customer")).select(key.alias("pair"), first.alias("a"), second.alias("b"))


def segment_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster, lm_ord, read``: the first customer's short read of every market segment."""
    first = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("cluster")).agg(F.min("c_custkey").alias("pair"))
    marks = pairs_syn(spark, sf_dir).join(F.broadcast(first), "pair")  # as many as there are segments
    return marks.select("cluster", F.lit(0).alias("lm_ord"), F.col("a").alias("read"))


def unique_syn(spark: SparkSession, sf_dir: str, reads: DataFrame | None = None) -> DataFrame:
    """``seq_id, read, abundance, fam`` of every unique read of the families."""
    reads = reads_syn(spark, sf_dir) if reads is None else reads
    fams = reads.groupBy("read").agg(F.min("fam").alias("fam"))
    return dereplicate(reads).join(fams, "read").select("seq_id", "read", "abundance", "fam")


def seqs_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abundant(unique_syn(spark, sf_dir))


def seqs_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dereplicate(reads_doc(spark, sf_dir))


def members_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq_id, read, profile, bucket, cluster``: every family is one cluster of depth 4."""
    labelled = seqs_syn(spark, sf_dir).select("seq_id", "read", (F.col("fam") + FAMILIES).alias("cluster"))
    return profiles(labelled, K)


def family_landmarks(members: DataFrame) -> DataFrame:
    """Per family its full number of landmarks: the reads with the smallest ``seq_id``."""
    quotas = members.groupBy("cluster").agg(landmark_count(F.count(F.lit(1))).alias("m"))
    quotas = materialise(quotas, "quotas")
    n_clusters, most = quotas.agg(F.count(F.lit(1)), F.max("m")).first()
    # the rank limit is applied before the shuffle, so a family sends few rows of each task
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("seq_id"))
    ranked = members.withColumn("rank", rank).where(F.col("rank") <= (most or 0))
    ranked = ranked.join(small(quotas, n_clusters, 64), "cluster").where(F.col("rank") <= F.col("m"))
    return ranked.select("cluster", (F.col("rank") - 1).alias("lm_ord"), "seq_id", "read", "profile")


def top_landmarks(members: DataFrame) -> DataFrame:
    """One landmark per family, all of the root cluster, numbered by family."""
    chosen = members.groupBy("cluster").agg(F.min(F.struct("seq_id", "read", "profile")).alias("lm"))
    return chosen.select(
        F.shiftright("cluster", 4).alias("cluster"), (F.col("cluster") - FAMILIES).cast("int").alias("lm_ord"),
        "lm.seq_id", "lm.read", "lm.profile",
    )


def hits_syn(spark: SparkSession, sf_dir: str, reads: DataFrame | None = None) -> DataFrame:
    """``header_set, cluster, seq_id``: a hit of its family for every abundant read.

    The reads are written once, or given as the table that has them.
    """
    reads = materialise(reads_syn(spark, sf_dir), "reads") if reads is None else reads
    unique = materialise(unique_syn(spark, sf_dir, reads), "unique")
    sets = header_sets(reads, unique)
    text = F.concat(F.lit("Set("), F.concat_ws(",", "headers"), F.lit(")"))
    fams = abundant(unique).select("seq_id", "fam")
    return sets.join(fams, "seq_id").select(
        text.alias("header_set"),
        F.concat(F.lit("cluster_"), (F.col("fam") + FAMILIES).cast("string")).alias("cluster"),
        "seq_id",
    )


def assigned_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster, header, read``: every family and header once."""
    dealt = by_key(reads_syn(spark, sf_dir), spark, sf_dir, "fam", "header")
    reads = dealt.groupBy("fam", "header").agg(F.max("read").alias("read"))
    return reads.select((F.col("fam") + FAMILIES).alias("cluster"), "header", "read")


def members_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster, query, target, identity``: every header of a family under the smallest one."""
    heads = by_key(reads_syn(spark, sf_dir).select("fam", "header"), spark, sf_dir, "fam", "header").distinct()
    first = heads.groupBy("fam").agg(F.min("header").alias("target"))
    rows = heads.join(small(first, FAMILIES, 64), "fam").where(F.col("header") != F.col("target"))
    return rows.select(
        (F.col("fam") + FAMILIES).alias("cluster"), F.col("header").alias("query"), "target", F.lit(0.99).alias("identity")
    )


def centroids_syn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cluster, centroid, read`` of the families."""
    first = F.min(F.struct("header", "read")).alias("first")
    picked = assigned_syn(spark, sf_dir).groupBy("cluster").agg(first)
    return picked.select("cluster", F.col("first.header").alias("centroid"), "first.read")
