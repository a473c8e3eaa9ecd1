"""Column expressions over reads, headers and cluster numbers. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four bases and their two-bit codes, in natural order. Any other letter
# counts as the first base.
BASES = "ACGT"
CODES = "0123"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_code(read: Column) -> Column:
    """Read as a string of base-4 digits; letters outside the four bases become 0."""
    return F.translate(F.regexp_replace(F.upper(read), f"[^{BASES}]", BASES[0]), BASES, CODES)


def pack(word: Column) -> Column:
    """A word of at most 15 bases as its big-endian base-4 number."""
    return F.conv(base_code(word), 4, 10).cast("bigint")


def kmers(read: Column, k: int) -> Column:
    """The ``length - k + 1`` overlapping k-mer numbers in reading order; empty for shorter reads."""
    windows = let(
        base_code(read),
        lambda code: F.transform(
            F.sequence(F.lit(1), F.length(code) - F.lit(k - 1)),
            lambda at: F.conv(F.substr(code, at, F.lit(k)), 4, 10).cast("bigint"),
        ),
    )
    return F.when(F.length(read) >= k, windows).otherwise(F.array().cast("array<bigint>"))


def reverse_complement(read: Column) -> Column:
    """The read on the other strand; letters outside the four bases stay as they are."""
    return F.reverse(F.translate(read, "ACGTacgt", "TGCAtgca"))


def kmer_distance(shared: Column, windows_a: Column, windows_b: Column) -> Column:
    """``1 - shared / min(windows)``, with the shared k-mers counted as multisets."""
    return F.lit(1.0) - shared / F.least(windows_a, windows_b)


def seq_id(read: Column) -> Column:
    """Identity of a unique read."""
    return F.md5(read)


def hash60(text: Column) -> Column:
    """First 60 bits of the MD5 of ``text`` as a non-negative bigint."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(15)), 16, 10).cast("bigint")


def pick_key(seed: int, cluster: Column, lm_ord: Column | int, seq: Column) -> Column:
    """Pseudo-random order of the members of a cluster, the same for every partitioning."""
    order = F.lit(lm_ord) if isinstance(lm_ord, int) else lm_ord
    return hash60(F.concat_ws("|", F.lit(str(seed)), cluster.cast("string"), order.cast("string"), seq))


def bucket_of(read: Column, buckets: int) -> Column:
    """Bucket of a read for the median of medians: a hash, so no physical partition matters."""
    first = F.conv(F.substr(F.md5(read), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return (first % F.lit(buckets)).cast("int")


def landmark_quota(size: Column) -> Column:
    """``ceil(log2(size))`` in integers; 0 for sizes below 2."""
    return F.when(size < 2, F.lit(0)).otherwise(F.length(F.bin(size - 1))).cast("int")


def landmark_count(size: Column) -> Column:
    """Landmarks a cluster of ``size`` reads gets: one less than the quota, but at least one."""
    return F.greatest(landmark_quota(size) - 1, F.lit(1)).cast("int")


def child_index(cluster: Column, side: Column) -> Column:
    """Heap number of a child: left is ``2c``, right ``2c + 1``."""
    return (cluster * F.lit(2).cast("bigint") + side).cast("bigint")


def depth_of(cluster: Column) -> Column:
    """Depth in the binary tree; the root 1 has depth 0."""
    return (F.length(F.bin(cluster)) - 1).cast("int")


def strip_blanks(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def format_header_set(headers: Column) -> Column:
    """``Set(h1, h2)``, the text form of a header set."""
    return F.concat(F.lit("Set("), F.concat_ws(", ", headers), F.lit(")"))


def parse_header_set(text: Column) -> Column:
    """Headers of ``Set(h1,h2)``; any other text is an error."""
    inner = F.regexp_extract(text, r"^Set[(](.+)[)]", 1)
    return F.when(inner != "", F.split(inner, ",")).otherwise(
        F.raise_error(F.concat(F.lit("not a header set: "), text)).cast("array<string>")
    )


def sample_of(header: Column) -> Column:
    """Sample of a ``<sample>_<index>`` header; more or fewer underscores are an error."""
    parts = F.split(header, "_")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(
        F.raise_error(F.concat(F.lit("header needs exactly one underscore: "), header)).cast("string")
    )
