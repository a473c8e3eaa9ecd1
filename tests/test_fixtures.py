"""What the queries' input is dealt to: tasks of bounded size, whatever the size of the tables."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readgrove.functions import profile
from readgrove.workload import fixtures as X


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("lines"))
    n = F.col("id")
    rows = spark.range(4000).select(
        F.when(n % 50 > 0, F.floor(n / 4)).alias("l_orderkey"), (n % 300).alias("l_partkey"), (n % 100).alias("l_suppkey"),
        (n % 4 + 1).cast("int").alias("l_linenumber"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("make", [X.reads_syn, X.reads_many, X.assigned_syn, X.members_syn])
def test_no_task_gets_more_rows_than_planned(spark, lines, monkeypatch, make):
    whole = make(spark, lines).collect()
    monkeypatch.setattr(X, "TASK_ROWS", 100)
    dealt = make(spark, lines)
    most = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    assert most < 200
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, whole))


def test_reads_of_line_items_are_told_apart_by_header(spark, tmp_path):
    """Numbers that two orders share, repeated lines, and nulls, of which none has a header."""
    rows = [(1, 7, 3, 12), (2, 7, 3, 2), (2, 7, 11, 2), (2, 7, 4, 2), (5, 7, 3, 1), (5, 7, 3, 1), (9, 8, 3, 1)]
    rows += [(None, 7, 3, 1), (4, None, 3, 1), (4, 7, None, 1), (6, 7, None, 3), (4, 7, 3, None), (None, None, None, None)]
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for order, part, supplier, line in rows:
        header = read = None
        if None not in (order, part, supplier, line):
            header = f"s{supplier % 8}_{order * 10 + line}p{part}"
        if None not in (order, part, line):
            digits = "".join(hashlib.md5(f"{x}{part}".encode()).hexdigest() for x in "abcd")
            base, place = digits.translate(str.maketrans("0123456789abcdef", "ACGT" * 4)), order % 128
            read = base[:place] + "ACGT"[line % 4] + base[place + 1 :]
        key = (None if part is None else part % 4, part, header)
        want[key] = max((r for r in (want.get(key), read) if r is not None), default=None)
    got = [tuple(r) for r in X.reads_many(spark, str(tmp_path)).select("cluster", "fam", "header", "read").collect()]
    assert sorted(got, key=repr) == sorted(((*k, r) for k, r in want.items()), key=repr)


def test_tokens_are_made_in_slices(monkeypatch):
    reads = pa.array(["ACGTTGCA" * 9, "", "AC", "NNACGTAC" * 30, "TTTTTTTTT", "ACGTTGCAAC" * 4] * 5)
    want = [profile.tokens_of(reads, 4, ambiguous).to_pylist() for ambiguous in ("as_a", "skip")]
    sizes = []
    made = profile._tokens_of
    monkeypatch.setattr(profile, "LETTERS", 100)
    monkeypatch.setattr(profile, "_tokens_of", lambda read, *a: sizes.append((len(read), sum(map(len, read.to_pylist())))) or made(read, *a))
    assert [profile.tokens_of(reads, 4, ambiguous).to_pylist() for ambiguous in ("as_a", "skip")] == want
    assert all(n == 1 or letters <= 340 for n, letters in sizes) and len(sizes) > 10
