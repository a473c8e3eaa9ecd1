"""Document fingerprints: the k smallest distinct hashes of a text's shingles.

A sketch is a sorted array of bigints. Sketches of parts merge to that of the whole, and two sketches
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
#: Hashes kept of a text. A resemblance r is estimated with a deviation of sqrt(r * (1 - r) / K).
K = 128
#: Hashes are that many bits, so that they are exact as doubles and short as text.
BITS = 48
SEED = 13
#: Bytes of a text split into words at a time.
PIECE = 1 << 20
SPACE = re.compile(rb"[ \t-\r]")
#: Bytes of text that a bucket of neighbouring documents holds, about, and how many buckets there are at most.
BUCKET_BYTES, BUCKETS = 32 << 20, 16_384
#: Characters of edited texts sent back at a time.
BATCH_CHARS = 4 << 20
#: Keys that a group's sketches are spread over before they meet.
SPREAD = 16


# ---- shingles and sketches in a task


def text_words(text: str) -> Iterator[list[bytes]]:
    """Words between ASCII white space, A-Z in lower case, in lists that stay small for any length of text."""
    data = text.encode("utf-8")
    start = 0
    while start < len(data):
        gap = SPACE.search(data, start + PIECE) if start + PIECE < len(data) else None
        stop = gap.start() if gap else len(data)
        yield data[start:stop].lower().split()
        start = stop


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """One hash for each run of ``shingle`` words."""
    rows = map(b" ".join, zip(*(words[n:] for n in range(shingle)), strict=False))
    found = np.fromiter(map(partial(xxhash.xxh3_64_intdigest, seed=SEED), rows), np.uint64)
    return (found >> np.uint64(64 - BITS)).astype(np.int64)


def smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` smallest distinct hashes, sorted."""
    if len(hashes) > 8 * k:
        some = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(some) >= k:
            return some[:k]
    return np.unique(hashes)[:k]


def sketch(text: str | None, shingle: int = SHINGLE, k: int = K) -> np.ndarray:
    """The sketch of a text, merged from its parts; fewer words than a shingle are one, none are nothing."""
    found, tail = np.zeros(0, np.int64), []
    for words in text_words(text or ""):
        words = tail + words
        found = smallest(np.concatenate([found, shingle_hashes(words, shingle)]), k)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not len(found) and tail:
        found = shingle_hashes(tail, len(tail))
    return found


# ---- sketches as columns


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated shared part of all distinct shingles, from 0 to 1; of two empty sketches 1."""
    joint = merged(a, b, k)
    return F.when(F.size(joint) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(joint, a), b)) / F.size(joint))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact for texts of fewer than ``k``."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * 2.0**BITS) / F.array_max(a))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first one's shingles that the second one has, from 0 to 1."""
    shared = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / F.greatest(F.lit(1.0), distinct_shingles(a, k))))


def sketch_text(a: Column) -> Column:
    """A sketch as text: twelve hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), BITS // 4, "0"))), "")


# ---- operators


def text_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = K) -> DataFrame:
    """``doc_id, sketch`` per row of ``docs``.

    Null and empty texts and texts without words have an empty sketch; equal texts have equal ones;
    whole texts are read. Rows come back as often as given, null ids too; other columns are ignored; an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(text.as_py(), shingle, k) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "sketch"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, sketch array<long>")
    return out.withColumnRenamed("id", id_col)


def _merge_runs(frames: Iterator[pd.DataFrame], by: list[str], name: str, k: int) -> Iterator[pd.DataFrame]:
    """Merges the sketches of each group in a batch; one that may go on in the next batch waits for it."""
    wait = None
    for frame in frames:
        frame = frame if wait is None else pd.concat([wait, frame], ignore_index=True)
        if not len(frame):
            continue
        rows = []
        for key, of in frame.groupby(by, sort=False, dropna=False)[name]:
            rows.append((*key, smallest(np.concatenate(of.to_list()).astype(np.int64), k)))
        merged_rows = pd.DataFrame(rows, columns=[*by, name])
        yield merged_rows[:-1]
        wait = merged_rows[-1:]
    if wait is not None:
        yield wait


def merge_sketches(sketches: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """``by, sketch``: the sketch of all texts of each group, from the sketches of its rows.

    Every task merges what it holds, a group is then spread over ``SPREAD`` keys and merged again, and
    only those few sketches of a group meet, so that a group may hold any share of the rows. Null keys are
    a group of their own; empty sketches change nothing; an empty table gives no group.
    """
    empty = F.array().cast("array<bigint>")
    rows = sketches.select(*by, F.coalesce(F.col(sketch_col).cast("array<bigint>"), empty).alias(sketch_col))
    merge = partial(_merge_runs, by=by, name=sketch_col, k=k)
    some = rows.mapInPandas(merge, rows.schema).withColumn("_spread", F.spark_partition_id() % SPREAD)
    few = some.repartition(*by, "_spread").sortWithinPartitions(*by).drop("_spread").mapInPandas(merge, rows.schema)
    return few.repartition(*by).sortWithinPartitions(*by).mapInPandas(merge, rows.schema)


def _bucketed(batches: Iterator[pa.RecordBatch], tops: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows with the bucket of their id, and once more for the bucket that ends where theirs begins."""
    last = max(0, len(tops) - 1)
    for batch in batches:
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        value = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        bucket = np.where(known & (len(tops) > 0), np.minimum(np.searchsorted(tops, value), last), 0)
        # the row an earlier bucket ends on: the largest id of this one, or any if there are no ids at all
        first = known & (tops[bucket] == value) if len(tops) else ~known
        more = np.flatnonzero(first)
        rows = batch.take(pa.array(np.concatenate([np.arange(batch.num_rows), more])))
        to = np.concatenate([bucket, (bucket[more] + 1) % (last + 1)])
        lent = np.repeat([False, True], [batch.num_rows, len(more)])
        yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(lent), *rows.columns], ["bucket", "lent", "id", "text"])


def _followed(batches: Iterator[pa.RecordBatch], shingle: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each row with the row after it; rows come sorted, the lent row of a bucket after its own ones."""
    names = ["id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch"]
    types = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 3]
    out, size, wait, closed = [], 0, None, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    for batch in batches:
        for bucket, lent, id_, text in zip(*batch.columns, strict=True):
            bucket, lent, text = bucket.as_py(), lent.as_py(), text.as_py()
            if lent and closed == bucket:
                continue  # further rows of the id that the next bucket begins with
            own = sketch(text, shingle, k)
            if wait:
                before, own_before = wait[2], wait[3]
                half = len(before) // 2
                edited = before[: len(before) - half] + text[:half]
                out.append((wait[1].as_py(), len(before), edited, own_before, sketch(edited, shingle, k) if half else own_before, own))
                size += len(edited)
                if size > BATCH_CHARS:
                    yield made()
                    out, size = [], 0
            wait, closed = (None, bucket) if lent else ((bucket, id_, text, own), None)
    if wait:
        raise ValueError("a bucket of documents has no document after it")
    if out:
        yield made()


def followed_sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, k: int = K, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_chars, edited, sketch, edited_sketch, next_sketch`` per row of ``docs``.

    Documents follow one another by descending id, after the last comes the first. ``edited`` is the text
    with its second half, rounded down, replaced by as many characters of the next one's beginning, or
    all of it. Null text is empty. Rows of one id follow by text, rows without an id come last; rows come
    back as often as given; a single row follows itself; other columns are ignored; an empty table gives
    an empty result.

    Buckets are ranges of ids that end on ids of the table. Texts are sent once, to their bucket; the
    first row of a bucket also goes to the one that ends there, so no bucket waits for another.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    top, size = rows.agg(F.max("id"), F.sum(F.octet_length("text"))).first()
    n = min(BUCKETS, -(-(size or 0) // bucket_bytes) or 1)
    tops = [] if top is None else [top]
    if n > 1 and top is not None:
        # percentiles are ids of the table; their summary has a bounded size
        tops += rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 16 * n)).first()[0]
    tops = np.array(sorted(set(tops)), np.int64)
    dealt = rows.mapInArrow(partial(_bucketed, tops=tops), "bucket int, lent boolean, id long, text string")
    dealt = dealt.repartitionById(max(1, len(tops)), "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "lent", F.desc_nulls_last("id"), "text")
    out = "id long, n_chars long, edited string, sketch array<long>, edited_sketch array<long>, next_sketch array<long>"
    return dealt.mapInArrow(partial(_followed, shingle=shingle, k=k), out).withColumnRenamed("id", id_col)
