"""Benchmark passages in documents, by the q-gram lemma in diagonal bands and banded alignment.

Texts are compared with letters in lower case and white space runs as one space. A passage is a
window of a benchmark item. If a document has it with at most k edits, the two share at least
``w + 1 - q * (k + 1)`` q-grams, and these lie on diagonals that differ by at most k, so they all fall
in one of the bands of 2k + 2 diagonals that start every k + 1. Passages too short for that bound to be
positive are looked for by shorter q-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest q-grams; items with fewer characters are not looked for.
Q = 10
#: Characters of a passage, and between the starts of two passages of an item.
WINDOW, STRIDE = 100, 10
#: Edits allowed in a passage, as a share of its characters.
EDITS = 0.08
#: Characters of benchmark items indexed at once; a larger benchmark is searched shard by shard.
SHARD_CHARS = 8_000_000
#: Characters of documents searched at once.
PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15
TABLE_BITS = 22


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of every q characters, made of those of 1, 2, 4, ... characters."""
    if len(codes) < q:
        return np.zeros(0, np.uint64)
    total, done, level, size = None, 0, codes, 1
    while True:
        if q & size:
            part = level[q - done - size :] if total is None else level[q - done - size : q - done - size + len(total)]
            total = part if total is None else part * _power(done) + total
            done += size
        if done == q:
            return total[: len(codes) - q + 1]
        level = level[:-size] * _power(size) + level[size:]
        size *= 2


@dataclass
class Grams:
    """The q-grams of those items whose passages are looked for by that q."""

    q: int
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray

    @staticmethod
    def of(q: int, texts: dict[int, str]) -> Grams:
        hashes = [gram_hashes(_codes(text), q) for text in texts.values()]
        flat = np.concatenate(hashes)
        item = np.repeat(list(texts), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[order], return_index=True)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[_slot(grams)] = True
        return Grams(q, grams, np.append(first, len(flat)), item[order], place[order], table)


@dataclass
class Index:
    """A shard of benchmark items and their q-grams."""

    ids: list
    texts: list[str]
    parts: list[Grams]
    least: np.ndarray
    band: int
    longest: int

    @staticmethod
    def of(ids: list, texts: list[str]) -> Index:
        by_q: dict[int, dict[int, str]] = {}
        for n, text in enumerate(texts):
            if len(text) >= Q:
                by_q.setdefault(gram_size(min(WINDOW, len(text))), {})[n] = text
        parts = [Grams.of(q, of) for q, of in sorted(by_q.items())]
        least = np.array([_shared(min(WINDOW, len(t))) for t in texts], np.int64)
        return Index(ids, texts, parts, least, int(EDITS * WINDOW) + 1, max(map(len, texts), default=0))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - TABLE_BITS)


def passages(length: int) -> Iterator[tuple[int, int]]:
    """Start and end of the passages of an item of that many characters."""
    last = max(0, length - WINDOW)
    for start in [*range(0, last, STRIDE), last]:
        yield start, min(length, start + WINDOW)


def gram_size(width: int) -> int:
    """The longest q up to ``Q`` for which a passage within its edit budget shares one q-gram at least."""
    return min(Q, width // (int(EDITS * width) + 1))


def _shared(width: int) -> int:
    """q-grams that a passage within its edit budget shares at least."""
    return width + 1 - gram_size(width) * (int(EDITS * width) + 1)


def align(pattern: str, region: str, budget: int, low: int, high: int) -> tuple[int, int] | None:
    """Fewest edits of the whole pattern against any part of the region, and where that part ends.

    Only cells of the diagonals ``low..high`` (place in region minus place in pattern) are filled.
    """
    if (at := region.find(pattern)) >= 0:
        return 0, at + len(pattern)
    text, letters = _codes(region), _codes(pattern)
    width = high - low + 1
    far = budget + 1
    step = np.arange(width)
    ends = low + step  # column j of row i is the place low + i + j in the region
    row = np.where((ends >= 0) & (ends <= len(text)), 0, far)
    for i, letter in enumerate(letters, 1):
        ends = low + i + step
        inside = (ends >= 1) & (ends <= len(text))
        match = np.where(inside, text[np.clip(ends - 1, 0, max(0, len(text) - 1))] != letter, True) if len(text) else np.ones(width, bool)
        new = row + match
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where((ends >= 0) & (ends <= len(text)), new, far)
        row = np.minimum.accumulate(new - step) + step
        row = np.minimum(np.where((ends >= 0) & (ends <= len(text)), row, far), far)
        if row.min() > budget:
            return None
    best = int(row.argmin())
    return (int(row[best]), int(low + len(letters) + best)) if row[best] <= budget else None


def _hits(text: str, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document place, item and item place of every shared q-gram."""
    hashes = gram_hashes(_codes(text), grams.q)
    at = np.flatnonzero(grams.table[_slot(hashes)])
    found = np.searchsorted(grams.grams, hashes[at])
    same = (found < len(grams.grams)) & (grams.grams[np.minimum(found, len(grams.grams) - 1)] == hashes[at])
    at, found = at[same], found[same]
    n = grams.first[found + 1] - grams.first[found]
    entry = np.repeat(grams.first[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), grams.item[entry], grams.place[entry]


def _regions(text: str, starts: np.ndarray, index: Index, grams: Grams) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Document, item, band and sorted item places of the bands that share enough q-grams.

    ``starts`` are the places in ``text`` where documents begin; bands are counted from there, so that
    what is found in a document does not depend on those beside it.
    """
    spot, item, place = _hits(text, grams)
    if not len(spot):
        return
    doc = np.searchsorted(starts, spot, side="right") - 1
    band = (spot - starts[doc] - place + index.longest) // index.band
    doc, item, place = np.tile(doc, 2), np.tile(item, 2), np.tile(place, 2)
    band = np.concatenate([band, band - 1])
    order = np.lexsort((place, band, item, doc))
    doc, band, item, place = doc[order], band[order], item[order], place[order]
    edge = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    new = np.flatnonzero(np.concatenate([[True], edge]))
    size = np.diff(np.append(new, len(item)))
    enough = size >= index.least[item[new]]
    for a, n in zip(new[enough], size[enough], strict=True):
        yield int(doc[a]), int(item[a]), int(band[a]), np.unique(place[a : a + n])


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """First number and members of runs of texts that are searched as one string."""
    first, size = 0, 0
    for n, text in enumerate(texts):
        if size and size + len(text) > PIECE:
            yield first, texts[first:n]
            first, size = n, 0
        size += len(text) + WINDOW
    if size:
        yield first, texts[first:]


def find_leaks(texts: list[str], index: Index) -> list[dict[int, tuple[int, int, int]]]:
    """Per normalised text and item the first passage found: start, end and edits."""
    found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
    # line ends, which normalised texts lack, keep passages from reaching over two texts
    between = "\n" * WINDOW
    for first, group in _groups(texts):
        joined = between.join(group)
        starts = np.cumsum([0, *(len(t) + WINDOW for t in group[:-1])])
        # only a text that is alone can be longer than a piece
        for offset in range(0, len(joined), PIECE):
            # a passage that begins in a piece is found in it whole
            piece = joined[offset : offset + PIECE + 2 * WINDOW]
            for grams in index.parts:
                for n, item, band, places in _regions(piece, starts, index, grams):
                    if item in found[first + n]:
                        continue
                    hit = _verify(group[n] if len(group) > 1 else piece, index, item, band, places)
                    if hit:
                        found[first + n][item] = (offset + hit[0], offset + hit[1], hit[2])
    return found


def _verify(piece: str, index: Index, item: int, band: int, places: np.ndarray) -> tuple[int, int, int] | None:
    """Start, end and edits of the first passage of the item that is there within its budget."""
    whole = index.texts[item]
    q = gram_size(min(WINDOW, len(whole)))
    low = band * index.band - index.longest
    high = low + 2 * index.band - 1
    for start, end in passages(len(whole)):
        width = end - start
        a, b = np.searchsorted(places, [start, end - q + 1])
        if b - a < _shared(width):
            continue
        budget = int(EDITS * width)
        left = max(0, low + start - budget)
        region = piece[left : max(0, high + end + budget)]
        hit = align(whole[start:end], region, budget, low + start - left - budget, high + start - left + budget)
        if hit:
            stop = left + hit[1]
            return max(0, stop - width), stop, hit[0]
    return None


# ---- operators


def _shards(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of the benchmark, each of bounded size; items under ``Q`` characters are in none."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // SHARD_CHARS) or 1
    for shard in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == shard).orderBy("id", "text").collect()
        texts = [normalise(r["text"]) for r in rows]
        yield Index.of([r["id"] for r in rows], texts)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, start, end, edits``: one row per document row and item found in it.

    Passages are windows of ``WINDOW`` characters of an item, or all of a shorter one, and count as
    found with at most ``EDITS`` of their characters edited; none within that budget is missed.
    Places are those of the first passage found, in the normalised text. Items of fewer than ``Q``
    characters and null items are not looked for; null and empty texts hold nothing; repeated rows
    are reported as often as they come; other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    item_type = benchmark.schema[item_col].dataType.simpleString()
    schema = f"doc long, item {item_type}, start long, end long, edits int"
    out = None
    for index in _shards(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                leaks = find_leaks(list(map(normalise, batch["text"])), shared.value)
                for doc, items in zip(batch["doc"], leaks, strict=True):
                    for item, (start, end, edits) in sorted(items.items()):
                        found.append((doc, shared.value.ids[item], start, end, edits))
                yield pd.DataFrame(found, columns=["doc", "item", "start", "end", "edits"])

        part = rows.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "start", "end", "edits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in their columns, whose text holds no passage of the benchmark.

    Passages are those of ``contaminated``. Null and empty texts and null ids stay, repeated rows stay or
    go together, and with an empty benchmark all rows stay.
    """
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for index in _shards(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not items for items in find_leaks([normalise(t.as_py()) for t in batch.column(at)], shared.value)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
