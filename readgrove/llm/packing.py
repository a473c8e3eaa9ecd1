"""Packing of token sequences by exact-complement hashing over the counts of each length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from readgrove.llm.tokens import SPACE
from readgrove.session import materialise

CAPACITY = 4096
END_ID = 1
#: Words a worker remembers at most, some 100 MB; then it keeps those it has met again.
REMEMBERED = 500_000
#: Documents and characters cut into words at a time, and words encoded as one text.
SLICE, SLICE_CHARS, CHUNK = 256, 1 << 20, 512
MARKS = "!#$%&()*+,-./:;=?@[]^_{|}~"
CONTROL = regex.compile("[\\x1c-\\x1f]")
SPACES = regex.compile(f"[{SPACE}]+")


# ---- tokens


def _letters(word: str) -> bool:
    """Letters only, also after folding their case."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha())


class WordEncoder:
    """Token ids of a text as little-endian bytes, remembered by its words.

    For vocabularies whose pieces never span white space, so that a text's tokens are those of its
    words in turn.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        #: words asked for again after they were learned
        self.again: set[str] = set()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[n for token, n in vocab.items() if token.endswith("</w>")]] = True

    def _learn(self, plain: list[str], others: list[str]) -> None:
        """Plain words are one piece each, so many are encoded as one text and cut at the word ends."""
        for at in range(0, len(plain), CHUNK):
            words = plain[at : at + CHUNK]
            found = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(words):
                data, edge = ids.tobytes(), [0, *(4 * cuts).tolist()]
                self.known.update(zip(words, map(data.__getitem__, map(slice, edge, edge[1:])), strict=False))
            else:  # a letter that folds to more than letters
                others = others + words
        for word, found in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.known[word] = np.array(found.ids, "<u4").tobytes()

    def _learn_new(self, new: set[str]) -> None:
        """Letters and the marks behind them are pieces of their own, so such a word is learned in two."""
        known, others, joined = self.known, {}, []
        # most words are plain letters
        plain = {w: None for w in new if w.isascii() and w.isalpha()}
        for word in new.difference(plain):
            stem = word if word.isalpha() else word.rstrip(MARKS)
            if not _letters(stem):
                others[word] = None
                continue
            if stem not in known:
                plain[stem] = None
            if len(stem) < len(word):
                mark = word[len(stem) :]
                joined.append((word, stem, mark))
                if mark not in known:
                    others[mark] = None
        self._learn(list(plain), list(others))
        for word, stem, mark in joined:
            known[word] = known[stem] + known[mark]

    @staticmethod
    def words(text: str) -> list[str]:
        if CONTROL.search(text):
            return [w for w in SPACES.split(text) if w]
        if "<|" in text:  # a special token counts only as it is written
            return text.split()
        # letter case is dropped by the vocabulary: A-Z are folded here so that a word is remembered
        # once, unless that changes how letters and marks compose
        folded = text.lower() if text.isascii() else text.encode("utf-8").lower().decode("utf-8")
        composed = text.isascii() or (is_normalized("NFC", text) and is_normalized("NFC", folded))
        return (folded if composed else text).split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        lists = [self.words(t or "") for t in texts]
        known, asked = self.known, set().union(*lists)
        new = asked.difference(known)
        if 2 * len(known) > REMEMBERED:
            self.again |= asked - new
        if len(known) + len(new) > REMEMBERED:
            kept = {w: known[w] for w in self.again}
            known.clear()
            known.update(kept if len(kept) + len(new) <= REMEMBERED else {w: kept[w] for w in asked - new})
            self.again = set()
        self._learn_new(new)
        return [b"".join(map(known.__getitem__, words)) for words in lists]


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def text_slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``SLICE`` rows and about ``SLICE_CHARS`` bytes of that column."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = int(size[start - 1]) if start else 0
        stop = max(start + 1, min(start + SLICE, int(np.searchsorted(size, before + SLICE_CHARS))))
        yield batch.slice(start, stop - start)
        start = stop


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, piece, start, length, ids_crc32`` of every piece of at most ``capacity`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            for part in text_slices(batch, 1):
                rows = []
                for doc, ids in zip(part.column(0), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for n, a in enumerate(range(0, len(ids), step)):
                        cut = ids[a : a + step]
                        rows.append((doc.as_py(), n, a // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)],
                    ["doc", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc long, piece int, start long, length long, ids_crc32 long")


KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


# ---- plan


class _Stock:
    """How many pieces of each length are left, with an index of their single, pair and triple sums.

    An index is an integer whose bit s is set if one, two or three lengths in stock add up to s.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.full = (1 << (capacity + 1)) - 1
        self.changed()

    def changed(self) -> None:
        self.lengths = [int(x) for x in np.flatnonzero(self.left)]
        self.one = sum(1 << x for x in self.lengths)
        self.two = 0
        for x in self.lengths:
            self.two |= self.one << x
        self.two &= self.full
        self.three = 0
        for x in self.lengths:
            self.three |= self.two << x
        self.three &= self.full

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One, two or three lengths that fill the gap exactly, the largest first, within the stock."""

        def has(x: int, more: tuple = ()) -> bool:
            return x > 0 and self.left[x] > used.get(x, 0) + more.count(x)

        if gap <= 0:
            return None
        if self.one >> gap & 1 and has(gap):
            return [gap]
        down = [x for x in reversed(self.lengths) if x < gap]
        if self.two >> gap & 1:
            for a in down:
                if 2 * a < gap:
                    break
                if has(a) and has(gap - a, (a,)):
                    return [a, gap - a]
        if self.three >> gap & 1:
            for a in down:
                if 3 * a < gap:
                    break
                if not self.two >> (gap - a) & 1 or not has(a):
                    continue
                for b in down:
                    c = gap - a - b
                    if b > a or c > b:
                        if c > b:
                            break
                        continue
                    if has(b, (a,)) and has(c, (a, b)):
                        return [a, b, c]
        return None


def plan_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Lists of lengths that fill a sequence, each with the number of sequences made that way.

    The longest piece in stock opens a sequence. Its gap is closed by an exact complement of one, two
    or three lengths if the index has one; else the best-fitting length goes in and the rest is
    tried again. A pattern is used as often as the stock allows, which uses up one of its lengths at
    least or leaves less of it than the pattern takes, so patterns are bounded by the lengths, not
    by the pieces.
    """
    stock = _Stock({k: v for k, v in counts.items() if v > 0}, capacity)
    patterns = []
    while stock.lengths:
        first = stock.lengths[-1]
        pattern, used, gap = [first], {first: 1}, capacity - first
        while gap > 0:
            found = stock.exact(gap, used)
            if found is None:
                fits = [x for x in stock.lengths if x <= gap and stock.left[x] > used.get(x, 0)]
                if not fits:
                    break
                found = [fits[-1]]
            for x in found:
                used[x] = used.get(x, 0) + 1
                gap -= x
            pattern += found
        times = int(min(stock.left[x] // n for x, n in used.items()))
        for x, n in used.items():
            stock.left[x] -= n * times
        patterns.append((pattern, times))
        if any(stock.left[x] == 0 for x in used):
            stock.changed()
    return patterns


def slots(patterns: list[tuple[list[int], int]]) -> pd.DataFrame:
    """``length, rank, sequence, offset``: from that rank on, pieces of the length go there in turn."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rows.append((x, taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).astype("int64")


# ---- operator


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row.

    A document's tokens and an end id are cut into pieces of at most ``capacity`` only if they are
    more, and the pieces fill sequences of at most ``capacity`` without gaps. Null and empty texts
    are the end id alone. Rows come as often as given, with or without an id; other columns are
    ignored; an empty table gives an empty result.

    The plan needs only how many pieces each length has, at most ``capacity`` numbers. A piece's
    rank among those of its length, counted per task that wrote it, decides its place, so neither
    the pieces nor a frequent length meet in one task.
    """
    made = pieces(docs, vocabulary, capacity, id_col, text_col).withColumn("run", F.spark_partition_id())
    made = materialise(made, "pieces")
    sizes = materialise(made.groupBy("length", "run").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    totals = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan_patterns(totals, capacity))
    earlier = Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("run", "length").orderBy("doc", "piece", "ids_crc32")
    ranked = made.withColumn("nth", F.row_number().over(within) - 1).join(offsets, ["run", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth")).drop("run", "nth", "before")
    span = int(table["rank"].max()) + 1 if len(table) else 1
    # length and rank as one sorted key; ranks of a slot's later pieces never pass the next length
    table = table.sort_values(["length", "rank"], ignore_index=True)
    starts = table["length"].to_numpy().astype(object) * span + table["rank"].to_numpy()
    fits = not len(table) or int(starts[-1]) < 1 << 62
    if not fits:
        raise ValueError("more pieces than 64-bit ranks can number")
    shared = docs.sparkSession.sparkContext.broadcast([starts.astype("int64"), *(table[c].to_numpy() for c in ("rank", "sequence", "offset"))])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rank, sequence, offset = shared.value
        for frame in frames:
            key = frame["length"].to_numpy() * span + np.minimum(frame["rank"].to_numpy(), span - 1)
            at = np.searchsorted(keys, key, side="right") - 1
            frame["sequence_id"] = sequence[at] + frame["rank"].to_numpy() - rank[at]
            frame["offset"] = offset[at]
            yield frame.drop(columns="rank")

    out = "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = ranked.select("doc", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, out)
    return placed.withColumnRenamed("doc", id_col)
