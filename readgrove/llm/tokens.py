"""Token counts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte-level vocabularies cut a text before merging, with the white space of Unicode.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = regex.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: Entries a worker remembers at most before it starts anew.
REMEMBERED = 600_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class MergeCounter:
    """Counts the tokens of a text for the byte-level merges of a ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # a pair of symbols as one number, to its rank; and what each rank makes
        self.rank = {(vocab[a] << 20) + vocab[b]: n for n, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.first = [vocab[letter] for _, letter in sorted(byte_letters().items())]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.pieces: dict[str, int] = {}
        self.words = _Words(self._piece)

    def merged(self, piece: bytes) -> int:
        """Symbols left of one piece: bytes minus merges, lowest rank first, leftmost among equals."""
        first, made, rank_of = self.first, self.made, self.rank.get
        symbol = [first[b] for b in piece]
        size = count = len(symbol)
        # a heap entry is rank * size + place of the left symbol
        heap = []
        for i in range(size - 1):
            r = rank_of((symbol[i] << 20) + symbol[i + 1])
            if r is not None:
                heap.append(r * size + i)
        if not heap:
            return count
        heapq.heapify(heap)
        after = [*range(1, size), -1]
        before = [*range(-1, size - 1)]
        while heap:
            order, i = divmod(heapq.heappop(heap), size)
            j = after[i]
            # outdated if the left symbol is gone or either one has changed
            if j < 0 or symbol[i] < 0 or rank_of((symbol[i] << 20) + symbol[j]) != order:
                continue
            new = symbol[i] = made[order]
            symbol[j] = -1
            count -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                r = rank_of((new << 20) + symbol[k])
                if r is not None:
                    heapq.heappush(heap, r * size + i)
            h = before[i]
            if h >= 0:
                r = rank_of((symbol[h] << 20) + new)
                if r is not None:
                    heapq.heappush(heap, r * size + h)
        return count

    def _piece(self, piece: str) -> int:
        n = self.pieces.get(piece)
        if n is None:
            if len(self.pieces) >= REMEMBERED:
                self.pieces.clear()
            n = self.pieces[piece] = self.merged(piece.encode("utf-8"))
        return n

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        # single spaces and line ends only: a space belongs to the word after it, a line end is a
        # piece, and a word's pieces do not depend on its neighbours
        if text.replace("\n", " ").split(" ") != text.split():
            return sum(map(self._piece, PIECES.findall(text)))
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        counted = sum(map(self.words.__getitem__, text.replace(" ", "\n ").split("\n")))
        return counted + text.count("\n") * self._piece("\n")

    def count(self, text: str | None) -> int:
        """Tokens of the text; special tokens written in it count as one each."""
        if not text:
            return 0
        if not any(x in text for x in self.specials):
            return self._plain(text)
        cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
        return len(cut.findall(text)) + sum(map(self._plain, cut.split(text)))


class _Words(dict):
    """Tokens of a word with the space before it, counted when first asked for."""

    def __init__(self, piece) -> None:
        super().__init__()
        self.piece = piece

    def __missing__(self, word: str) -> int:
        n = self[word] = sum(map(self.piece, PIECES.findall(word)))
        return n


@lru_cache(maxsize=4)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file on every machine. Counts are those of the
    library without added begin or end tokens. Null text is empty and has no tokens; whole texts are
    counted, of any length; rows come back as often as given; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merge_counter(vocabulary)
        for batch in batches:
            counts = [counter.count(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
