"""A quality score: random-indexing word vectors, pooled per document, into a two-layer network.

Each word has two tokens: its letters in lower case, and its shape (``THE!!`` is ``A!``). A token's
index vector is a few signs at hashed places; its word vector adds the index vectors of the tokens
beside it in a labelled sample. A document is the mean of its vectors of both kinds, and the
network's logit is divided by a temperature fitted on rows kept apart.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrove.session import materialise

#: Labelled rows of each class that the classifier is fitted on at most, by hash order of the id.
FIT_ROWS = 4000
#: Words and shapes that have a vector of their own, the most frequent of the sample.
WORDS, SHAPES = 4096, 256
SIZE, SIGNS = 64, 6
HIDDEN = 32
THRESHOLD = 0.7
#: A longer word counts as several of that many characters.
LONG = 64
#: Characters and parts of texts cut into words at a time.
PIECE, PARTS = 1 << 20, 256
#: Rows of a batch scored at a time.
SLICE = 512
SAMPLE_PARTS = 8

SPACE = re.compile("\\s")
SOME_LONG = re.compile(f"\\S{{{LONG + 1}}}")
SAME = "="


def text_parts(text: str) -> Iterator[str]:
    """A text in parts of about ``PIECE`` characters, cut at white space."""
    start = 0
    while start < len(text):
        gap = SPACE.search(text, start + PIECE) if start + PIECE < len(text) else None
        stop = gap.start() if gap else len(text)
        yield text[start:stop]
        start = stop


def text_groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers of texts and their parts, in groups of a bounded size."""
    numbers, parts, size = [], [], 0
    for n, text in enumerate(texts):
        for part in text_parts(text or ""):
            numbers.append(n)
            parts.append(part)
            size += len(part)
            if size >= PIECE or len(parts) == PARTS:
                yield numbers, parts
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts


@dataclass
class Words:
    """Words of some parts in order: number of the part, number of the word form, and per form its tokens."""

    part: np.ndarray
    form: np.ndarray
    letters: pa.Array
    shapes: pa.Array

    @staticmethod
    def of(parts: list[str]) -> Words:
        lists = [part.split() for part in parts]
        if any(map(SOME_LONG.search, parts)):
            lists = [[w[at : at + LONG] for w in words for at in range(0, len(w), LONG)] for words in lists]
        part = np.repeat(np.arange(len(parts)), list(map(len, lists)))
        words = pa.array(chain.from_iterable(lists), pa.large_string())
        coded = words.dictionary_encode()
        forms = coded.dictionary.to_pylist()
        return Words(part, coded.indices.to_numpy(), letters(forms), shapes(forms))


@lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """For each code point: A for capitals, a for other letters, 0 for digits, else itself."""
    signs = np.arange(sys.maxunicode + 1, dtype="<u4")
    for code in range(sys.maxunicode + 1):
        kind = category(chr(code))
        if kind in ("Lu", "Ll", "Lo", "Lm", "Lt"):
            signs[code] = ord("A" if kind == "Lu" else "a")
        elif kind[0] == "N":
            signs[code] = ord("0")
    return signs


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("\n".join(words).encode("utf-32-le"), "<u4")


def _split(codes: np.ndarray, n: int) -> pa.Array:
    return pa.array(codes.tobytes().decode("utf-32-le").split("\n") if n else [], pa.large_string())


def letters(words: list[str]) -> pa.Array:
    """The letters of each word in lower case."""
    codes = _codes([w.lower() for w in words])
    sign = _signs()[codes]
    return _split(codes[(sign == ord("a")) | (sign == ord("A")) | (codes == ord("\n"))], len(words))


def shapes(words: list[str]) -> pa.Array:
    """Runs of capitals, other letters, digits and of one mark as one sign each."""
    sign = _signs()[_codes(words)]
    return _split(sign[np.concatenate([np.ones(min(1, len(sign)), bool), sign[1:] != sign[:-1]])], len(words))


def index_vector(token: str) -> np.ndarray:
    """``SIGNS`` places of +1 or -1, from the token's hash."""
    vector = np.zeros(SIZE, np.float32)
    for n in range(SIGNS):
        h = xxhash.xxh64_intdigest(token, n)
        vector[h % SIZE] += 1 if h >> 63 else -1
    return vector


#: Step of the values of a vector.
GRID = 2.0**-20


@dataclass
class Vectors:
    """Word and shape vectors; row 0 of each stands for all others, row 1 of shapes for a repeated word.

    Their values are multiples of ``GRID``, so that sums of them are exact in any order.
    """

    words: list[str]
    shapes: list[str]
    word_table: np.ndarray
    shape_table: np.ndarray


@dataclass
class Model:
    vectors: Vectors
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    #: The score of every document if there was nothing to learn from.
    constant: float | None = None

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return _sigmoid(_logits((pooled - self.mean) / self.scale, self.layers)[0] / self.temperature)


def _coded(tokens: pa.Array, form: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct tokens, and the number of each word's token."""
    coded = tokens.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()[form].astype(np.int64)


class Pooler:
    """Pooled vectors of texts: per part a count of each row, times the table of vectors."""

    def __init__(self, vectors: Vectors) -> None:
        self.vectors = vectors
        self.words, self.shapes = (pa.array(known, pa.large_string()) for known in (vectors.words, vectors.shapes))

    def rows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the two tables for each word."""
        out = []
        for tokens, known, first in ((words.letters, self.words, 1), (words.shapes, self.shapes, 2)):
            row = pc.fill_null(pc.add(pc.index_in(tokens, value_set=known), first), 0).to_numpy()
            out.append(row[words.form])
        return out[0], out[1]

    def pool(self, texts: list[str | None]) -> np.ndarray:
        """One row per text; texts without words are zero."""
        total, n = np.zeros((len(texts), 2 * SIZE)), np.zeros(len(texts))
        for numbers, parts in text_groups(texts):
            words = Words.of(parts)
            tables = self.vectors.word_table, self.vectors.shape_table
            counts = [
                np.bincount(words.part * len(t) + row, minlength=len(parts) * len(t)).reshape(len(parts), len(t)).astype(np.float64)
                for t, row in zip(tables, self.rows(words), strict=True)
            ]
            same = (words.form[1:] == words.form[:-1]) & (words.part[1:] == words.part[:-1])
            counts[1][:, 1] += np.bincount(words.part[1:][same], minlength=len(parts))
            np.add.at(total, numbers, np.hstack([c @ t for c, t in zip(counts, tables, strict=True)]))
            np.add.at(n, numbers, np.bincount(words.part, minlength=len(parts)))
        return total / np.maximum(n, 1)[:, None]


# ---- fitting


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _logits(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden @ w2 + b2[0], hidden


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 80, rate: float = 0.003, decay: float = 1e-3) -> list[np.ndarray]:
    """A tanh layer and a logistic one, by Adam on the weighted log loss."""
    rng = np.random.default_rng(7)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            logit, hidden = _logits(x[rows], layers)
            slope = weight[rows] * (_sigmoid(logit) - y[rows]) / len(rows)
            back = np.outer(slope, layers[2]) * (1 - hidden**2)
            grads = [x[rows].T @ back + decay * layers[0], back.sum(axis=0), hidden.T @ slope + decay * layers[2], slope.sum(keepdims=True)]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of least weighted log loss, from 1/4 to 8."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 200))
    loss = [-(weight * np.log(np.clip(np.where(y == 1, _sigmoid(logit / t), 1 - _sigmoid(logit / t)), 1e-12, 1))).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, fit_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """``id, y, text`` of at most ``fit_rows`` labelled documents a class, and the rows of each class.

    Held-out ids have no part in it. Labels that contradict each other for an id count as the lower.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("label_id")).agg(F.min(F.col("quality").cast("int")).alias("y")).where("y in (0, 1)")
    sizes = {int(r["y"]): int(r["n"]) for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows) for y in (0, 1)]
    # at most two times fit_rows ids
    ids = F.broadcast(materialise(picked[0].unionByName(picked[1]), "label_sample"))
    rows = docs.join(ids, docs[id_col] == ids["label_id"]).select(ids["label_id"].alias("id"), ids["y"].alias("y"), docs[text_col].cast("string").alias("text"))
    return rows, sizes


def held_out(id_col) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """The classifier of ``labels.quality``, fitted on a bounded sample of labelled rows.

    The driver gets counts of the sample's tokens, sums of vectors per task and one pooled vector per
    sampled row, never texts. Without rows of both classes every document scores the share of label
    1, and 1 without any label, since then nothing speaks against it.
    """
    sample, sizes = labelled_sample(docs, labels, id_col, text_col, fit_rows)
    sample = materialise(sample.repartition(SAMPLE_PARTS, "id"), "labelled_sample")

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, forms = Counter(), Counter()
        for frame in frames:
            for _, parts in text_groups(list(frame["text"])):
                found = Words.of(parts)
                known, token = _coded(found.letters, found.form)
                # a word counts once in a part
                once = np.unique(found.part * (len(known) + 1) + token) % (len(known) + 1)
                words.update(dict(zip(known, np.bincount(once, minlength=len(known)).tolist(), strict=True)))
                known, token = _coded(found.shapes, found.form)
                forms.update(dict(zip(known, np.bincount(token, minlength=len(known)).tolist(), strict=True)))
        del words[""]
        # tokens rarer than that in every task have no vector
        rows = [("w", t, n) for t, n in words.most_common(4 * WORDS)] + [("s", t, n) for t, n in forms.most_common(4 * SHAPES)]
        yield pd.DataFrame(rows, columns=["kind", "token", "n"])

    counted = sample.select("text").mapInPandas(tokens, "kind string, token string, n long").groupBy("kind", "token").agg(F.sum("n").alias("n"))
    top = {kind: [r["token"] for r in counted.where((F.col("kind") == kind) & (F.col("n") > 2)).orderBy(F.desc("n"), "token").limit(size).collect()] for kind, size in (("w", WORDS), ("s", SHAPES))}
    index = [np.stack([index_vector(t) for t in ("w:", *("w:" + t for t in top["w"]))]), np.stack([index_vector(t) for t in ("s:", "s:" + SAME, *("s:" + t for t in top["s"]))])]
    plain = Vectors(top["w"], top["s"], *index)

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pooler, sums, seen = Pooler(plain), [np.zeros(t.shape) for t in index], [np.zeros(len(t)) for t in index]
        for frame in frames:
            for _, parts in text_groups(list(frame["text"])):
                found = Words.of(parts)
                beside = found.part[1:] == found.part[:-1]
                for k, row in enumerate(pooler.rows(found)):
                    left, right = row[:-1][beside].astype(np.int64), row[1:][beside].astype(np.int64)
                    pair, times = np.unique(np.concatenate([left * len(index[k]) + right, right * len(index[k]) + left]), return_counts=True)
                    at, other = np.divmod(pair, len(index[k]))
                    if len(pair):
                        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                        sums[k][at[first]] += np.add.reduceat(index[k][other] * times[:, None], first, axis=0)
                    seen[k] += np.bincount(row, minlength=len(seen[k]))
        for k in (0, 1):
            some = np.flatnonzero(seen[k])
            if len(some):
                yield pd.DataFrame({"kind": k, "row": some, "n": seen[k][some], "sums": list(sums[k][some])})

    tables = [t.astype(np.float64) for t in index]
    counts = [np.zeros(len(t)) for t in index]
    around = [np.zeros_like(t) for t in tables]
    for r in sample.select("text").mapInPandas(contexts, "kind int, row int, n double, sums array<double>").collect():
        counts[r["kind"]][r["row"]] += r["n"]
        around[r["kind"]][r["row"]] += r["sums"]
    tables = [np.round((t + a / np.maximum(2 * c, 1)[:, None]) / GRID) * GRID for t, a, c in zip(tables, around, counts, strict=True)]
    vectors = Vectors(top["w"], top["s"], *tables)

    def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pooler = Pooler(vectors)
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"id": frame["id"], "y": frame["y"], "x": list(pooler.pool(list(frame["text"])))})

    id_type = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInPandas(pooled, f"id {id_type}, y int, x array<double>").collect()
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["id"])), r["y"], r["x"]))
    y = np.array([r["y"] for r in rows], np.float64)
    zero = np.zeros(2 * SIZE)
    if len(set(y.tolist())) < 2:
        total = sum(sizes.values())
        return Model(vectors, zero, zero + 1, [], 1.0, sizes.get(1, 0) / total if total else 1.0)
    x = np.array([r["x"] for r in rows])
    # a class that was sampled more thinly counts for more
    sampled = np.array([(y == c).sum() for c in (0, 1)])
    share = np.array([sizes[0], sizes[1]]) / sampled
    weight = (share / share.mean())[y.astype(int)]
    kept_apart = np.arange(len(y)) % 5 == 4
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    layers = fit_network(x[~kept_apart], y[~kept_apart], weight[~kept_apart])
    apart = kept_apart if kept_apart.any() else ~kept_apart
    temperature = fit_temperature(_logits(x[apart], layers)[0], y[apart], weight[apart])
    return Model(vectors, mean, scale, layers, temperature)


# ---- operators


def _scores(model: Model, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with the scores of their texts in column ``at``; nothing is kept between slices."""
    pooler = Pooler(model.vectors)
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, model.probability(pooler.pool(part.column(at).to_pylist()))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Only the text is scored, the whole of it; null counts as empty, and empty texts get the score of
    a text without words. Rows come back as often as given, null ids too (not held out); other
    columns are ignored; empty tables give an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _scores(shared.value, batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64())], ["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs``, in their columns, whose text scores at least the threshold.

    Null text counts as empty, and empty texts get the score of a text without words. Repeated rows are
    scored alike and stay or go together; null ids are scored too; an empty table stays empty.
    Without labels all rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, fit_rows))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, score in _scores(shared.value, batches, at):
            yield part.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
