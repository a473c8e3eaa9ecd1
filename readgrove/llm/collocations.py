"""Phrase collocations by stripes: each prefix keys a counter of the words that follow it.

A task counts a stretch of texts at once and sends one stripe for each prefix; stripes of a prefix are
merged elementwise. A merged stripe gives the counts of all phrases that extend its prefix, the count of
the prefix itself (every occurrence adds one, also at the end of a piece) and the count of its most
frequent extension. Phrases grow word by word: a prefix that is too rare is never extended, which a bit
map of bounded size tells the tasks. The bit map may let rare ones pass, never hold back frequent ones, so
counts are exact whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readgrove.llm.lists import counted
from readgrove.session import materialise

#: Words of the longest phrase.
LONGEST = 4
MIN_COUNT = 30
TOP = 2000
#: A candidate goes if a longer one that holds it has that share of its occurrences, in percent.
COVERED = 80
SCALE = 2_000_000
#: Bytes of texts that a task counts at once, and that it cuts into words at once.
STRETCH, PART = 16 << 20, 2 << 20
#: Bits of the map of frequent phrases: that many for each, so that few rare ones pass, and that many in all, 8 MB.
BITS_EACH, MOST_BITS = 256, 1 << 26
#: Prefixes with more than 1 / HEAVY of all words, at most so many, have their stripes cut in SLOTS.
HEAVY, SLOTS = 4096, 64
#: Entries of stripes sent on at once.
SENT = 1 << 16
#: Candidates that one task ranks.
RANKED = 1_000_000

#: What ends a piece becomes a line end, a tabulator is a space.
ENDS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
ONE_END = re.compile(rb"[.,;:!?\n-\r]")
FACTOR = np.uint64(0x9E3779B97F4A7C15)

# between tasks the entries of a stripe are two texts, next words and times, parted by spaces: a third of the bytes of arrays
STRIPE = "lang string, prefix string, slot int, next string, times string"
MERGED = "lang string, prefix string, slot int, next array<string>, times array<long>, total long, best long"


# ---- words and hashes in a task


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words in lower case (A-Z only); pieces end with a line end, which is a word of its own."""
    data = b"\n".join(texts).lower().translate(ENDS).replace(b"\n", b" \n ")
    return [*filter(None, data.split(b" ")), b"\n"]


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed=seed) for w in words), np.uint64, len(words))


def longer(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    h = (hashes ^ (hashes >> np.uint64(29))) * FACTOR + word
    return (h ^ (h >> np.uint64(32))) * FACTOR


def phrase_hashes(phrases: list[str], langs: list[str]) -> np.ndarray:
    out = np.zeros(len(phrases), np.uint64)
    for n, (phrase, lang) in enumerate(zip(phrases, langs, strict=True)):
        words = word_hashes(phrase.encode().split(b" "), lang)
        h = words[:1]
        for word in words[1:]:
            h = longer(h, word)
        out[n] = h[0]
    return out


class Frequent:
    """A bit map of phrase hashes, of ``1 << bits`` bits."""

    def __init__(self, bits: int, buckets: dict[int, bytes]) -> None:
        self.bits = bits
        self.map = np.zeros((1 << bits) >> 3, np.uint8)
        for n, data in buckets.items():
            self.map[n * len(data) : (n + 1) * len(data)] = np.frombuffer(data, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.map[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _places(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """``lang, phrase`` to the places of the phrases in a bit map, counted from one."""
    for batch in batches:
        h = phrase_hashes(batch.column(1).to_pylist(), batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - bits)).astype(np.int64) + 1)], ["place"])


def frequent(phrases: DataFrame, rows: int) -> Frequent:
    """The bit map of that many phrases, built on Spark; the driver gets only its bytes."""
    # a bucket of Spark's bit maps has 1 << 15 bits
    bits = int(np.clip(np.ceil(np.log2(max(1, rows * BITS_EACH))), 15, np.log2(MOST_BITS)))
    places = phrases.select("lang", "phrase").mapInArrow(partial(_places, bits=bits), "place long")
    bucket = (F.bitmap_bucket_number("place") - 1).alias("bucket")
    maps = places.groupBy(bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map")).collect()
    return Frequent(bits, {r["bucket"]: bytes(r["map"]) for r in maps})


# ---- counting


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of one language at a time, as many as are counted at once."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            data = text.as_py()
            held.setdefault(lang, []).append(data)
            size += len(data)
            if size >= STRETCH:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of about ``PART`` bytes; a longer one is cut behind the end of a piece."""
    held, size = [], 0
    for text in texts:
        start = 0
        while start < len(text):
            end = ONE_END.search(text, start + PART) if start + PART < len(text) else None
            stop = end.end() if end else len(text)
            held.append(text[start:stop])
            size += stop - start
            start = stop
            if size >= PART:
                yield held
                held, size = [], 0
    if held:
        yield held


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words; the empty word counts them all."""
    for lang, texts in _stretches(batches):
        found: dict[bytes, int] = {}
        for part in _parts(texts):
            coded = pa.array(words_of(part), pa.binary()).dictionary_encode()
            times = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            for word, n in zip(coded.dictionary.to_pylist(), times.tolist(), strict=True):
                found[word] = found.get(word, 0) + n
        found.pop(b"\n", None)
        found[b""] = sum(found.values())
        words, times = pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())
        for at in range(0, len(found), SENT):
            part = words.slice(at, SENT)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, times.slice(at, SENT)], ["lang", "phrase", "a"])


def _coded(texts: list[bytes], lang: str, words: Frequent) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of the words in order, the words and their hashes.

    Line ends are number 0; words that are not frequent are number 1, the empty word.
    """
    number: dict[bytes, int] = {b"\n": 0, b"": 1}
    hashes, codes = [0, 0], []
    for part in _parts(texts):
        coded = pa.array(words_of(part), pa.binary()).dictionary_encode()
        forms = coded.dictionary.to_pylist()
        h = word_hashes(forms, lang)
        own = np.ones(len(forms), np.int64)
        for n in np.flatnonzero(words.has(h)).tolist():
            own[n] = number.setdefault(forms[n], len(number))
            if own[n] == len(hashes):
                hashes.append(int(h[n]))
        own[forms.index(b"\n")] = 0
        codes.append(own[coded.indices.to_numpy()].astype(np.int32))
    return np.concatenate(codes or [np.zeros(1, np.int32)]), pa.array(list(number), pa.binary()).cast(pa.string()), np.array(hashes, np.uint64)


def _counted_pairs(codes: np.ndarray, hashes: np.ndarray, size: int, maps: list[Frequent]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct prefixes of ``size`` words and what follows them: prefix words, then per entry prefix, next word and times.

    A word follows by its number if prefix and word without the first word are frequent too, else by 1.
    """
    at = np.flatnonzero(codes > 1)
    h = hashes[codes[at]]
    for n in range(1, size):
        on = codes[at + n] > 1  # the last code is a line end, so no phrase passes it
        at, h = at[on], longer(h[on], hashes[codes[at[on] + n]])
        on = maps[n].has(h)
        at, h = at[on], h[on]
    begins = np.zeros(len(codes) + 1, bool)
    begins[at] = True
    after = np.where(begins[at + 1], codes[at + size], 1).astype(np.int64)
    words = len(hashes)
    prefix, steps = codes[at].astype(np.int64), []
    for n in range(1, size):
        step, prefix = np.unique(prefix * words + codes[at + n], return_inverse=True)
        steps.append(step)
    pair, times = np.unique(prefix * words + after, return_counts=True)
    prefix, after = np.divmod(pair, words)
    which, prefix = np.unique(prefix, return_inverse=True)
    spelled = []
    for step in reversed(steps):
        which, last = np.divmod(step[which], words)
        spelled.insert(0, last)
    return [which, *spelled], prefix, after, times


def _joined(words: pa.Array, numbers: list[np.ndarray]) -> pa.Array:
    parts = [words.take(pa.array(n)) for n in numbers]
    return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")


def _entries(offsets: pa.Array, words: pa.Array, times: np.ndarray) -> list[pa.Array]:
    """The words and times of each stripe as texts."""
    return [pc.binary_join(pa.ListArray.from_arrays(offsets, column), " ") for column in (words, pa.array(times).cast(pa.string()))]


def _stripes(batches: Iterator[pa.RecordBatch], size: int, shared) -> Iterator[pa.RecordBatch]:
    """Texts to the stripes of their prefixes of ``size`` words; those of heavy prefixes are cut by next word."""
    maps, heavy = shared.value
    for lang, texts in _stretches(batches):
        codes, words, hashes = _coded(texts, lang, maps[0])
        numbers, prefix, after, times = _counted_pairs(codes, hashes, size, maps)
        if not len(prefix):
            continue
        h = hashes[numbers[0]]
        for n in numbers[1:]:
            h = longer(h, hashes[n])
        slot = np.where(np.isin(h, heavy)[prefix], (hashes[after] % np.uint64(SLOTS)).astype(np.int64), -1)
        order = np.lexsort((slot, prefix))
        prefix, after, times, slot = prefix[order], after[order], times[order], slot[order]
        edge = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (slot[1:] != slot[:-1])]))
        ends = np.append(edge[1:], len(prefix))
        start = 0
        while start < len(edge):
            stop = max(start + 1, int(np.searchsorted(ends, edge[start] + SENT, side="right")))
            a, b = edge[start], ends[stop - 1]
            offsets = pa.array(np.append(edge[start:stop], b) - a, pa.int32())
            names = _joined(words, [n[prefix[edge[start:stop]]] for n in numbers])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(names), pa.string()), names, pa.array(slot[edge[start:stop]], pa.int32()),
                    *_entries(offsets, words.take(pa.array(after[a:b])), times[a:b]),
                ],
                ["lang", "prefix", "slot", "next", "times"],
            )
            start = stop


def _sums(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Merges the stripes of each key of sorted rows: first rows, offsets, and per entry run, word and times."""
    keys = [batch.column(n).dictionary_encode().indices.to_numpy() for n in (0, 1)] + [batch.column(2).to_numpy()]
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(np.concatenate([[True], new]))
    run = np.concatenate([[0], np.cumsum(new)])
    listed = pc.split_pattern(batch.column(3), " ")
    entries = np.repeat(run, pc.list_value_length(listed).to_numpy())
    coded = listed.flatten().dictionary_encode()
    pair, place = np.unique(entries * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True)
    times = np.zeros(len(pair), np.int64)
    np.add.at(times, place, pc.split_pattern(batch.column(4), " ").flatten().cast(pa.int64()).to_numpy())
    run, word = np.divmod(pair, max(1, len(coded.dictionary)))
    return first, np.searchsorted(run, np.arange(len(first) + 1)), run, coded.dictionary.take(pa.array(word)), times


def _merge(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """Stripes sorted by key to one for each key, with its total, and of its entries those that are frequent."""
    names = ["lang", "prefix", "slot", "next", "times"]

    def told(keys: list[pa.Array], offsets: np.ndarray, run: np.ndarray, word: pa.Array, times: np.ndarray) -> pa.RecordBatch:
        total = np.add.reduceat(times, offsets[:-1]) if len(times) else np.zeros(0, np.int64)
        keep = (times >= min_count) & pc.not_equal(word, "").to_numpy(zero_copy_only=False)
        best = np.zeros(len(total), np.int64)
        np.maximum.at(best, run[keep], times[keep])
        kept = pa.array(np.concatenate([[0], np.cumsum(np.bincount(run[keep], minlength=len(total)))]), pa.int32())
        batch = pa.RecordBatch.from_arrays(
            [*keys, pa.ListArray.from_arrays(kept, word.filter(pa.array(keep))), pa.ListArray.from_arrays(kept, pa.array(times[keep])), pa.array(total), pa.array(best)],
            [*names, "total", "best"],
        )
        # a slot is only a part of its prefix, so its total may be small
        return batch.filter(pa.array((total >= min_count) | (keys[2].to_numpy() >= 0)))

    wait = None
    for batch in batches:
        batch = batch if wait is None else pa.Table.from_batches([wait, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        first, offsets, run, word, times = _sums(batch)
        keys = [batch.column(n).take(pa.array(first)) for n in range(3)]
        # the last key may go on in the next batch
        last = len(first) - 1
        cut = int(offsets[last])
        if last:
            yield told([k.slice(0, last) for k in keys], offsets[: last + 1], run[:cut], word.slice(0, cut), times[:cut])
        one = pa.array([0, len(times) - cut], pa.int32())
        texts = _entries(one, pa.concat_arrays([word.slice(cut)]), times[cut:])
        wait = pa.RecordBatch.from_arrays([*(pa.concat_arrays([k.slice(last)]) for k in keys), *texts], schema=batch.schema)
    if wait is not None:
        _, offsets, run, word, times = _sums(wait)
        yield told([wait.column(n) for n in range(3)], offsets, run, word, times)


# ---- operator


def _phrases(stripes: DataFrame) -> DataFrame:
    """``lang, phrase, a`` of the frequent extensions in merged stripes."""
    entries = stripes.select("lang", "prefix", F.explode(F.arrays_zip("next", "times")).alias("e"))
    return entries.select("lang", F.concat_ws(" ", "prefix", "e.next").alias("phrase"), F.col("e.times").alias("a"))


def _top(rows: DataFrame, by: str, order: list, name: str, top: int, total: int) -> DataFrame:
    """Rows of the first ``top`` ranks of each ``by``; a task ranks a bounded part of a group before its first ones meet."""
    parts = -(-total // RANKED) or 1
    if parts > 1:
        part = Window.partitionBy(by, F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        rows = rows.withColumn("_part_rank", F.row_number().over(part)).where(F.col("_part_rank") <= top).drop("_part_rank")
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long"))
    return ranked.where(F.col(name) <= top)


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED, longest: int = LONGEST
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of two to ``longest`` words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` all words of the
    language; the score is ``floor(2000000 * a / (l + r))``. Phrases with fewer than ``min_count``
    occurrences do not count, nor those whose words lie inside a longer one with ``covered`` percent of
    their occurrences: one word longer is enough to look at, since the count falls with each word.

    Null languages are ``und``, null texts empty; whole texts are counted, repeated rows as often as they
    come; other columns are ignored; an empty table, or one without frequent phrases, gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = rows.mapInArrow(_unigrams, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    words = materialise(words.where((F.col("a") >= min_count) | (F.col("phrase") == "")), "frequent_words")
    all_words = words.where("phrase = ''").select("lang", F.col("a").alias("n"))
    total = all_words.agg(F.sum("n")).first()[0] or 0
    level, maps, tables = words.where("phrase != ''").where(F.col("a") >= min_count), [], []
    for size in range(1, longest):
        maps.append(frequent(level, level.count()))
        # a position begins one prefix, so at most HEAVY of them have so large a share
        heavy = level.where(F.col("a") * HEAVY > total).collect()
        heavy = np.sort(phrase_hashes([r["phrase"] for r in heavy], [r["lang"] for r in heavy]))
        shared = spark.sparkContext.broadcast((list(maps), heavy))
        stripes = rows.mapInArrow(partial(_stripes, size=size, shared=shared), STRIPE)
        dealt = stripes.repartition("lang", "prefix", "slot").sortWithinPartitions("lang", "prefix", "slot")
        tables.append(materialise(dealt.mapInArrow(partial(_merge, min_count=min_count), MERGED), f"stripes_{size}"))
        level = _phrases(tables[-1])

    stripes = tables[0]
    for table in tables[1:]:
        stripes = stripes.unionByName(table)
    heads = stripes.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("total").alias("f"), F.max("best").alias("best"))
    heads = counted(materialise(heads.where(F.col("f") >= min_count), "prefixes"))
    found = materialise(_phrases(stripes).withColumn("words", F.split("phrase", " ")), "phrases")

    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    head, rest = F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, F.size("words"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(head, " ").alias("head"), F.array_join(rest, " ").alias("rest"))
    cuts = cuts.join(heads.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(heads.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = "cast({} as decimal(20, 0))".format
    score = F.expr(f"{wide('a')} * {SCALE} div ({wide('l')} + {wide('r')})").alias("score")
    # a phrase has at most three cuts
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.array_min(F.collect_list(F.struct(score, "k", "l", "r"))).alias("cut"))

    inside = found.where(F.size("words") > 2).select("lang", F.array_join(F.slice("words", F.lit(2), F.size("words")), " ").alias("phrase"), "a")
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("before"))
    # phrases of the greatest length are no prefixes, and nothing longer holds them
    both = worst.join(heads.select("lang", "phrase", "best"), ["lang", "phrase"], "left").join(inside, ["lang", "phrase"], "left")
    most = F.greatest(F.coalesce("best", F.lit(0)), F.coalesce("before", F.lit(0))).alias("most")
    both = both.select("lang", "phrase", "a", "cut", most)
    left = materialise(both.where(f"{wide('most')} * 100 < {wide('a')} * {covered}").drop("most"), "candidates")
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    ranked = _top(left, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "rank", top, left.count())
    return ranked.join(counted(all_words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
