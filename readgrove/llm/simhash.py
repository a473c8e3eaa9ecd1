"""Near-duplicate documents by 64-bit SimHash fingerprints, compared bit-sliced.

Fingerprints that may be close meet in buckets: of five blocks of bits, two must be equal when at
most three bits differ. Inside a bucket 64 fingerprints at a time lie vertically, one machine word
per bit; one query is compared with all 64 by carry-save counters, and blocks in which every
lane has passed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readgrove.llm.components import connected_components
from readgrove.llm.lists import counted
from readgrove.session import materialise

SEED = 42
RADIUS = 3
#: Bits of the five blocks; a pair of blocks is a bucket key, about 26 bits.
BLOCKS = (13, 13, 13, 13, 12)
#: Largest bucket compared in one task; a larger one is dealt out in cells of two parts.
BUCKET = 4096
#: Bytes of text split into words at a time.
PIECE = 1 << 20
SPACES = b" \t\n\r\x0b\x0c"


def _masks() -> list[int]:
    starts = np.cumsum((0, *BLOCKS))
    block = [((1 << int(n)) - 1) << int(s) for n, s in zip(BLOCKS, starts, strict=False)]
    return [block[i] | block[j] for i, j in combinations(range(len(BLOCKS)), 2)]


MASKS = _masks()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# ---- fingerprints


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words in order, in lists that stay small for any length of text."""
    start = 0
    while start < len(text):
        stop = min(start + PIECE, len(text))
        while stop < len(text) and text[stop] not in SPACES:
            stop += 1
        yield text[start:stop].split()
        start = stop


def _hashes(text: str, shingle: int) -> Iterator[np.ndarray]:
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    tail: list[bytes] = []
    whole = True
    for words in _words(text.encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= shingle:
            whole = False
            rows = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            yield np.fromiter(map(digest, rows), np.uint64)
            tail = words[len(words) - shingle + 1 :]
        else:
            tail = words
    if whole and tail:
        yield np.array([digest(b" ".join(tail))], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned fingerprint; a bit is set if it is in over half the shingle hashes."""
    counts, total = np.zeros(64, np.int64), 0
    for h in _hashes(text or "", shingle):
        total += len(h)
        rows = h.astype("<u8").view(np.uint8).reshape(-1, 8)
        for at in range(0, len(rows), 1 << 16):
            bits = np.unpackbits(rows[at : at + (1 << 16)], axis=1, bitorder="little")
            counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc, fp``: per row its id and its fingerprint as a signed long. Null text: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(text.as_py(), shingle)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, fp long")


# ---- bit-sliced comparison


def _planes(fp: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 lanes: ``planes[p, b]`` holds bit p of block b's lanes."""
    out = np.empty((64, len(lanes)), np.uint64)
    for at in range(0, len(lanes), 1024):
        rows = fp[lanes[at : at + 1024]].astype("<u8").view(np.uint8).reshape(-1, 64, 8)
        bits = np.unpackbits(rows, axis=2, bitorder="little").transpose(2, 0, 1)
        packed = np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little"))
        out[:, at : at + 1024] = packed.view("<u8")[:, :, 0]
    return out


def _close(planes: np.ndarray, block: np.ndarray, query: np.ndarray, shut: np.ndarray, order: list[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Per (query, block): a word whose bit is set for every lane within the radius.

    Counters of the distances are kept as bit-sliced sums that start so high that a carry out of
    the top one means more than ``radius``. ``shut`` has the lanes that are not asked for. Returns
    the items not abandoned and their words.
    """
    depth = max(1, radius.bit_length())
    start = (1 << depth) - 1 - radius
    item = np.arange(len(block))
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    over = shut.copy()
    sums = [np.full(len(block), full if start >> i & 1 else 0, np.uint64) for i in range(depth)]
    for n, p in enumerate(order):
        bit = (query >> np.uint64(p)) & np.uint64(1)
        carry = planes[p][block] ^ (np.uint64(0) - bit)
        for i in range(depth):
            sums[i], carry = sums[i] ^ carry, sums[i] & carry
        over |= carry
        if n % 6 == 5:
            keep = over != full
            if keep.sum() < 0.8 * len(keep):
                item, block, query, over = item[keep], block[keep], query[keep], over[keep]
                sums = [x[keep] for x in sums]
                if not len(item):
                    break
    return item, ~over


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after joining the rows x and y; a label is the smallest row of its component."""
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        for rows in (x, y, label[x], label[y]):
            np.minimum.at(new, rows, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link per id that connects what the links (a, b) connect."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _joined(np.arange(len(ids)), flat[: len(a)], flat[len(a) :])
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


@dataclass
class _Rows:
    """Fingerprints of the rows of whole buckets, and the largest distance."""

    fp: np.ndarray
    radius: int

    def pairs(self, first: np.ndarray, end: np.ndarray, planes: np.ndarray, query: np.ndarray, block: np.ndarray, order: list[int], label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the close pairs among (query row, block) items; a block is the rows first..end.

        Pairs that ``label`` says are joined already are not asked for.
        """
        # not asked for: lanes past the end, and those up to the query itself in its own block
        shut = ~_low(end[block] - first[block]) | _low(np.clip(query - first[block] + 1, 0, 64))
        if label is not None:
            lanes = np.minimum(first[block][:, None] + np.arange(64), end[block][:, None] - 1)
            same = np.packbits(label[lanes] == label[query][:, None], axis=1, bitorder="little")
            shut |= np.ascontiguousarray(same).view("<u8")[:, 0]
        item, hit = _close(planes, block, self.fp[query], shut, order, self.radius)
        some = hit != 0
        item, hit = item[some], hit[some]
        bits = np.unpackbits(hit.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        return query[item[row]], first[block[item[row]]] + lane


def _blocks(fp: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    return _planes(fp, np.minimum(first[:, None] + np.arange(64), end[:, None] - 1))


def _small_buckets(rows: _Rows, starts: np.ndarray, ends: np.ndarray, order: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of many buckets of one block each, every row with the rows after it."""
    n = ends - starts
    planes = _blocks(rows.fp, starts, ends)
    query = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    block = np.repeat(np.arange(len(starts)), n)
    for at in range(0, len(query), 1 << 15):
        piece = slice(at, at + (1 << 15))
        yield rows.pairs(starts, ends, planes, query[piece], block[piece], order)


def _large_bucket(rows: _Rows, start: int, cut: int, end: int, order: list[int]) -> np.ndarray:
    """Labels of the rows start..end of one bucket, the smallest row of what each is joined with.

    Rows up to ``cut`` are compared with those after it, or with one another if none are. A few rows
    first: what they join is not compared again, so a group of many copies costs little more
    than its rows.
    """
    low, high = (start, end) if cut == end else (cut, end)
    first = np.arange(low, high, 64)
    last = np.minimum(first + 64, high)
    planes = _blocks(rows.fp, first, last)
    label = np.arange(end)
    at, size = start, 1
    while at < cut:
        query = np.arange(at, min(cut, at + size))
        begin = (query - low) // 64 if cut == end else np.zeros(len(query), np.int64)
        n = len(first) - begin
        block = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        query = np.repeat(query, n)
        for piece in range(0, len(query), 1 << 14):
            part = slice(piece, piece + (1 << 14))
            label = _joined(label, *rows.pairs(first, last, planes, query[part], block[part], order, label))
        at, size = at + size, min(4 * size, 1024)
    return label


def _compare(bucket: np.ndarray, table: np.ndarray, side: np.ndarray, ids: np.ndarray, rows: _Rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links of whole buckets; rows are sorted by table, bucket and side."""
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(edge[1:], len(bucket))
    sided = np.add.reduceat(side, edge)
    several = ends - edge > 1
    edge, ends, sided = edge[several], ends[several], sided[several]
    small = (ends - edge <= 64) & (sided == 0)
    for t in np.unique(table[edge]):
        order = [p for p in range(64) if not MASKS[int(t)] >> p & 1]
        of = table[edge] == t
        if (of & small).any():
            for a, b in _small_buckets(rows, edge[of & small], ends[of & small], order):
                if len(a):
                    yield _forest(ids[a], ids[b])
        for start, end, others in zip(edge[of & ~small], ends[of & ~small], sided[of & ~small], strict=True):
            label = _large_bucket(rows, int(start), int(end - others), int(end), order)[start:]
            moved = np.flatnonzero(label != np.arange(start, end))
            yield ids[start + moved], ids[label[moved]]


def _low(n: np.ndarray) -> np.ndarray:
    """Words with the lowest n bits set, n from 0 to 64."""
    word = (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1)
    return np.where(n >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), word)


def _link_buckets(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows ``table, key, cell, side, fp, id``, sorted in that order, to links ``a, b``."""
    rest = None
    for batch in batches:
        now = [column.to_numpy(zero_copy_only=False).astype(np.int64) for column in batch.columns]
        now = [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)] if rest else now
        if not len(now[0]):
            continue
        # the last bucket may go on in the next batch
        last = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
        cut = int(np.argmax(last))
        yield from _linked([x[:cut] for x in now], radius)
        rest = [x[cut:] for x in now]
    if rest:
        yield from _linked(rest, radius)


def _linked(cols: list[np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    table, key, cell, side, fp, ids = cols
    if len(table) < 2:
        return
    new = (table[1:] != table[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
    bucket = np.concatenate([[0], np.cumsum(new)])
    rows = _Rows(fp.view(np.uint64), radius)
    for a, b in _compare(bucket, table, side, ids, rows):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def close_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links that connect exactly the ids whose fingerprints are chained by close pairs.

    ``fps`` has ``fp, id`` (bigint). A bucket above ``bucket`` rows is dealt in parts of half that size,
    and each two parts are one cell with its own task, so no task holds it whole. No pair in reach is
    left out.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("the bucket keys are exact up to three differing bits")
    keyed = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(MASKS)))
    rows = fps.select("fp", "id", F.explode(keyed).alias("k")).select(F.col("k.t").alias("table"), F.col("k.key").alias("key"), "fp", "id")
    hot = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket)
    hot = materialise(hot.select("table", "key", F.ceil(F.col("n") / (bucket // 2)).cast("int").alias("parts")), "hot_buckets")
    if hot.isEmpty():
        dealt = rows.select("table", "key", F.lit(0).alias("cell"), F.lit(0).alias("side"), "fp", "id")
    else:
        joined = rows.join(hot, ["table", "key"], "left")
        own = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
        cells = joined.withColumn("own", own).withColumn("peer", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        low, high = F.least("own", "peer"), F.greatest("own", "peer")
        dealt = cells.select(
            "table", "key", (low * F.coalesce("parts", F.lit(1)) + high).alias("cell"),
            (F.col("own") > F.col("peer")).cast("int").alias("side"), "fp", "id",
        )
    dealt = dealt.repartition("table", "key", "cell").sortWithinPartitions("table", "key", "cell", "side", "fp")
    return dealt.mapInArrow(partial(_link_buckets, radius=radius), "a long, b long").distinct()


# ---- operators


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs``.

    Fingerprints within ``radius`` bits link; a component's id is its smallest ``doc_id``. Null
    and empty texts have fingerprint zero. Rows without a ``doc_id`` take part and are returned, but
    name no component; repeated rows are returned as often as they come; an empty table gives an
    empty result; other columns are ignored.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    first = materialise(prints.groupBy("fp").agg(F.min("doc").alias("first")), "distinct_fingerprints")
    links = close_links(first.select("fp", F.col("fp").alias("id")), radius)
    comp = materialise(connected_components(links), "components")
    named = first.join(comp, first["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy(F.col("component").alias("c")).agg(F.min("first").alias("component_id"))
    # fingerprint to component, written: the join with the rows can then split a frequent one
    labels = materialise(named.join(smallest, named["component"] == smallest["c"]).select(F.col("fp").alias("f"), "component_id"), "labels")
    joined = prints.join(labels, prints["fp"] == labels["f"])
    return joined.select(
        F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, in their columns, without near copies: of each component the smallest id stays.

    Components are those of ``simhash_components``. Rows without an id always stay, repeated rows stay or
    go together, and an id with several texts goes only if all of them have a smaller id in their
    component, so no component loses its last row. Texts without words are near copies of one another.
    """
    groups = simhash_components(docs.where(F.col(id_col).isNotNull()).select(id_col, text_col), id_col, text_col, shingle, radius)
    own = F.col(id_col).cast("long") == F.col("component_id")
    # an id is in the list once, so no key of the join is hot on both sides
    gone = groups.groupBy(F.col(id_col).alias("_simhash_gone")).agg(F.max(own).alias("_own")).where("not _own").drop("_own")
    gone = materialise(gone, "near_copies")
    return docs.join(counted(gone), docs[id_col] == gone["_simhash_gone"], "left_anti")
