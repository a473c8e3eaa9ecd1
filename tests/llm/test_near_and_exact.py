"""Near and exact copies against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readgrove.llm import simhash
from readgrove.llm.components import connected_components
from readgrove.llm.exact import drop_exact_duplicates, exact_duplicates

from .conftest import DOCS


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(40)]
    table = spark.createDataFrame([*edges, (None, 3), (7, 7)], "a bigint, b bigint")
    want = groups([e for e in edges if e[0] != e[1]], {x for e in edges if e[0] != e[1] for x in e})
    assert {r["node"]: r["component"] for r in connected_components(table).collect()} == want
    assert connected_components(table.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 70, 200])
def test_blocks_find_every_close_pair_and_no_other(size):
    rng = np.random.default_rng(size)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    order = [p for p in range(64) if not simhash.MASKS[0] >> p & 1]
    fp = np.array([centre ^ np.uint64(sum(1 << int(p) for p in rng.choice(order, rng.integers(0, 6), replace=False))) for _ in range(size)], np.uint64)
    zero = np.zeros(size, np.int64)
    for radius in (0, 1, 2, 3):
        rows = simhash._Rows(fp, radius)
        links = [(int(a), int(b)) for x, y in simhash._compare(zero, zero, zero, np.arange(size), rows) for a, b in zip(x, y)]
        pairs = [(i, j) for i in range(size) for j in range(i + 1, size) if int(fp[i] ^ fp[j]).bit_count() <= radius]
        assert groups(links, range(size)) == groups(pairs, range(size))


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_of_full_buckets(spark, bucket):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(40)})
    table = spark.createDataFrame([(signed(v), i) for i, v in enumerate(values)], "fp bigint, id bigint")
    links = [tuple(r) for r in simhash.close_links(table, bucket=bucket).collect()]
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 3]
    assert groups(links, range(len(values))) == groups(pairs, range(len(values)))


def test_simhash_of_odd_documents(spark, docs):
    rows = simhash.simhash_components(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in rows) == sorted((str(i), f"{slow_fingerprint(t):016x}") for i, t in DOCS)
    prints = [(i, slow_fingerprint(t)) for i, t in DOCS]
    root = groups([(a, b) for _, a in prints for _, b in prints if (a ^ b).bit_count() <= 3], {f for _, f in prints})
    smallest = defaultdict(list)
    for i, f in prints:
        smallest[root[f]] += [i] if i is not None else []
    want = sorted((str(i), str(min(smallest[root[f]], default=None))) for i, f in prints)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in rows) == want
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def near_kept(rows):
    """Ids of (id, text) rows that near dedup keeps."""
    prints = [(i, slow_fingerprint(t)) for i, t in rows if i is not None]
    values = sorted({f for _, f in prints})
    root = groups([(a, b) for n, a in enumerate(values) for b in values[n + 1 :] if (a ^ b).bit_count() <= 3], values)
    smallest = {}
    for i, f in prints:
        smallest[root[f]] = min(i, smallest.get(root[f], i))
    return {i for i, f in prints if smallest[root[f]] == i}


def test_near_dedup_keeps_one_of_each_group(spark, docs):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for n in range(40):
        words = [word() for _ in range(900)]
        texts.append((100 * n, " ".join(words)))
        for c in range(n % 3):
            copy = list(words)
            copy[rng.randrange(900)] = word()
            texts.append((100 * n + c + 1, " ".join(copy)))
    texts += [(100, "".join(rng.choices("xyz ", k=400))), (9001, texts[0][1])]  # an id with two texts; a copy
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash.simhash_dedup(table).collect()}
    assert kept == near_kept(texts) and {100 * n for n in range(40)} <= kept and len(kept) < 50
    left = simhash.simhash_dedup(docs)
    assert left.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in left.select("doc_id").collect())
    stay = near_kept(DOCS)
    assert ids == sorted(str(i) for i, _ in DOCS if i is None or i in stay)
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates(spark, docs, keep):
    pick = min if keep == "smallest" else max
    by_text = defaultdict(list)
    for i, t in DOCS:
        by_text[t or ""].append(i)
    want = []
    for i, t in DOCS:
        ids = by_text[t or ""]
        keeper = pick([x for x in ids if x is not None], default=None)
        want.append((str(i), str(keeper), len(ids), i == keeper, hashlib.sha256((t or "").encode()).hexdigest()))
    rows = exact_duplicates(docs, keep=keep).collect()
    assert sorted((str(r[0]), str(r[1]), r[2], r[3], r[4]) for r in rows) == sorted(want)
    left = drop_exact_duplicates(docs, keep=keep)
    assert left.columns == docs.columns
    found = [(r["text"] or "", r["doc_id"]) for r in left.collect()]
    assert sorted(t for t, _ in found) == sorted(by_text)
    assert all(i == pick([x for x in by_text[t] if x is not None], default=None) for t, i in found)
    assert exact_duplicates(docs.limit(0)).count() == 0 and drop_exact_duplicates(docs.limit(0)).count() == 0


def test_runs_of_many_partitions_merge_to_one(spark):
    table = spark.range(2000).select((F.col("id") * 7 % 2000).alias("doc_id"), (F.col("id") % 37).cast("string").alias("text")).repartition(70)
    rows = exact_duplicates(table).select("keep_id", "group_size").distinct().collect()
    assert len(rows) == 37 and sum(r["group_size"] for r in rows) == 2000
