"""Middles, collocations and sketches against plain Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readgrove.llm import collocations as col
from readgrove.llm import middles, sketches

from .conftest import DOCS, LONG

# ---- fill in middle


def slow_middle(doc_id, text):
    """The contract in plain Python: n, form, prefix and middle characters, output."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text or "")
    text, n = text or "", len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def middle_texts():
    rng = random.Random(31)
    parts = ["a", "word", " ", "  ", "\n", "\t\v", "é", "😀", "<", "<P", "P>", "<S>", "$1", "\\", "\x00", "\x85", "\xa0", "{3}", "-"]
    return [(i, "".join(rng.choices(parts, k=rng.randint(0, 25)))) for i in range(2000)]


def test_middles_equal_the_contract(spark, docs):
    rows = [*middle_texts(), (5000, "x " * 60_000), (5001, "y" * 300_000), (5002, " " * 50_000 + "z"), (5003, "<S"), (None, "a b c"), (7, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = middles.fill_in_middle(table).withColumn("again", middles.restored(F.col("output"), F.col("form")))
    key = lambda r: tuple(map(str, r))
    found = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in cut.collect()), key=key)
    assert found == sorted(((i, *slow_middle(i, t)) for i, t in rows), key=key)
    assert sorted(r["again"] for r in cut.collect()) == sorted(t or "" for _, t in rows)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    odd = middles.fill_in_middle(docs).collect()
    assert sorted((str(r["doc_id"]), r["output"]) for r in odd) == sorted((str(i), slow_middle(i, t)[4]) for i, t in DOCS)
    assert middles.fill_in_middle(docs.limit(0)).count() == 0


def test_middles_with_other_marks_and_shares(spark):
    how = middles.Middles(seed=7, percent=100, suffix_first_percent=0, prefix="<|pre|>", suffix="<|suf|>", middle="<|mid|>")
    table = spark.createDataFrame([(i, f"one two three {i} <P> four") for i in range(50)] + [(50, "has <|suf|> inside")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in middles.fill_in_middle(table, how).withColumn("again", middles.restored(F.col("output"), F.col("form"), how)).collect()}
    assert rows[50]["form"] == "plain" and all(rows[i]["form"] == "psm" and rows[i]["output"].startswith("<|pre|>") for i in range(50))
    assert all(r["again"] == t for (i, t), r in zip([(r["doc_id"], r["text"]) for r in table.collect()], [rows[i] for i in range(51)]))
    with pytest.raises(ValueError):
        middles.Middles(prefix="<S>")


# ---- collocations


def slow_collocations(rows, min_count, top):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows_of = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_of.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, le, r) in enumerate(sorted(rows_of)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, le, r, totals[lang], -score))
    return sorted(out)


def phrase_rows(n=400):
    rng = random.Random(33)
    words = ["the", "of", "New", "york", "City", "hall", "a", "é", "É", "x-y", "日本", "<b>", "'s", "big"]
    fixed = ["new york city hall", "New York", "of the", "the end is near", "a a a a a"]
    marks = [" ", " ", "  ", "\t", ". ", ", ", "\n", "!", ";", "\r\n"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(fixed if rng.random() < 0.3 else words) + rng.choice(marks) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "fr", None]), text))
    return rows + [("en", None), ("en", ""), ("de", "rare words only"), (None, " \n ,,, ")]


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, small):
    if small:  # many stretches, every prefix heavy, a map that lets most phrases pass, ranks in parts
        for name, value in {"STRETCH": 3000, "PART": 300, "HEAVY": 10**6, "SLOTS": 3, "MOST_BITS": 1 << 15, "BITS_EACH": 1, "SENT": 7, "RANKED": 20}.items():
            monkeypatch.setattr(col, name, value)
    rows = phrase_rows()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(5)
    for min_count, top in ((30, 2000), (5, 40)):
        found = sorted(tuple(r) for r in col.collocations(table, min_count=min_count, top=top).collect())
        want = slow_collocations(rows, min_count, top)
        assert found == want and len(want) > 20
    assert col.collocations(table.limit(0)).count() == 0
    assert col.collocations(spark.createDataFrame([("en", "too few words")], "lang string, text string")).count() == 0


def test_stretches_sent_to_python_workers_are_whole_pieces():
    text = ("alpha beta gamma. " * 40).encode()
    assert b"".join(b"".join(p) for p in col._parts([text, b"", text])) == text * 2
    old, col.PART = col.PART, 50
    try:
        parts = [x for p in col._parts([text]) for x in p]
        assert len(parts) > 5 and b"".join(parts) == text and all(p.endswith(b".") for p in parts[:-1])
    finally:
        col.PART = old


def test_a_large_document_of_one_piece_counts_whole(spark):
    table = spark.createDataFrame([("en", "alpha beta " * 200_000)], "lang string, text string")
    rows = {r["phrase"]: r["a"] for r in col.collocations(table).collect()}
    assert rows == {"alpha beta alpha beta": 199_999, "beta alpha beta alpha": 199_998}


# ---- sketches


def slow_hashes(text):
    words = (text or "").encode().lower().split()
    if not words:
        return []
    rows = [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or [b" ".join(words)]
    import xxhash

    return sorted({xxhash.xxh3_64_intdigest(r, seed=sketches.SEED) >> 16 for r in rows})


def slow_followed(rows, k):
    """id, n, edited, sketch, edited sketch, next sketch by sorting everything."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] or "").encode()))
    out = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), edited, *(slow_hashes(x)[:k] for x in (t, edited, after))))
    return sorted(out, key=str)


def followed_rows(table, **options):
    return sorted((tuple(r) for r in sketches.followed_sketches(table, **options).collect()), key=str)


def test_sketch_of_a_long_text_is_merged_from_its_parts(monkeypatch):
    rng = random.Random(41)
    texts = [" ".join(rng.choices(["a", "b", "Çé", "long-word", "x"], k=n)) for n in (0, 1, 4, 5, 6, 300, 3000)] + [LONG[:5000], "  \n "]
    for piece in (1 << 20, 64, 7):
        monkeypatch.setattr(sketches, "PIECE", piece)
        for text in texts:
            for k in (3, 128):
                assert sketches.sketch(text, 5, k).tolist() == slow_hashes(text)[:k]


@pytest.mark.parametrize("bucket", [32 << 20, 2000, 1])
def test_followed_sketches_equal_brute_force(spark, docs, bucket):
    rng = random.Random(42)
    words = ["a", "b", "c", "é", "😀x", "\n", "lorem"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in rng.sample(range(10_000), 120)]
    rows += [(rows[0][0], "a second text of that id"), rows[1], (None, "no id"), (None, None), (10**12, ""), (-5, "last of all")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert followed_rows(table, bucket_bytes=bucket, k=16) == slow_followed(rows, 16)
    assert followed_rows(docs, bucket_bytes=bucket) == slow_followed(DOCS, sketches.K)


def test_followed_sketches_of_tiny_tables(spark):
    schema = "doc_id bigint, text string"
    assert followed_rows(spark.createDataFrame([], schema)) == []
    for rows in ([(1, "just one text of six words")], [(None, "x y z")], [(None, "a"), (None, "b c")], [(3, "x")] * 4):
        assert followed_rows(spark.createDataFrame(rows, schema)) == slow_followed(rows, sketches.K)


def test_estimates_are_near_the_truth(spark):
    rng = random.Random(43)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(5000)]
    rows, truth = [], []
    for n in range(40):
        base = rng.choices(words, k=2000)
        cut = rng.randint(0, 2000)
        a, b = " ".join(base), " ".join(base[:cut] + rng.choices(words, k=rng.randint(0, 1500)))
        x, y = set(slow_hashes(a)), set(slow_hashes(b))
        rows.append((n, a, b))
        truth.append((len(x & y) / len(x | y), len(x & y) / len(x), len(y)))
    table = spark.createDataFrame(rows, "n int, a string, b string")
    one = sketches.text_sketches(table, "n", "a").withColumnRenamed("sketch", "x")
    two = sketches.text_sketches(table, "n", "b").withColumnRenamed("sketch", "y")
    x, y = F.col("x"), F.col("y")
    found = one.join(two, "n").select("n", sketches.resemblance(x, y).alias("j"), sketches.containment(x, y).alias("c"), sketches.distinct_shingles(y).alias("d"))
    errors = np.array([[abs(r["j"] - t[0]), abs(r["c"] - t[1]), abs(r["d"] - t[2]) / max(1, t[2])] for r, t in zip(found.orderBy("n").collect(), truth)])
    assert (errors.max(axis=0) < [0.18, 0.35, 0.45]).all() and (errors.mean(axis=0) < [0.05, 0.1, 0.1]).all()


def test_sketches_of_parts_merge_to_that_of_the_whole(spark, docs):
    rng = random.Random(44)
    rows = [(rng.choice(["s0"] * 8 + ["s1", "s2", None]), " ".join(rng.choices("abcdefghijklm", k=rng.randint(0, 30)))) for _ in range(3000)] + [("empty", "")]
    table = spark.createDataFrame(rows, "source string, text string").repartition(9)
    parts = sketches.text_sketches(table, "source", "text")
    found = {r["source"]: r["sketch"] for r in sketches.merge_sketches(parts, ["source"]).collect()}
    whole = {s: sorted({h for q, t in rows if q == s for h in slow_hashes(t)})[: sketches.K] for s, _ in rows}
    assert found == whole
    a, b = (parts.where(F.col("source") == s).limit(1).select(F.col("sketch").alias(s)) for s in ("s1", "s2"))
    row = a.crossJoin(b).select(sketches.merged(F.col("s1"), F.col("s2")).alias("m"), "s1", "s2").first()
    assert row["m"] == sorted({*row["s1"], *row["s2"]})[: sketches.K]
    assert sketches.merge_sketches(parts.limit(0), ["source"]).count() == 0
    assert sketches.text_sketches(docs).count() == len(DOCS) and sketches.text_sketches(docs.limit(0)).count() == 0
    equal = sketches.text_sketches(docs).groupBy("doc_id").agg(F.countDistinct(sketches.sketch_text(F.col("sketch"))).alias("n")).where("doc_id = 2").first()
    assert equal["n"] == 1
