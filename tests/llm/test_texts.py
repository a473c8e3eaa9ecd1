"""Tokens, packing, personal data, secrets, licences, passages and quality against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from readgrove.llm import decontam, packing, pii, quality, secrets, tokens, urls
from readgrove.llm.licenses import CUES, SENTENCES, find_licenses
from readgrove.llm.oracles import ORACLES

from .conftest import DOCS, LONG

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [*"abAB .,!-_12", "\n", "\t", "  ", "\r\n", "\x1c", "\x85", "\xa0", "　", "'s", "'re", "'S", "２", "é", "é", "H̱", "Σ", "ΑΣ ", "İ",
       "ß", "日本", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "!,", "​", "K"]


def odd_texts(n=3000):
    rng = random.Random(4)
    return ["".join(rng.choices(ODD, k=rng.randint(0, 30))) for _ in range(n)]


def ids_of(texts, path):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    texts = [*odd_texts(), "a" * 3000, "ab" * 2000]
    counter = tokens.MergeCounter(BYTES)
    assert [counter.count(t) for t in texts] == [len(x) for x in ids_of(texts, BYTES)]


def test_ids_equal_the_library():
    texts = odd_texts()
    found = packing.WordEncoder(WORDS).encode(texts)
    assert found == [np.array(x, "<u4").tobytes() for x in ids_of(texts, WORDS)]


def test_token_counts(docs):
    want = sorted((str(i), len((t or "").encode()), len(x), len(x) > 512) for (i, t), x in zip(DOCS, ids_of([t or "" for _, t in DOCS], BYTES)))
    rows = tokens.count_tokens(docs, BYTES).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in rows) == want
    assert tokens.count_tokens(docs.limit(0), BYTES).count() == 0


def checked(rows, capacity):
    """Every sequence is filled from 0 without gaps, up to the capacity at most."""
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [4096, 16])
def test_packing(docs, capacity):
    rows = packing.pack(docs, WORDS, capacity).collect()
    want = []
    for (i, t), ids in zip(DOCS, ids_of([t or "" for _, t in DOCS], WORDS)):
        ids = [*ids, 1]
        for n, a in enumerate(range(0, len(ids), capacity)):
            cut = ids[a : a + capacity]
            want.append((str(i), n, a, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert sorted((str(r[0]), *tuple(r)[1:5]) for r in rows) == sorted(want)
    used = checked(rows, capacity)
    assert used <= 1.02 * sum(w[3] for w in want) / capacity + 1
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_patterns_use_the_stock_exactly_and_fill_well():
    rng = random.Random(5)
    for _ in range(30):
        capacity = rng.choice([7, 50, 200])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 400)))
        patterns = packing.plan_patterns(counts, capacity)
        used = Counter()
        for pattern, times in patterns:
            assert sum(pattern) <= capacity and times > 0
            for x in pattern:
                used[x] += times
        assert used == counts and len(patterns) <= 2 * len(counts) + capacity
        # no two sequences could be one
        room = sorted(capacity - sum(p) for p, n in patterns for _ in range(n))
        assert len(room) < 2 or room[-1] + room[-2] < capacity or len(counts) == 1


BASE_PII = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and pii.luhn(re.sub("[^0-9]", "", m))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def slow_pii(text):
    return sorted((m.start(), k, m.end()) for k, (pattern, good) in enumerate(BASE_PII) for m in pattern.finditer(text or "") if good(m[0]))


def test_fixed_formats_of_personal_data():
    rng = random.Random(6)
    parts = ["a@b.c", "@", ".", "a", "x-y", "1", "23", "256", "4111 1111 1111 1111", "+1", "(55)", "-", " ", "%", "1.2.3.4", "é", "+", "0005"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(text) == slow_pii(text)
    assert not pii.luhn("4111111111111112") and pii.luhn("4111111111111111")


def test_personal_data(spark, docs):
    rows = pii.find_personal_data(docs).collect()
    want = [(str(i), hashlib.sha256(pii.spans_text(slow_pii(t)).encode()).hexdigest()) for i, t in DOCS]
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows) == sorted(want)
    assert pii.find_personal_data(docs.limit(0)).count() == 0


WORDS_AROUND = "the of and lot house river sold open note item page about many small green market season".split()


def planted(rng, kind):
    """Personal data outside the fixed formats: its text."""
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == "spelled":
        name = "".join(rng.choices("abcdefgh", k=6))
        return rng.choice([f"{name} at mail dot com", f"{name}[at]web[dot]org", f"{name} (at) site (dot) de"])
    if kind == "address":
        return ":".join(f"{rng.randrange(65536):x}" for _ in range(8))
    if kind == "card":
        while not pii.luhn(number := "4" + digits(15)):
            pass
        return rng.choice([".", "/"]).join(number[n : n + 4] for n in range(0, 16, 4))
    area, mid, end = str(rng.randint(200, 999)), str(rng.randint(200, 999)), digits(4)
    return rng.choice([f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"0{digits(2)} {digits(3)} {digits(4)}"])


def personal_corpus(rng, n):
    """Texts with data in the fixed formats, with planted data of other formats, and without any; and the planted spans."""
    texts, spans = [], {}
    kinds = {"spelled": "email", "address": "ip", "card": "card", "phone": "phone"}
    cues = {"spelled": "write to ", "address": "host ", "card": "card ", "phone": "call "}
    for i in range(n):
        around = [" ".join(rng.choices(WORDS_AROUND, k=rng.randint(3, 12))) for _ in range(2)]
        turn = i % 10
        if turn < 4:  # the fixed formats
            base = [f"u{i}@host{i}.com", f"10.{i % 256}.3.4", "4111 1111 1111 1111", f"+1 212 555 {1000 + i % 9000}"][turn]
            body = ["write to ", "host ", "card ", "call "][turn] + base
        elif turn < 6:
            kind = list(kinds)[(i // 10 + 2 * turn) % 4]
            data = planted(rng, kind)
            body = cues[kind] + data
            at = len(around[0]) + 1 + len(cues[kind])
            spans[i] = (kinds[kind], at, at + len(data))
        else:  # numbers that are nothing of the kind
            body = rng.choice([f"lot {rng.randint(10**6, 10**8)}", f"on 2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} at 12:30:45", f"v1.{i}.3", "at the dot matrix", f"no. {rng.randint(10**15, 10**16)}", "x @ y"])
        texts.append((i, f"{around[0]} {body} {around[1]}"))
    return texts, spans


def test_planted_data_of_other_formats_is_added_and_nothing_else(spark):
    texts, spans = personal_corpus(random.Random(7), 4000)
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in pii.find_personal_data(table).collect()}
    by_id, found, right = dict(texts), Counter(), Counter()
    for i, r in rows.items():
        base = set(pii.spans_text(pii.base_spans(by_id[i])).split(","))
        for span in set(filter(None, r["spans"].split(","))) - base:
            kind, a, b = span.split(":")
            found[kind] += 1
            right[kind] += spans.get(i) == (kind, int(a), int(b))
            # whatever is added as a card number passes its check
            assert kind != "card" or pii.luhn(re.sub("[^0-9]", "", by_id[i][int(a) : int(b)]))
    there = Counter(kind for kind, _, _ in spans.values())
    for kind in ("email", "ip", "card", "phone"):
        assert right[kind] >= 0.9 * there[kind] > 0, (kind, right, there)
        assert right[kind] >= 0.95 * found[kind], (kind, right, found)


def test_a_list_of_numbers_is_found_number_by_number():
    cards = ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "4222 2222 2222 2220", "4539 1488 0343 6467"]
    text = "cards " + " ".join(cards) + " end"
    spans = {text[a:b] for a, k, b in pii.candidates(text) if k == 2}
    assert set(cards) <= spans
    assert len(pii.candidates("1 " * 50_000)) <= 8 * 3 * 50_000
    long = "a" * 300 + "@" + "b" * 300 + ".com"
    assert (0, 0, len(long)) in pii.candidates(long)


def test_validators():
    good = [(0, "a at b dot com"), (0, "joe[at]site[dot]org"), (0, "jö@site.com"), (1, "2001:db8::1"), (1, "fe80:0:0:0:1:2:3:4"), (2, "4111.1111.1111.1111"), (3, "(212) 555-1234"), (3, "030 123 4567")]
    bad = [(0, "at the dot com"), (0, "look at it"), (0, "a at b dot matrix"), (1, "12:30:45"), (1, "aa:bb:cc:dd:ee:ff"), (2, "4111.1111.1111.1112"), (2, "0000 0000 0000 0000"), (3, "2024-01-05"), (3, "12345678")]
    assert all(pii.valid(k, b, "") for k, b in good) and not any(pii.valid(k, b, "") for k, b in bad[1:])
    assert pii.valid(3, "12345678", "please call ")
    assert pii.spelled_out("a (at) b dot co dot uk") == "a@b.co.uk"


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


def test_secrets(spark, docs):
    rng = random.Random(8)
    parts = ["token", "PassWord", "api_key", "apikey", "secret", "=", ":", '"', "'", " ", "abc", "x1y2z3q", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "😀", "\n", "."]
    texts = dict(enumerate(["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(1500)]))
    texts[2000] = "f" * 30 + " " + " ".join(["0123456789abcdef01234567"] * 700)  # more matches than are summed at once
    texts[2001] = "k9J2mQx7Lw4Zt8Vb3Nc6Yr1Pd5Hg0Sf and thethethe1thethetheThethethe"
    table = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in secrets.find_secrets(table).collect()}
    for i, text in texts.items():
        assert rows[i]["base_sha256"] == hashlib.sha256(slow_secrets(text).encode()).hexdigest(), text
    assert rows[2001]["spans"] == "random:0:31"
    odd = secrets.find_secrets(docs).collect()
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in odd) == sorted((str(i), hashlib.sha256(slow_secrets(t or "").encode()).hexdigest()) for i, t in DOCS)
    assert secrets.find_secrets(docs.limit(0)).count() == 0


def test_false_discovery_control_rejects_what_is_not_random():
    # 90 likely strings and 10 impossible ones: these are rejected, the likely ones are not
    bound = secrets.rejection_bins([("s", 0, 60), ("s", 5, 30), ("s", 200, 10)])["s"]
    assert 5 < bound <= 200
    assert secrets.rejection_bins([("s", 0, 100)])["s"] > secrets.STEPS


def test_licenses(spark, docs):
    assert all(re.search(CUES, s) for s in SENTENCES.values())
    mit = "x y. " + SENTENCES["mit-1"].replace(" ", "\n", 9) + "\n\n" + SENTENCES["as-is"] + " " + SENTENCES["no-liability"]
    texts = [(1, mit + "\nThis file is licensed under CC BY 4.0.\nfoo | bar"), (2, "a | b\nReleased under the  MIT License.\nc"), (3, "licensed"), (4, SENTENCES["as-is"])]
    rows = find_licenses(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in rows} == {1: (4, "CC-BY-4.0,MIT"), 2: (1, "MIT"), 3: (0, ""), 4: (1, "")}
    assert find_licenses(docs).count() == len(DOCS) and find_licenses(docs.limit(0)).count() == 0


def test_licenses_as_published(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL
"""
    names = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
    gnu = """This %s is free software%s you can redistribute it and/or
modify it under the terms of the GNU %s Public
License as published by the Free Software Foundation%s either
version %s of the License, or (at your option) any later version.
"""
    texts = {
        "MIT": mit, "MPL-2.0": mpl, "Apache-2.0": apache, "BSD-2-Clause": bsd % "", "BSD-3-Clause": bsd % names,
        "GPL-2.0-or-later": gnu % ("program", ";", "General", ";", "2"), "LGPL-2.1-or-later": gnu % ("library", ";", "Lesser General", ";", "2.1"),
        "LGPL-3.0-or-later": gnu % ("program", ":", "Lesser General", ",", "3"), "AGPL-3.0-or-later": gnu % ("program", ":", "Affero General", ",", "3"),
    }
    rows = find_licenses(spark.createDataFrame(list(enumerate(texts.values())), "doc_id bigint, text string")).collect()
    assert [r["licenses"] for r in sorted(rows, key=lambda r: r["doc_id"])] == list(texts)
    assert {r["doc_id"]: r["n_sentences"] for r in rows}[2] == 5


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_within_the_budget_are_found_and_no_others():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefg", k=rng.randint(2, 6))) for _ in range(200)]
    items = [" ".join(rng.choices(words, k=rng.randint(3, 40))) for _ in range(60)] + ["short", ""]
    index = decontam.Index.of(list(range(len(items))), items)
    texts, asked = [], []
    for n, item in enumerate(items[:60]):
        start, end = rng.choice(list(decontam.passages(len(item))))
        letters = list(item[start:end])
        for _ in range(rng.randint(0, int(0.08 * (end - start)) + 2)):
            at = rng.randrange(len(letters))
            if rng.random() < 0.5:
                letters[at] = rng.choice("hijk")
            else:
                letters.insert(at, rng.choice("hijk"))
        other = " ".join("".join(rng.choices("lmnopq", k=5)) for _ in range(rng.randint(0, 30)))
        texts.append(decontam.normalise(other + " " + "".join(letters) + " " + other))
        asked.append(n)
    found = decontam.find_leaks(texts, index)
    assert found == [f for t in texts for f in decontam.find_leaks([t], index)]
    for text, n, hits in zip(texts, asked, found):
        near = [(a, b) for a, b in decontam.passages(len(items[n])) if edits(items[n][a:b], text) <= int(decontam.EDITS * (b - a))]
        assert (n in hits) == bool(near)
        if n in hits:
            assert 0 <= hits[n][0] < hits[n][1] <= len(text)


def test_a_passage_is_found_whatever_stands_beside_it():
    rng = random.Random(19)
    item = "".join(rng.choices("abcdefgh ", k=600)).strip()
    item = decontam.normalise(item)
    index = decontam.Index.of([1, 2], [item, decontam.normalise("".join(rng.choices("ijklmn ", k=300)))])
    texts = [item[:150], item[250:400], "other words", item[100:260], index.texts[1][20:180], item[:150], "", item[250:400]]
    alone = [decontam.find_leaks([t], index)[0] for t in texts]
    assert [sorted(hits) for hits in alone] == [[0], [0], [], [0], [1], [0], [], [0]]
    for _ in range(40):
        order = rng.sample(range(len(texts)), len(texts))
        assert decontam.find_leaks([texts[n] for n in order], index) == [alone[n] for n in order]


def test_short_items_are_found_within_their_budget():
    rng = random.Random(20)
    for width in range(decontam.Q, 140):
        item = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=width))
        index = decontam.Index.of([width], [item])
        window = min(width, decontam.WINDOW)
        budget = int(decontam.EDITS * window)
        letters = list(item[:window])
        for n in range(budget):  # spread so that as few q-grams as can be stay whole
            letters[(n + 1) * window // (budget + 1)] = "0"
        assert decontam.find_leaks(["xyz " + "".join(letters) + " zyx"], index)[0], width


def test_decontamination(spark, docs):
    item = "what is the capital of the kingdom of the far north and who has built its oldest bridge over the river"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "tiny")], "item_id bigint, text string")
    texts = [(1, f"Intro. {item.upper()}  more"), (2, "tiny words only"), (3, None), (4, item[:50]), (5, LONG + item), (5, LONG + item), (None, item)]
    table = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = decontam.contaminated(table, bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["edits"]) for r in rows) == [("1", 1, 0), ("5", 1, 0), ("5", 1, 0), ("None", 1, 0)]
    assert sorted(r["doc_id"] for r in decontam.decontaminate(table, bench).collect()) == [2, 3, 4]
    assert decontam.decontaminate(docs, bench).columns == docs.columns
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == len(DOCS)


def slow_pool(vectors, text):
    """Word by word what ``quality.Pooler`` counts and multiplies."""
    words, forms = ({t: n + first for n, t in enumerate(known)} for known, first in ((vectors.words, 1), (vectors.shapes, 2)))
    total, n = np.zeros(2 * quality.SIZE), 0
    for part in quality.text_parts(text or ""):
        last = None
        for long in part.split():
            for at in range(0, len(long), quality.LONG):
                word = long[at : at + quality.LONG]
                letters = "".join(c for c in word.lower() if c.isalpha())
                sign = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isnumeric() else c for c in word)
                sign = re.sub(r"(.)\1+", r"\1", sign)
                total[: quality.SIZE] += vectors.word_table[words.get(letters, 0)]
                total[quality.SIZE :] += vectors.shape_table[forms.get(sign, 0)] + (word == last) * vectors.shape_table[1]
                last, n = word, n + 1
    return total / max(n, 1)


def random_vectors(seed, words, forms):
    rng = np.random.default_rng(seed)
    tables = [np.round(rng.normal(size=(n, quality.SIZE)) / quality.GRID) * quality.GRID for n in (len(words) + 1, len(forms) + 2)]
    return quality.Vectors(words, forms, *tables)


def test_pooling_equals_word_by_word(monkeypatch):
    vectors = random_vectors(1, ["the", "cat", "écoute", "x" * 64], ["a", "A", "Aa", "a.", "0", "A!", "a0a"])
    rng = random.Random(21)
    parts = ["the", "The", "CAT!!", "cat.", "x" * 150, "12", "Écoute", " ", " ", "\n\t", "a1b", "...", "日本"]
    texts = [None, "", " \n ", "x" * 1000, *("".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400))]
    want = [slow_pool(vectors, t) for t in texts]
    assert (quality.Pooler(vectors).pool(texts) == np.array(want)).all()
    assert all((quality.Pooler(vectors).pool([t])[0] == w).all() for t, w in zip(texts[:50], want))
    # the end of a long text counts: not only a first stretch of it
    assert (quality.Pooler(vectors).pool(["q" * 5000 + "."])[0] != quality.Pooler(vectors).pool(["q" * 5000 + "!"])[0]).any()
    monkeypatch.setattr(quality, "PIECE", 40)
    assert (quality.Pooler(vectors).pool(texts) == np.array([slow_pool(vectors, t) for t in texts])).all()


def test_two_models_in_one_worker_score_by_their_own_vectors():
    zero, layers = np.zeros(2 * quality.SIZE), [np.random.default_rng(3).normal(size=s) for s in ((2 * quality.SIZE, quality.HIDDEN), quality.HIDDEN, quality.HIDDEN, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(["the cat"] * 3)], ["text"])
    for seed in range(50):
        model = quality.Model(random_vectors(seed, ["the", "cat"], ["a"]), zero, zero + 1, layers, 1.0)
        want = model.probability(np.array([slow_pool(model.vectors, "the cat")] * 3))
        assert (next(quality._scores(model, iter([batch]), 0))[1] == want).all()
        del model


def test_quality_learns_and_keeps_to_its_rows(spark, docs):
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows, labels = [], []
    for n in range(900):
        words = [word() for _ in range(rng.randint(20, 80))]
        bad = n % 4 == 0
        rows.append((n, " ".join(w.upper() + "!!" for w in words) if bad and n % 8 else " ".join([words[0]] * 60) if bad else " ".join(words) + "."))
        labels.append((n, int(not bad)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    found = {r["doc_id"]: r for r in quality.quality_scores(table, known).collect()}
    held = {n for n, _ in labels if zlib.crc32(str(n).encode()) % 4 == 2}
    assert {n for n, r in found.items() if r["held_out"]} == held and 150 < len(held) < 300
    assert sum(found[n]["predicted"] == dict(labels)[n] for n in held) >= 0.98 * len(held)
    # labels of held-out rows change nothing
    turned = spark.createDataFrame([(n, 1 - q if n in held else q) for n, q in labels], "doc_id bigint, quality int")
    again = {r["doc_id"]: r["score"] for r in quality.quality_scores(table, turned).collect()}
    assert all(abs(again[n] - r["score"]) < 1e-12 for n, r in found.items())
    kept = {r["doc_id"] for r in quality.keep_quality(table, known).collect()}
    assert kept == {n for n, r in found.items() if r["score"] >= 0.7}


def test_quality_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality.quality_scores(docs, none).collect()
    assert len(rows) == len(DOCS) and {r["score"] for r in rows} == {1.0}
    ones = spark.createDataFrame([(1, 1), (None, 0), (2, None), (2, 1)], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.quality_scores(docs, ones).collect()} == {1.0}
    assert quality.keep_quality(docs, ones).columns == docs.columns
    assert quality.quality_scores(docs.limit(0), ones).count() == 0


def test_url_rules_and_aliases(spark):
    link = '<html><head><link rel="canonical" href="{}"></head>'
    pages = [
        (1, "https://www.Example.org/es/1?x#y", None), (2, "http://example.org", ""), (3, "no scheme", "x"), (4, None, None),
        (5, "https://a.net/one", link.format("https://b.com/de/two")), (6, "https://c.net/x", '<meta http-equiv="refresh" content="0; url=https://a.net/one">'),
        (7, "https://d.net/", link.format("https://b.com/fr/q")), (8, "https://d.net/#top", None), (9, "https://e.net/", None),
        (9, "https://e.net/", None), (None, "https://b.com/de/two", None), (11, "https://example.org/en/12", None), (12, "https://f.net/z", link.format("/y")),
        (13, "https://f.net/y", link.format("https://d.net/")), (14, "ftp://org/", None),
    ]
    table = spark.createDataFrame([(*p, "u", "v") for p in pages], "page_id bigint, url string, html string, node string, rule string").repartition(3)
    found = sorted(((str(r[0]), r[1], r[2], str(r[3]), r[4]) for r in urls.judge_urls(table, urls.rule_table(spark)).collect()))
    want = [
        ("1", "www.example.org", "/es/1", "example.org/es/", "block"), ("2", "example.org", "", "None", "allow"), ("3", "", "", "None", "allow"), ("4", "", "", "None", "allow"),
        ("5", "a.net", "/one", "None", "block"), ("6", "c.net", "/x", "None", "block"), ("7", "d.net", "/", "None", "allow"), ("8", "d.net", "/", "None", "allow"),
        ("9", "e.net", "/", "None", "allow"), ("9", "e.net", "/", "None", "allow"), ("None", "b.com", "/de/two", "com/de/", "block"), ("11", "example.org", "/en/12", "example.org/en/1", "block"),
        ("12", "f.net", "/z", "None", "allow"), ("13", "f.net", "/y", "None", "allow"), ("14", "org", "/", "org/", "allow"),
    ]
    assert found == sorted(want)
    # pages that a dot segment, a second link, a scheme-relative link or a name in the same folder makes an alias
    odd = [
        (21, "https://h.net/a/b/c?q", link.format("../../x/./y/../de/z")), (22, "https://h.net/x/de/z", link.format("//b.com/de/two")),
        (23, "https://i.net/dir/page", link.format("https://i.net/safe") + link.format("https://b.com/de/two")),
        (24, "https://j.net/dir/page", link.format("next?a=1&amp;b=2")), (25, "https://j.net/dir/next?a=1&b=2", link.format("https://b.com/de/two#f")),
        (26, "https://k.net/p", link.format("mailto:x@b.com") + link.format("#top")), (27, "https://l.net", link.format("q/..")), (28, "https://l.net/", link.format("https://b.com/de/two")),
    ]
    more = spark.createDataFrame([*odd, (29, "https://b.com/de/two", None)], "page_id bigint, url string, html string")
    assert {r[0]: r[4] for r in urls.judge_urls(more, urls.rule_table(spark)).collect()} == {21: "block", 22: "block", 23: "block", 24: "block", 25: "block", 26: "allow", 27: "block", 28: "block", 29: "block"}
    import duckdb

    for frame in (table.select("page_id", "url", "html"), more):
        con = duckdb.connect()
        con.register("pages", frame.toArrow())
        want = sorted(map(str, con.execute(ORACLES["op7_url_filters"]).fetchall()))
        assert sorted(str(tuple(r)) for r in urls.judge_urls(frame, urls.rule_table(spark)).collect()) == want
    joined = spark.createDataFrame([("https://e.net/", "https://b.com/de/two")], "source string, target string")
    verdicts = {r[0]: r[4] for r in urls.judge_urls(table, urls.rule_table(spark), joined).collect()}
    assert verdicts[9] == "block" and verdicts[7] == "allow"
    assert urls.judge_urls(table.limit(0), urls.rule_table(spark)).count() == 0
