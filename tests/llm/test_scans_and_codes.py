"""Licence scans, importance resampling and vector codes against brute force, with nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import license_scan as L
from larkspan.llm import resampling as S
from larkspan.llm import vector_codes as V
from larkspan.llm.license_rules import RULES, WORTH

R = random.Random(7)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PIECES = [
    "Licensed under the Apache License, Version 2.0", "Released under the MIT License.", "MIT License", "Licensed under CC BY-NC 4.0.", "cc by", "CC-BY-SA 3.0", "GNU General Public License", "under the terms of the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-2.0-or-later",
    "SPDX-License-Identifier: MIT", "All rights reserved.", "Copyright (c) 2020, 2021", "https://www.apache.org/licenses/LICENSE-2.0", "This project is MIT licensed", "BSD 3-Clause License", "LGPL v2.1", "the Unlicense", "public domain", "Mozilla Public License 2.0", "licensed under some other terms license",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit", "gnu", "Éclair ÀB", "license", "x", "Key", "0", "apache",
]


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def scan(text):
    """The contract and the rules, one by one, over the words of a text."""
    words = words_of(text)
    places = [(p, i) for p in L.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    joined, found = f" {' '.join(words)} ", []
    for r in RULES:
        if f" {r.keyword}" in joined:
            for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", joined, re.ASCII):
                start = joined[: m.start()].count(" ") - 1
                found.append((start, start + m.group().count(" ") + 1, r.level, r.number, r.label))
    left = []
    for d in found:
        inside = any(e != d and e[0] <= d[0] and e[1] >= d[1] and (e[2] < d[2] or e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3])) for e in found)
        holds = any(d[0] <= e[0] and d[1] >= e[1] and e[2] < d[2] for e in found)
        if not inside and not holds:
            left.append(d)
    base = sorted({L.PHRASES[p] for p, _ in places})
    doubt = math.prod([1 - WORTH[d[2] - 1] for d in left]) * (1 - L.PHRASE_WORTH if base else 1)
    starts = [i for _, i in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *[d[4] for d in left]})), doubt, sorted(left)


@pytest.mark.parametrize("block", [256, 2])
def test_licence_scan(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    texts = [None, "", " ,.; ", "mit license", *[" ".join(R.choice(PIECES) for _ in range(R.randint(1, 12))) for _ in range(80)], "mit license " * 400, "wort " * 60000 + "Apache License " + "wort " * 60000]
    rows = [(i, t, "x", i, i, "y") for i, t in enumerate(texts)] + [(None, "cc by", "x", 1, 1, "y"), (3, "MIT License", "x", 1, 1, "y"), (3, "MIT License", "x", 1, 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, base long, n_words long, found string").repartition(3)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"]), r) for r in L.license_scan(docs).collect())
    want = sorted(((-1 if r[0] is None else r[0]), *scan(r[1])) for r in rows)
    assert len(got) == len(want)
    for (key, r), w in zip(got, want, strict=True):
        assert (key[0], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == w[:7], (w, r)
        assert r["score"] == pytest.approx(1 - w[7], abs=2e-6) and 0 <= r["score"] <= 1
        assert sorted((d["start"], d["end"], d["level"], d["rule"], d["label"]) for d in r["found"]) == w[8]
    assert L.license_scan(docs.where("false")).count() == 0


def test_rules_are_sound():
    assert len(RULES) > 250 and all(re.compile(r.pattern) and r.keyword == r.keyword.lower() and r.pattern == r.pattern.strip() for r in RULES)
    finds = re.compile(L.any_keyword([r.keyword for r in RULES]))
    assert all(finds.match(f" {r.keyword}") for r in RULES)


def resampled(texts, target, orders, buckets=10_000, percent=10, least=20):
    def features(t):
        w = words_of(t)
        return [" ".join(w[i : i + n]) for n in range(1, orders + 1) for i in range(len(w) - n + 1)], len(w)

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    docs = [(i, *features(t)) for i, t in texts]
    s, t = Counter(bucket(f) for _, x, _ in docs for f in x), Counter(bucket(f) for x in target for f in features(x)[0])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets))))
    rows = []
    for i, x, n in docs:
        weight = sum(gain(bucket(f)) for f in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], -r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3], r[5] or 0) for r in rows)


@pytest.mark.parametrize(("orders", "percent"), [(1, 10), (1, 100), (3, 40)])
def test_importance_resampling(spark, orders, percent):
    lexicon = ["Alpha", "beta", "GAMMA", "déjà", "x1", "42", "ÀÉ", "omega"]
    texts = [(i, " ".join(R.choice(lexicon) for _ in range(R.randint(0, 60)))) for i in range(90)]
    texts += [(90, None), (91, ""), (92, ",,, !"), (93, "-alpha beta-"), (94, "word " * 20000), (5, texts[5][1]), (5, texts[5][1]), (None, "alpha " * 30), (None, None)]
    target = ["beta gamma alpha " * 5, None, "", "omega déjà"]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in texts], "doc_id long, text string, key string, n int").repartition(3)
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = S.importance_resampling(docs, bench, orders=orders, percent=percent).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_features"], r["weight"], r["score"], r["rank"] or 0) for r in got) == resampled(texts, target, orders, percent=percent)


def test_resampling_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    got = S.importance_resampling(docs, bench, percent=100).orderBy("doc_id").collect()
    assert [(r["n_features"], r["rank"]) for r in got] == [(30, 1), (0, None)]
    assert S.importance_resampling(docs.where("false"), bench).count() == 0


def coded(rows, parts, entries, rounds):
    """Every distance, by whole numbers of any size."""
    kept = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows]
    width = len(kept[0][2]) // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(r[2])[p] for r in order[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            groups = {}
            for _, _, v in kept:
                x = cut(v)[p]
                groups.setdefault(near(p, x)[1], []).append(x)
            moved.append([[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])])
        books = moved
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, label, v in kept:
        best = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    total = Counter()
    for _, label, _, e in out:
        total[label] += e
    return sorted(((i is None, i or 0, c, e, total[label]) for i, label, c, e in out)), digest


@pytest.mark.parametrize(("parts", "entries", "rounds", "spread"), [(4, 8, 2, 1.0), (2, 64, 2, 0.02), (8, 30, 0, 50.0), (1, 3, 3, 60000.0)])
def test_vector_codes(spark, parts, entries, rounds, spread):
    rng = np.random.default_rng(parts)
    # Coarse values, so that many distances tie.
    vectors = (np.round(rng.normal(size=(150, 8)) * 4) / 4 * spread / 4).clip(-65536, 65536).astype(np.float32)
    rows = [(i, R.choice([None, 1, 2]), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(3, 1, rows[7][2]), (3, 1, rows[7][2]), (None, None, rows[9][2])] + [(200 + i, 2, rows[0][2]) for i in range(40)]
    dropped = [(-1, 1, None), (-2, 1, []), (-3, 1, [1.0] * 7 + [None]), (-4, 1, [1.0] * 7 + [float("nan")]), (-5, 1, [float("inf")] + [0.0] * 7), (500, 1, [1.0] * 16), (501, 1, [1e30] * 8), (502, 1, [1.0] * 7)]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows + dropped], "vec_id long, label int, embedding array<float>, code string, error int").repartition(3)
    got = V.vector_codes(table, parts=parts, entries=entries, rounds=rounds).collect()
    want, digest = coded(rows, parts, entries, rounds)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_tree_finds_the_nearest_entry():
    rng = np.random.default_rng(1)
    for k in (1, 2, 7, 64, 256):
        book, points = rng.integers(-6, 7, (k, 3)), rng.integers(-9, 10, (400, 3))
        square = ((points[:, None] - book[None]) ** 2).sum(2)
        number, best = V.nearest(V.tree(book), book, points)
        assert (number == square.argmin(1)).all() and (best == square.min(1)).all()


def test_vector_codes_without_rows(spark):
    empty = spark.createDataFrame([(1, 1, None)], "vec_id long, label int, embedding array<float>")
    for t in (empty, empty.where("false")):
        got = V.vector_codes(t)
        assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        V.vector_codes(empty, entries=257)


def test_columns_that_clash(spark):
    table = spark.createDataFrame([(1, 1, [0.5] * 16, "s")], "vec_id long, label int, embedding array<float>, same string").withColumn("v", F.lit(1))
    assert V.vector_codes(table).first()["error"] == 0
