"""Phrases and their filters against plain counts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cloakframe.llm import phrases, quotient
from cloakframe.llm.quotient import Shape


@pytest.mark.parametrize("n, bits, slot_bits", [(2, 1, 3), (2, 3, 4), (3, 13, 6), (5, 13, 6), (5, 12, 0), (4, 25, 5), (5, 33, 8), (5, 62, 10)])
def test_filter_round_trip(n, bits, slot_bits):
    draw = np.random.default_rng(n * bits)
    shape = Shape(n, bits, slot_bits)
    ids = draw.integers(0, min(1 << bits, 40 if bits > 5 else 1 << bits), (5000, n))
    ids[:50] = (1 << bits) - 1
    limbs = quotient.permute(quotient.pack(list(ids.T), shape), shape)
    back = quotient.unpack(quotient.unpermute(limbs.copy(), shape), shape)
    assert (back == ids).all()
    want = Counter(map(tuple, ids.tolist()))
    parts = []
    for some in np.array_split(limbs, 7, axis=1):
        keys, counts = quotient.counted(some)
        slots = quotient.slot_of(keys, shape)
        assert (np.diff(slots) >= 0).all()
        for slot in np.unique(slots).tolist():
            mine = slots == slot
            blob = quotient.write(keys[:, mine], counts[mine], shape)
            read = quotient.read(blob, slot, shape)
            assert (read[0] == keys[:, mine]).all() and (read[1] == counts[mine]).all()
            parts.append(read)
    keys, counts = quotient.merge(parts)
    found = quotient.unpack(quotient.unpermute(keys.copy(), shape), shape)
    assert dict(zip(map(tuple, found.tolist()), counts.tolist())) == want


def test_large_counts_and_equal_first_limbs():
    shape = Shape(2, 60, 2)
    keys = np.array([[5, 5, 5, 9, 5], [2, 1, 2, 0, 1]], np.uint64)
    found, counts = quotient.counted(keys, np.array([300, 1, 1 << 40, 255, 254]))
    assert found.tolist() == [[5, 5, 9], [1, 2, 0]] and counts.tolist() == [255, (1 << 40) + 300, 255]
    read = quotient.read(quotient.write(found, counts, shape), 0, shape)
    assert (read[0] == found).all() and (read[1] == counts).all()


def plain(rows, min_count, first, percent):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        line = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", line):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if a >= min_count and len(p) > 1}
        kept = []
        for p, a in candidates.items():
            inside = (
                100 * b >= percent * a
                for q, b in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            )
            if any(inside):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, lo, r) in enumerate(sorted(kept)[:first], 1):
            out.append((lang, rank, p.decode(), -a, lo, r, n[lang], -s))
    return Counter(out)


def sample(seed, texts=300):
    draw = random.Random(seed)
    words = ["The", "tHe", "big", "apple", "Pie", "é", "É", "x\x1cy", "<|endoftext|>", "don't", *(f"w{i}" for i in range(30))]
    fixed = ["new york city hall steps", "a a a a a a", "kick the bucket", "one two, three"]
    ends = [" ", " ", " ", " ", "  ", "\t", ".", ", ", "\n", "\r\n", "\x0b", "?", " . "]
    rows = []
    for _ in range(texts):
        said = [
            draw.choice(fixed) if draw.random() < 0.2 else words[min(int(draw.expovariate(0.15)), len(words) - 1)]
            for _ in range(draw.randint(0, 40))
        ]
        rows.append((draw.choice(["en", "en", "en", "de", None, ""]), "".join(w + draw.choice(ends) for w in said)))
    return [*rows, *rows[:20], ("en", None), (None, ""), ("fr", " .. "), ("en", "long text " * 400_000)]


@pytest.mark.parametrize("min_count, first, percent", [(5, 2000, 100), (3, 7, 60)])
def test_collocations(spark, monkeypatch, min_count, first, percent):
    rows = sample(min_count)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "lang string, text string, ids int, word string")
    want = plain(rows, min_count, first, percent)
    assert want
    found = phrases.collocations(docs, min_count=min_count, first=first, absorb_percent=percent)
    assert Counter(map(tuple, found.collect())) == want
    # Small steps and filters, a crowded bit table, and ids without a broadcast.
    for name, value in {"STEP": 50, "WORDS": 40, "KEYS": 60, "SLOT_ENTRIES": 1000, "TABLE_BITS": 6}.items():
        monkeypatch.setattr(phrases, name, value)
    rows = rows[:-1]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    found = phrases.collocations(docs, min_count=min_count, first=first, absorb_percent=percent, max_bytes=1)
    assert Counter(map(tuple, found.collect())) == plain(rows, min_count, first, percent)


def test_nothing_frequent(spark):
    for rows in ([], [("en", "a b c")], [(None, None)]):
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert phrases.collocations(docs).collect() == []


def test_score_beyond_64_bits(spark):
    big = 10**15
    candidates = spark.createDataFrame([("en", [0, 1], big)], "lang string, ids array<bigint>, a bigint")
    parts = spark.createDataFrame([([0], big + 1), ([1], big + 7)], "ids array<bigint>, a bigint")
    langs = spark.createDataFrame([("en", 10**16)], "lang string, n bigint")
    row = phrases._scored(candidates, parts, langs).first()
    assert row["score"] == 1000 * big * 10**16 // ((big + 1) * (big + 7))
