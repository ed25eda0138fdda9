"""Token alignment against whole texts encoded and compared end by end."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import corpus
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from cloakframe.llm import alignment
from cloakframe.llm.common import byte_slices

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "\n", "a\n\nb  c\td", "<|endoftext|> a <|endoftext|>", "</s><s> <unk> <0x0A>",
    "has ▁ a mark", "▁", "naïve café — ‘quoted’ 北京大学 🙂🙂 ﬁ", "it's we'll 12345 67,8", "x\x00y z", "a\x1cb c\x85d e\u3000f g", "e\u0301 \u0301 x",
    "word " * 400, "w" * 3000, "a b\r\n c d\r\n", "  lead and trail  ", " \n x", "don 't", "\u200b \u200b", "a\nb\nc d\n\ne", "\nx\ny ", "x\n y \nz", "end.\nStart\r\nof",
]


def plain(texts):
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment.byte_alphabet()
    rows, links = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = made.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        bytes_a = [bytes(letters[c] for c in made.id_to_token(i)) for i in a]
        bytes_b = [
            bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            rows.append(None)
            continue
        at, ends_b, here = 0, [], []
        for said in bytes_b:
            at += len(said)
            ends_b.append(at)
        at, groups, done_a, done_b = 0, [], 0, 0
        for i, said in enumerate(bytes_a):
            at += len(said)
            for j, end in enumerate(ends_b):
                if end == at:
                    here.append((a[i], b[j]))
                    groups.append(f"{','.join(map(str, a[done_a : i + 1]))}|{','.join(map(str, b[done_b : j + 1]))}")
                    done_a, done_b = i + 1, j + 1
        links.update(here)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        rows.append((len(a), len(b), len(groups), here, digest))
    most: dict[int, int] = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, here, digest = row
        best = sum(links[p] == most[p[1]] for p in here)
        out.append((n_a, n_b, n_groups, len(here), best, sum(links[p] for p in here), digest))
    return out


def test_alignment(spark):
    draw = random.Random(3)
    marks = [" ", " ", " ", "\n", "  ", "\t", ".", ",", "'", "é", "▁", "<|endoftext|>", "\u3000", "1", "北"]
    texts = [*TEXTS, *("".join(draw.choice([*marks, *"etaoin", "the", "ing"]) for _ in range(draw.randint(1, 120))) for _ in range(150))]
    texts += [r[1] for r in corpus.documents()] + TEXTS
    rows = [(None if i % 50 == 7 else i, t, "own") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string")
    found = alignment.align_documents(docs, keep=["doc_id", "n_a"])
    assert found.columns == ["doc_id", *alignment.RESULTS]
    assert Counter(map(tuple, found.collect())) == Counter((r[0], *w) for r, w in zip(rows, plain(texts)))


def test_pairs_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("cloakframe.llm.alignment.small_side", lambda df, rows, size: df)
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = alignment.align_documents(docs, keep=["doc_id"]).collect()
    assert Counter(map(tuple, found)) == Counter((i, *w) for i, w in enumerate(plain(TEXTS)))


def test_no_piece_joins_a_space_to_what_stands_before():
    for side in (alignment.load_a()[1], alignment.load_b()[1]):
        assert not [t for t in side if re.search(r"\S[ \n]", t.decode(errors="replace"))]


def test_groups_of_parts():
    made = alignment.Alignment([" don't", "\n北京", " ▁", " naïve"], alignment.load_a(), alignment.load_b())
    assert made.sound == [True, True, False, True] and made.groups(2) == []
    for part, text in enumerate(made.rendered()):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in made.groups(part))
        assert said == text and [a[-1] << 32 | b[-1] for a, b in made.groups(part)] == made.links()[part]
    assert alignment.Alignment([" ▁"], alignment.load_a(), alignment.load_b()).rendered() == [""]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_documents(docs, keep=["doc_id"]).collect() == []


def test_blocks_of_any_size(monkeypatch):
    sides = (alignment.load_a(), alignment.load_b())
    draw = random.Random(5)
    marks = [" ", " ", " ", "\n", "  ", "\x01", "\x1c", "\u2581", "\x85", "the", "ing", "é", "北", "7"]
    texts = TEXTS + ["".join(draw.choice(marks) for _ in range(draw.randint(1, 60))) for _ in range(200)]
    want = [(w[0], w[1], w[3], w[6]) for w in plain(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for most, parts in ((1, 1), (700, 3), (1 << 20, 64)):
        monkeypatch.setattr(alignment, "LINE_PARTS", parts)
        found = []
        for some in byte_slices([batch], 0, most):
            columns, order = alignment.digests(some.column(0), sides)
            rows = list(zip(*(c.to_pylist() for c in columns[:4])))
            found += [rows[i] for i in np.argsort(order)]
        assert found == want


def test_nothing_is_remembered_of_a_block():
    sides = (alignment.load_a(), alignment.load_b())
    draw = random.Random(6)
    size = lambda: tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    tracemalloc.start()
    try:
        for block in range(4):
            words = ["".join(draw.choices("etaoinshr", k=8)) for _ in range(20_000)]
            alignment.digests(pa.array([" ".join(words)], pa.string()), sides)
            del words
            if not block:
                before = size()
        assert size() - before < 1_000_000
    finally:
        tracemalloc.stop()
