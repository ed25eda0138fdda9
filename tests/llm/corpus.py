"""A small table of documents with every awkward case, and plain re-derivations."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}o" for i in range(400)] + ["the", "of", "and", "Ünder", "niño", "a"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed: int = 7) -> list[tuple]:
    rng = random.Random(seed)
    shared = prose(rng, 130)
    base = prose(rng, 180)
    texts: list[str | None] = [None, "", "  ", "one", "Two words", "a\nb  c", "aaaa " * 300, "x" * 3000]
    texts += [prose(rng, rng.randint(5, 120)) for _ in range(12)]
    texts += [prose(rng, 30) + " " + shared + " " + prose(rng, 20) for _ in range(5)]  # a shared passage
    texts += [shared[3:] + "\n" + prose(rng, 9), shared + shared]
    texts += [base] * 5  # copies
    for _ in range(6):  # near copies
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts.append(base[: len(base) // 2])
    texts.append("ÄÖ ß " * 90)
    rows = [(i * 3 + 1, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[10])  # a repeated row
    rows.append((None, texts[9], None, None, None))
    return rows


def removed(texts: list[str | None], length: int) -> list[bytearray]:
    """Per text a mark for each byte in a repeated ``length``-byte string."""
    datas = [(t or "").encode() for t in texts]
    counts = Counter(d[p : p + length] for d in datas for p in range(len(d) - length + 1))
    marks = []
    for d in datas:
        mark = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if counts[d[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        marks.append(mark)
    return marks


def kept(data: bytes, mark: bytearray) -> bytes:
    return bytes(c for c, m in zip(data, mark) if not m)


def kept_hash(text: str | None, mark: bytearray) -> str:
    return sha256(kept((text or "").encode(), mark)).hexdigest()


def fingerprint(text: str | None, width: int = 3) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items: list, linked) -> dict:
    """Item -> smallest item that links reach."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {x: find(x) for x in items}


def jaccard(a: str, b: str, width: int = 5) -> float:
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def byte_losses(texts: list[bytes], marks: list[bool], order: int):
    """Mean loss per byte of each text under (target, background), Witten-Bell."""
    import math

    models = []
    for some in ([t for t, m in zip(texts, marks) if m], texts):
        count, after = Counter(), defaultdict(set)
        for t in some:
            padded = bytes(order - 1) + t
            for i in range(order - 1, len(padded)):
                for n in range(order):
                    context = padded[i - n : i]
                    count[n, context, padded[i]] += 1
                    count[n, context] += 1
                    after[n, context].add(padded[i])

        def p(context, c, count=count, after=after):
            out = 1 / 256
            for n in range(order):
                part = context[len(context) - n :]
                u, total = len(after[n, part]), count[n, part]
                if total:
                    out = (count[n, part, c] + u * out) / (total + u)
            return out

        models.append(p)
    result = []
    for t in texts:
        padded = bytes(order - 1) + t
        sums = [
            sum(-math.log(p(padded[i - order + 1 : i], padded[i])) for i in range(order - 1, len(padded)))
            for p in models
        ]
        result.append([s / max(1, len(t)) for s in sums])
    return result
