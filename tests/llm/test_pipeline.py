"""The stages of the pipeline, one after the other, against plain re-derivations."""

from __future__ import annotations

import itertools
import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus  # noqa: E402
import corpus_pipeline  # noqa: E402

from cloakframe.llm import tokens  # noqa: E402

EXTRA = corpus.SCHEMA + ", score string, root long, key string, length long, items long, n_removed string"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder of tables: the awkward documents, good and bad prose, leaks."""
    rng = random.Random(21)
    rows = corpus.documents()
    bench = [(i, corpus.prose(rng, 25)) for i in range(4)] + [(9, None)]
    at = 1000
    for i in range(160):
        text = corpus.prose(rng, 70)
        if i % 4 == 0:
            text = "\n".join(f"{w} | | !!" for w in text.split())
        elif i % 16 == 1:
            text = corpus.prose(rng, 30) + " " + bench[i % 4][1] + " " + corpus.prose(rng, 30)
        rows.append((at + i, text, "en", "src9", len(text)))
    labels = [(at + i, 0 if i % 4 == 0 else 1, 0) for i in range(160)]
    path = str(tmp_path_factory.mktemp("world"))
    full = [(*r, "x", 1, "k", 2, 3, "n") for r in rows]
    spark.createDataFrame(full, EXTRA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, bench


def _words_left(texts: list[str], length: int) -> list[list[str]]:
    split = [t.encode().split() for t in texts]
    counts = Counter(tuple(w[p : p + length]) for w in split for p in range(len(w) - length + 1))
    out = []
    for words in split:
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            if counts[tuple(words[p : p + length])] > 1:
                gone[p : p + length] = [True] * length
        out.append([w.decode() for w, g in zip(words, gone) if not g])
    return out


def test_stages(spark, world):
    path, rows, bench = world
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [
        "quality_classifier", "simhash_near_dedup", "suffix_array_dedup",
        "benchmark_decontamination", "best_fit_packing",
    ]

    def keep(df, name):
        made = stages[name](spark, df, path)
        made.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    good = keep(docs, "quality_classifier")
    assert good.columns == docs.columns
    ids = {r["doc_id"] for r in good.collect()}
    assert {i for i in range(1000, 1160) if (i - 1000) % 4} <= ids  # clean ones stay
    assert not {i for i in range(1000, 1160) if (i - 1000) % 4 == 0} & ids

    single = keep(good, "simhash_near_dedup")
    assert single.columns == docs.columns
    before, after = good.collect(), single.collect()
    texts = sorted({r["text"] or "" for r in before})
    true = corpus.classes(texts, lambda a, b: corpus.jaccard(a, b) >= 0.8)
    kept = Counter(true[r["text"] or ""] for r in after)
    assert set(kept) == set(true.values())
    assert set(kept.values()) == {1}

    cut = keep(single, "suffix_array_dedup")
    assert cut.columns == docs.columns and cut.count() == len(after)
    want = _words_left([r["text"] or "" for r in after], corpus_pipeline.REPEAT_WORDS)
    got = {(r["doc_id"]): r for r in cut.collect()}
    changed = 0
    for r, words in zip(after, want):
        now = got[r["doc_id"]]
        assert (now["text"] or "").split() == [w for w in words]
        if len(words) < len((r["text"] or "").encode().split()):
            changed += 1
            assert now["n_chars"] == len(now["text"])
        else:
            assert now["text"] == r["text"]
    assert changed > 3

    clean = keep(cut, "benchmark_decontamination")
    held = {r["doc_id"] for r in cut.collect() if any(_overlap(r["text"] or "", t) for _, t in bench if t)}
    assert len(held) >= 8 and {r["doc_id"] for r in clean.collect()} == set(got) - held

    pieces = keep(clean, "best_fit_packing").collect()
    total = Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    left = clean.collect()
    sizes = tokens.encode([r["text"] for r in left])
    assert total == {r["doc_id"]: len(s) + 1 for r, s in zip(left, sizes)}
    load = Counter()
    for r in pieces:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= corpus_pipeline.CAPACITY


def _overlap(text: str, item: str) -> bool:
    """Every diagonal, every stretch: 13 tokens (or the whole item), four fifths equal."""
    a, b = (re.findall(r"[^\W_]+", t.lower()) for t in (text, item))
    least = min(13, len(b))
    for d in range(least - len(b), len(a) - least + 1):
        same = [a[i + d] == w for i, w in enumerate(b) if 0 <= i + d < len(a)]
        if 5 * sum(same) < 4 * least:
            continue
        upto = [0, *itertools.accumulate(same)]
        for i in range(len(same) - least + 1):
            if any(5 * (upto[j] - upto[i]) >= 4 * (j - i) for j in range(i + least, len(same) + 1)):
                return True
    return False


def test_empty_tables(spark, world, tmp_path):
    path, _, _ = world
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
