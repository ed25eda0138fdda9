"""The operators on a small awkward table, against plain re-derivations."""

from __future__ import annotations

import itertools
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import corpus  # noqa: E402

from cloakframe.llm import (  # noqa: E402
    binpack,
    chat,
    decontaminate,
    lm,
    packing,
    quality,
    repeats,
    revisits,
    sharding,
    simhash,
    tokens,
    topk,
)
from cloakframe.llm.common import distinct_texts, text_key  # noqa: E402
from cloakframe.llm.components import components  # noqa: E402
from cloakframe.runtime import discard, written  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    return corpus.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, corpus.SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


@pytest.mark.parametrize("copies", [300, 600, 1200])
def test_a_hot_passage_is_few_rows_in_the_joins(spark, copies):
    """The lists of a passage's occurrences do not grow with the texts that hold it."""
    rng = random.Random(copies)
    hot = corpus.prose(rng, 60)
    texts = [(i, f"{corpus.prose(rng, 8)} {hot} {corpus.prose(rng, 8)}") for i in range(copies)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    before = written(spark)
    found = repeats.remove_repeats(docs, length=100)
    lists = [p for p in written(spark) - before if "shared-runs" in p]
    held = spark.read.parquet(lists[0]).groupBy("run0", "run1").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    most = held.orderBy(F.desc("n")).first()
    assert most["n"] >= copies and most["rows"] <= repeats.CHUNKS
    assert found.where("n_removed >= 300").count() == copies


@pytest.mark.parametrize("times", [40, 80])
def test_what_a_text_says_over_and_over_is_few_rows(spark, times):
    """A word, a pair or a line said over and over: rows do not grow with the times."""
    rng = random.Random(times)
    again = ["so ", "to be ", "all rights reserved by the owner\n", corpus.prose(rng, 30) + " "]
    texts = [corpus.prose(rng, i % 9) + " " + again[i % 4] * (times + i % 5) + corpus.prose(rng, i % 7) for i in range(24)]
    texts += ["z" * 10 * times, "yz" * 5 * times + "z", again[1] * times, again[1] * times]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = written(spark)
    found = repeats.remove_repeats(docs, length=100)
    joined = docs.withColumn("key", text_key("text")).join(found, "key").collect()
    marks = corpus.removed(texts, 100)
    want = {i: (sum(m), corpus.kept_hash(t, m)) for i, (t, m) in enumerate(zip(texts, marks))}
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in joined} == want
    lists = [p for p in written(spark) - before if "shared-runs" in p]
    rows = spark.read.parquet(lists[0]).agg(F.sum(F.size("held")).alias("rows"), F.sum("n").alias("n")).first()
    assert rows["rows"] <= 10 * len(texts) < rows["n"]


def test_intermediate_tables_leave_the_catalog(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id long, text string")
    there = {t.name for t in spark.catalog.listTables()}
    texts = distinct_texts(docs)
    assert texts.count() == 1 and len({t.name for t in spark.catalog.listTables()} - there) == 1
    discard(texts)
    assert {t.name for t in spark.catalog.listTables()} == there


def test_repeats_bytes(docs, rows, none):
    length = 100
    found = repeats.remove_repeats(docs, length=length)
    joined = docs.withColumn("key", text_key("text")).join(found, "key").collect()
    marks = corpus.removed([r[1] for r in rows], length)
    want = Counter(
        (r[0], r[1], sum(m), corpus.kept_hash(r[1], m)) for r, m in zip(rows, marks)
    )
    assert Counter((r["doc_id"], r["text"], r["n_removed"], r["kept_sha256"]) for r in joined) == want
    assert sum(n > 0 for (_, _, n, _) in want) > 10
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in joined)
    assert repeats.remove_repeats(none, length=length).count() == 0


def test_repeats_words(docs, rows):
    length = 20
    found = repeats.remove_repeats(docs, length=length, units="words")
    got = {bytes(r["key"]).hex(): bytes(r["kept"]).decode().split() for r in found.collect()}
    texts = [(r[1] or "").encode().split() for r in rows]
    counts = Counter(tuple(w[p : p + length]) for w in texts for p in range(len(w) - length + 1))
    import hashlib

    for r, words in zip(rows, texts):
        mark = [False] * len(words)
        for p in range(len(words) - length + 1):
            if counts[tuple(words[p : p + length])] > 1:
                mark[p : p + length] = [True] * length
        key = hashlib.md5((r[1] or "").encode()).hexdigest()
        assert got[key] == [w.decode() for w, m in zip(words, mark) if not m]


def test_runs_cover_every_window_once():
    rng = random.Random(3)
    for text in ("a" * 500, "ab" * 300, corpus.prose(rng, 200), "".join(rng.choice("ab") for _ in range(900))):
        _, codes, _, _ = repeats.unit_codes(text, "bytes")
        seen = [p for _, at, a, b in repeats.runs(codes, 60, 32) for p in range(a, b + 1) if a <= at]
        assert seen == list(range(len(codes) - 60 + 1))
    assert list(repeats.runs(np.zeros(0, np.uint8), 60, 32)) == []


def test_simhash_classes(docs, rows, none):
    found = simhash.near_duplicates(docs).collect()
    prints = [corpus.fingerprint(r[1]) for r in rows]
    roots = corpus.classes(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = defaultdict(list)
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[roots[p]].append(r[0])
    want = Counter((r[0], p, min(least[roots[p]])) for r, p in zip(rows, prints))
    assert Counter((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in found) == want
    assert simhash.near_duplicates(none).count() == 0


def test_ball_links_are_complete(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = set(base)
    for _ in range(200):
        x = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"))
    assert all(((r["u"] ^ r["v"]) & (2**64 - 1)).bit_count() <= 2 for r in links.collect())
    got = {r["node"]: r["root"] for r in components(links).collect()}
    want = corpus.classes(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {p: got.get(p, p) for p in signed} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200))
    assert 5000 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies(spark, docs, rows, none):
    texts = distinct_texts(docs)
    by_key = {bytes(r["key"]): r["text"] for r in texts.collect()}
    found = {bytes(r["key"]): bytes(r["root"]) for r in simhash.near_copy_classes(texts).collect()}
    true = corpus.classes(sorted(by_key), lambda a, b: corpus.jaccard(by_key[a], by_key[b]) >= 0.8)
    for key, root in found.items():  # no wrong link
        assert true[key] == true[root]
    missed = [k for k in by_key if true[k] != k and k not in found]
    assert not missed
    clashing = docs.withColumn("score", F.lit("x")).withColumn("root", F.lit(1))
    first = simhash.first_of_each_class(clashing)
    assert first.columns == clashing.columns
    kept = first.collect()
    assert len(kept) == len({found.get(k, k) for k in by_key})
    assert simhash.first_of_each_class(none).count() == 0


def near_copies_are_exact(spark, texts):
    table = distinct_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    by_key = {bytes(r["key"]): r["text"].split() for r in table.collect()}
    found = {bytes(r["key"]): bytes(r["root"]) for r in simhash.near_copy_classes(table).collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in by_key.items()}
    true = corpus.classes(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert {k: found.get(k, k) for k in sets} == true
    return len(sets) - len(set(true.values()))


def test_pairs_stay_few_where_most_shingles_are_common(spark, monkeypatch):
    """Texts of common passages with a quarter of their own: no pair is alike, and the
    pairs that are tried do not grow with the square of the texts."""
    rng = random.Random(12)
    passages = [corpus.prose(rng, 60) for _ in range(30)]
    tried: dict[str, int] = Counter()
    own = simhash.materialize

    def counted(df, label):
        made = own(df, label)
        if label in ("class-pairs", "candidate-pairs", "remaining-pairs"):
            tried[label] += made.count()
        return made

    monkeypatch.setattr(simhash, "materialize", counted)
    monkeypatch.setattr(simhash, "COUNTED_ONE_IN", 1)
    for texts in (200, 400):
        tried.clear()
        made = [" ".join([rng.choice(passages), rng.choice(passages), corpus.prose(rng, 40)]) for _ in range(texts)]
        table = spark.createDataFrame([(i, t) for i, t in enumerate(made)], "doc_id long, text string")
        keyed = table.select(text_key("text").alias("key"), "text")
        assert simhash.near_copy_classes(keyed).count() == 0
        assert sum(tried.values()) < 4 * texts, tried


def test_near_copies_go_through_fingerprints(spark, docs, monkeypatch):
    """Pairs within two bits are tried first, all of them that have no third text between."""
    rng = random.Random(33)
    texts = [corpus.prose(rng, 900) for _ in range(12)]
    texts += [t + " more" for t in texts] + ["", " \t ", "One two", "one  TWO"]
    table = distinct_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    prints = {bytes(r["key"]): corpus.fingerprint(r["text"]) for r in table.collect()}
    near = [(u, v) for u in prints for v in prints if u > v and (prints[u] ^ prints[v]).bit_count() <= 2]
    got = {(bytes(r["u"]), bytes(r["v"])) for r in simhash.fingerprint_pairs(table).collect()}
    assert got <= set(near) and len(near) >= 8
    whole = corpus.classes(sorted(prints), lambda a, b: (max(a, b), min(a, b)) in set(near))
    assert corpus.classes(sorted(prints), lambda a, b: (max(a, b), min(a, b)) in got) == whole
    asked, own = [], simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **k: asked.append(1) or own(*a, **k))
    simhash.first_of_each_class(docs).count()
    assert asked  # the rows of the stage take this way


def test_near_copies_of_a_template(spark):
    """Texts alike but under 0.8, each with a near copy of its own."""
    rng = random.Random(31)
    template, texts = corpus.prose(rng, 300).split(), []
    for _ in range(300):
        words = template[:261] + corpus.prose(rng, 39).split()
        texts.append(" ".join(words))
        for _ in range(3):
            words[rng.randrange(261)] = "changed"
        texts.append(" ".join(words))
    assert near_copies_are_exact(spark, texts) >= 300


def test_near_copies_with_changed_blocks(spark):
    """A passage appended, put in front, dropped or replaced, about as much as 0.8 allows."""
    rng, texts = random.Random(32), []
    for kind in range(80):
        words = corpus.prose(rng, rng.randint(80, 320)).split()
        n = len(words)
        block = corpus.prose(rng, int(n * rng.choice([0.1, 0.2, 0.23, 0.26]))).split()
        at = rng.randrange(n - len(block))
        changed = {
            0: words + block,
            1: block + words,
            2: words[:at] + words[at + len(block) :],
            3: words[:at] + block[: len(block) // 2] + words[at + len(block) // 2 :],
        }[kind % 4]
        texts += [" ".join(words), " ".join(changed)]
    assert near_copies_are_exact(spark, texts) >= 30


def test_quality_leaves_no_words_in_the_worker(spark):
    """A worker goes on with other work when a task ends, and holds nothing of it."""

    def held(batches):
        yield from ()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(quality._pieces)], pa.int64())], ["n"])

    texts = spark.createDataFrame([(i, f"word{i} other") for i in range(200)], "doc_id long, text string")
    for _ in range(3):
        scored = quality.score(texts.repartition(8), np.zeros(1 << quality.BITS))
        assert scored.where("score = 0.5").count() == 200
        left = spark.range(8).repartition(8).mapInArrow(held, "n long").agg(F.max("n")).first()[0]
        assert left == 0


def test_quality_follows_the_regularised_leader(spark):
    """One shard: the weights of a plain loop over the rows, coordinate by coordinate."""
    rng = random.Random(15)
    rows = [(rng.getrandbits(62), corpus.prose(rng, rng.randint(0, 30)), rng.randint(0, 1)) for _ in range(120)]
    table = spark.createDataFrame(rows, "at long, text string, y int")
    rate, smooth, l1, l2 = 2.0, 1.0, 0.01, 1e-3
    found = quality.fit(table, "text", "y", "at", shards=1, epochs=2, rate=rate, smooth=smooth, l1=l1, l2=l2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        pulled = 0.0 if abs(z[i]) <= l1 else z[i] - math.copysign(l1, z[i])
        return -pulled / ((smooth + math.sqrt(n[i])) / rate + l2)

    def signed(x):
        return (x + (1 << 63)) % (1 << 64) - (1 << 63)

    for epoch in range(2):
        for at, text, y in sorted(rows, key=lambda r: (signed(r[0] * (2 * epoch + 1)), r[2])):
            counts = Counter()
            words = text.encode().split()
            ids = [zlib.crc32(p) for w in words for p in quality._PIECE.findall(w)]
            mask, shift = (1 << 64) - 1, 64 - quality.BITS
            for i in ids:
                counts[(i * int(quality._SPREAD) & mask) >> shift] += 1
            for a, b in zip(ids, ids[1:]):
                counts[((a * int(quality._PAIR) + b) * int(quality._SPREAD) & mask) >> shift] += 1
                if a == b:
                    counts[int(quality._REPEAT) >> shift] += 1
            values = {i: float(np.float32(math.sqrt(c / counts.total()))) for i, c in counts.items()}
            before = {i: weight(i) for i in values}
            off = 1 / (1 + math.exp(-sum(before[i] * v for i, v in values.items()))) - y
            for i, v in values.items():
                g = off * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rate * before[i]
                n[i] += g * g
    want = np.zeros(1 << quality.BITS)
    for i in list(z):
        want[i] = weight(i)
    assert np.count_nonzero(want) > 200 and np.allclose(found, want, atol=1e-9)


def test_quality_learns_and_scores_all(spark, rows, docs, none):
    rng = random.Random(5)
    made = []
    for i in range(300):
        bad = i % 3 == 0
        text = corpus.prose(rng, 60)
        made.append((i, " | ".join(text.split()) if bad else text, 0 if bad else 1))
    table = spark.createDataFrame(made, "doc_id long, text string, quality int")
    labels = table.select("doc_id", "quality").union(
        spark.createDataFrame([(1, 0), (None, 1), (7, None)], "doc_id long, quality int")
    )
    train = quality.training_rows(table.drop("quality"), labels.where(~quality.held_out("doc_id")))
    weights = quality.fit(train, "text", "y", "at")
    scored = quality.score(table, weights).where(quality.held_out("doc_id")).collect()
    assert len(scored) > 30 and all((r["score"] >= 0.5) == (r["quality"] == 1) for r in scored)
    clashing = docs.withColumn("score", F.lit("own"))
    got = quality.score(clashing, weights, name="good").collect()
    assert len(got) == len(rows) and all(0 <= r["good"] <= 1 and r["score"] == "own" for r in got)
    assert all(r["good"] == 0.5 for r in got if not (r["text"] or "").strip())
    with pytest.raises(ValueError):
        quality.score(clashing, weights)
    nothing = quality.fit(quality.training_rows(none, labels.limit(0)), "text", "y", "at")
    assert not nothing.any() and quality.score(none, nothing).count() == 0


def test_tokens_equal_the_reference_vocabulary(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r[1] for r in rows] + [
        "<|endoftext|>", "a <|endoftext|> x", "a  <|endoftext|>\n\n b", "<|endoftext|><|endoftext|>", "x<|endoftext|>y" * 30, "<|endoftext|", "a b<|endoftext|>",
        " a", "a ", " ", "\n", "a\n", "\na", "a\n\nb", "  a", "a\tb c", "<|endoftext|> x", "it's  we'll ' s",
        "½ Ⅷ a1b2 c", "日本 語", "\x01 a b", "a\x1c b", "\xa0a b", "a\r\nb", "x' s 't", "a b c",
    ]
    for text, ids in zip(texts, tokens.encode(texts)):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_packing_places_every_piece(spark, docs, rows, none):
    capacity = 64
    got = packing.pack_documents(docs.withColumn("length", F.lit(1)), ["doc_id"], capacity=capacity, with_ids=True).collect()
    want = Counter()
    for r, ids in zip(rows, tokens.encode([r[1] for r in rows])):
        ids = np.append(ids, np.uint32(packing.END_ID)).astype("<u4")
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"]
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(none, ["doc_id"]).count() == 0


def _least_bins(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j, b in enumerate(bins):
            if b + items[i] <= capacity:
                go(i + 1, [*bins[:j], b + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_against_brute_force():
    for seed in range(120):
        rng = random.Random(seed)
        items = sorted((rng.randint(1, 12) for _ in range(rng.randint(0, 9))), reverse=True)
        made = binpack.pack(Counter(items), 20)
        assert made.bins == _least_bins(items, 20) >= made.bound
        packed = Counter()
        for pattern, times in made.patterns:
            assert sum(pattern) <= 20
            for size in pattern:
                packed[size] += times
        assert +packed == Counter(items)
    with pytest.raises(ValueError):
        binpack.pack({30: 1}, 20)
    # very many small items: long fillings must not cost more than their length
    made = binpack.pack({1: 4000, 2: 3001, 3: 900, 700: 40, 1019: 77}, 1024)
    assert made.bins == made.bound


def test_packing_of_few_lengths_with_copies():
    sizes = {724: 4, 624: 2, 574: 2, 180: 2, 170: 4, 160: 4, 140: 4, 130: 4, 70: 2}
    made = binpack.pack(sizes, 1024)
    assert made.bins == made.bound == 8
    used = Counter()
    for pattern, times in made.patterns:
        assert sum(pattern) <= 1024
        used.update({s: times * n for s, n in Counter(pattern).items()})
    assert used == sizes


def test_packing_is_the_best():
    """Small instances against a search over all packings; a raised bound is a proof."""

    def fewest(items, room):
        seen, now = set(), {((), tuple(items))}
        best = len(items)
        while now:
            bins, rest = now.pop()
            if (bins, rest) in seen or len(bins) >= best:
                continue
            seen.add((bins, rest))
            if not rest:
                best = len(bins)
                continue
            for i in range(len(bins)):
                if bins[i] + rest[0] <= room:
                    now.add((tuple(sorted([*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])), rest[1:]))
            now.add((tuple(sorted([*bins, rest[0]])), rest[1:]))
        return best

    rng = random.Random(33)
    for _ in range(60):
        lengths = [rng.randint(3, 14) for _ in range(4)]
        items = sorted((rng.choice(lengths) for _ in range(rng.randint(4, 10))), reverse=True)
        made = binpack.pack(Counter(items), 20)
        assert made.bins == made.bound == fewest(items, 20)


def test_decontamination(spark, docs, none):
    rng = random.Random(9)
    items = [(i, corpus.prose(rng, 15 + 5 * i)) for i in range(6)] + [(90, None), (91, ""), (92, "Quite short item")]
    long = items[4][1].split()
    swapped = [w if i % 9 != 4 else "other" for i, w in enumerate(long)]  # one in nine replaced
    texts = {
        1: "before " + items[0][1].upper() + " after",
        2: corpus.prose(rng, 40) + " " + " ".join(swapped) + " end",
        3: " ".join(long[:8]),  # too short
        4: "so: quite, SHORT - item!",
        5: None,
        6: corpus.prose(rng, 300),
        7: " ".join(w if i % 3 else "other" for i, w in enumerate(long)),  # a third replaced
    }
    table = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, n int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_bytes in (decontaminate.BLOCK_BYTES, 100):
        found = decontaminate.contaminated(table, bench, ["doc_id"], block_bytes=block_bytes).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 0), (2, 4), (4, 92)}
        counted = decontaminate.with_item_count(table, bench, "items", block_bytes=block_bytes)
        assert {r["doc_id"]: r["items"] for r in counted.collect()} == {i: int(i in (1, 2, 4)) for i in texts}
    assert decontaminate.contaminated(none, bench, ["doc_id"]).count() == 0
    assert decontaminate.contaminated(table, bench.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("n", range(1, 26))
def test_masks_miss_no_substitutions(n):
    """All places of a fifth of the tokens; from 26 tokens on, a half has the share."""
    import itertools

    place = np.arange(n)
    reads = [(np.array([c == "1" for c in m]), len(m)) for m in decontaminate.masks_for(n)]
    for some in itertools.combinations(range(n), n // 5):
        equal = np.ones(n, bool)
        equal[list(some)] = False
        assert any(equal[o : o + size][read].all() for read, size in reads for o in range(n - size + 1)), some
    codes = (place + 1).astype(np.uint64) * np.uint64(77)
    block = decontaminate.Block([(0, codes)])
    changed = codes.copy()
    changed[n // 2 : n // 2 + n // 5] = 5
    around = np.concatenate([np.full(9, 3, np.uint64), changed, np.full(4, 6, np.uint64)])
    assert decontaminate.overlaps(around, block, 13, 0.8)[0] == (9, n, n - n // 5)
    if n > 4:
        changed[0] = 8
        changed[-1] = 9
        assert not decontaminate.overlaps(np.concatenate([changed, changed]), block, max(13, n), 0.8)


def test_short_items_with_a_substitution(spark):
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n))) for n in range(4, 13)]
    docs = [(n, "a b " + t.replace(f"w{n}x2 ", "other ") + " c") for n, t in items]
    found = decontaminate.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]
    )
    assert {tuple(r) for r in found.collect()} == {(n, n, 2, n, n - 1) for n in range(5, 13)}


def test_sharding_balances_and_numbers(spark, none):
    rng = random.Random(2)
    sizes = [(i, rng.choice([1, 5, 9, None, 40]), "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    table = spark.createDataFrame(sizes, "id long, size long, content string")
    got = sharding.shard_by_bytes(table, "size", ["content"], shards=7).collect()
    assert sorted(r["id"] for r in got) == list(range(3000))
    total = sum(s or 0 for _, s, _ in sizes)
    load, slots = Counter(), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"] or 0
        slots[r["shard"]].append(r["slot"])
    assert all(abs(load[s] - total / 7) <= 45 for s in range(7))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    # equal content is in one run of shards
    other = Counter(r["shard"] for r in got if r["content"] != "hot" and r["content"] == "t1")
    assert len(other) == 1
    same = spark.createDataFrame([(1, 3, "a")] * 500, "id long, size long, content string")
    load = Counter(r["shard"] for r in sharding.shard_by_bytes(same, "size", ["content"], shards=5).collect())
    assert sorted(load.values()) == [100] * 5
    assert sharding.shard_by_bytes(table.limit(0), "size", ["content"]).count() == 0
    one = sharding.shard_by_bytes(table.limit(1), "size", ["content"], shards=4).collect()
    assert [r["slot"] for r in one] == [0]
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(table.withColumn("slot", F.lit(1)), "size", ["content"])


@pytest.mark.parametrize("tolerance", [0.05, 1e-9])
def test_splitters_against_sorted_keys(spark, tolerance):
    """Bytes below each splitter: within the tolerance, or as near as any row's key comes."""
    rng = random.Random(14)
    spread = [(rng.choice([1, 3, 9, 700]), rng.getrandbits(63) - (1 << 62), rng.getrandbits(63) - (1 << 62)) for _ in range(900)]
    rows = spread + [(5, 77, rng.getrandbits(40)) for _ in range(400)]  # one content, many rows
    table = spark.createDataFrame(rows, "_size long, _k0 long, _k1 long")
    found = sharding.splitters(table, "_size", 9, tolerance)
    keyed = sorted((f"{a & (1 << 64) - 1:016X}{b & (1 << 64) - 1:016X}", size) for size, a, b in rows)
    total = sum(size for _, size in keyed)
    upto = [0, *itertools.accumulate(size for _, size in keyed)]
    assert len(found) == 8 and found == sorted(found)
    for i, key in enumerate(found, 1):
        below = sum(size for k, size in keyed if k < key)
        nearest = min(abs(u - total * i / 9) for u in upto)
        assert abs(below - total * i / 9) <= max(tolerance * total / 9, nearest) + 1e-6


def _plain_top_k(vectors, queries, k):
    out = []
    for q, a in queries:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(a) == len(b))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [12, 3_000_000_000])
def test_top_k(spark, size):
    rng = random.Random(size)
    vectors = [(i, [rng.randint(-size, size) // rng.choice([1, 1, 6]) for _ in range(8)]) for i in range(400)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(90)]  # copies
    vectors += [(2000, [0] * 8), (2001, [1, 2]), (2002, [3, 4])]
    if size > 100:
        vectors = [(i, [x // 4 for x in v]) for i, v in vectors]
    queries = [v for v in vectors if v[0] % 20 == 0] + [vectors[-1]]
    schema = "id long, vector array<long>"
    table = spark.createDataFrame([*vectors, (None, [1] * 8), (3000, None)], schema)
    got = topk.top_k(table, spark.createDataFrame(queries, schema), k=20, block_rows=64, group_rows=7).collect()
    want = _plain_top_k(vectors, queries, 20)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    assert topk.top_k(table.limit(0), table.limit(0)).count() == 0


def test_repeated_queries_and_candidates(spark):
    rng = random.Random(8)
    vectors = [(i, [rng.randint(-9, 9) for _ in range(6)]) for i in range(80)] + [(33, [9] * 6), (33, [9] * 6)]
    queries = [vectors[20], vectors[20], (20, [1] * 6)]
    schema = "id long, vector array<long>"
    got = topk.top_k(spark.createDataFrame(vectors, schema), spark.createDataFrame(queries, schema), k=10, group_rows=2, block_rows=16)
    want = Counter()
    for _, q in queries:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in vectors if i != 20)[:10]
        want.update((20, r, i, -s) for r, (s, i) in enumerate(scored, 1))
    assert Counter(map(tuple, got.collect())) == want


def test_quantise(spark):
    nan, inf = float("nan"), float("inf")
    table = spark.createDataFrame([([0.5, -0.01],), ([nan],), ([inf, 1.0],), ([None],), (None,), ([],)], "v array<float>")
    got = [r[0] for r in table.select(topk.quantise("v")).collect()]
    assert got == [[32, -1], None, None, None, None, []]


def test_chat_keeps_maximal_conversations(spark):
    rng = random.Random(4)
    talks = [[("user", f"q{rng.randint(0, 3)}"), *(("assistant", f"t{rng.randint(0, 2)}") for _ in range(rng.randint(0, 6)))] for _ in range(60)]
    talks += [[("user", None)], [("user", ""), ("assistant", "x")], [(None, "")], [("user", "hot")] * 40]
    rows = [(i, t, *turn) for i, talk in enumerate(talks) for t, turn in enumerate(talk)]
    rows += [(None, 0, "user", "nobody")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = defaultdict(list)
    for r in chat.format_chats(table.withColumn("position", F.lit("x"))).collect():
        got[r["conv_id"]].append((r["position"], r["rendered"]))
    want = {}
    for i, talk in enumerate(talks):
        longer = any(len(o) > len(talk) and o[: len(talk)] == talk for o in talks)
        if not longer and talks.index(talk) == i:
            want[i] = [(n + 1, f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n") for n, (r, t) in enumerate(talk)]
    want[None] = [(1, "<|im_start|>user\nnobody<|im_end|>\n")]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert chat.format_chats(table.limit(0)).count() == 0


def _resolve_plainly(records):
    """(status, response id) per record, row by row."""
    out = []
    for r in records:
        rid, key, ts, kind, etag, date, digest = r
        if kind == "response":
            out.append(("response", rid))
            continue
        if kind != "revisit":
            out.append(("other", None))
            continue
        earlier = [x for x in records if x[3] == "response" and x[1] == key and key and ts is not None and x[2] is not None and x[2] < ts]
        if not earlier:
            out.append(("orphan", None))
            continue
        last = max(earlier, key=lambda x: (x[2], x[0]))
        for own, theirs, clean in ((etag, last[4], True), (date, last[5], False), (digest, last[6], False)):
            if own is not None and theirs is not None:
                same = own.removeprefix("W/") == theirs.removeprefix("W/") if clean else own == theirs
                out.append(("resolved", last[0]) if same else ("mismatch", None))
                break
        else:
            out.append(("unverified", None))
    return out


#: (URL, its key)
URL_KEYS = [
    (None, None), ("", ""), ("dns:b.example", "dns:b.example"), ("/relative?x=1#y", "/relative?x=1#y"), ("http://", "http://"),
    ("http:///path", "http:///path"), ("//host/x", "//host/x"), ("http://user@", "http://user@"), ("urn:a:b%2fc", "urn:a:b%2fc"),
    ("HTTP://WWW.Example.com", "example.com"), ("http://example.com:80/", "example.com"), ("https://example.com:443/a", "example.com/a"),
    ("https://example.com:80/", "example.com:80"), ("http://example.com:443", "example.com:443"), ("http://example.com:/x", "example.com/x"),
    ("http://me:pw@www.example.com/x/", "example.com/x"), ("http://e.com/x/../y", "e.com/y"), ("http://e.com/./a/./b/.", "e.com/a/b"),
    ("http://e.com/../../a", "e.com/a"), ("http://e.com/a/b/..", "e.com/a"), ("http://e.com/a//b", "e.com/a//b"), ("http://e.com/..", "e.com"),
    ("http://e.com/%2f%7Ea%zz%", "e.com/%2F~a%zz%"), ("http://e.com/x/%2e%2E/y", "e.com/y"), ("http://e.com/%C3%a9", "e.com/%C3%A9"),
    ("http://e.com/a?b=2&a=%3d&&utm_x=1&ref=q#f", "e.com/a?a=%3D&b=2"), ("http://e.com?q=/../", "e.com?q=/../"), ("http://e.com#/x", "e.com"),
]


def test_url_keys(spark):
    """Also by the query's SQL, whose log is made of these URLs."""
    import duckdb

    from cloakframe.llm.queries import _WARC_SQL

    rows = [(i, u) for i, (u, _) in enumerate(URL_KEYS)]
    table = spark.createDataFrame(rows, "i int, url string")
    got = {r["i"]: r["k"] for r in table.select("i", revisits.canonical_url("url").alias("k")).collect()}
    assert got == {i: k for i, (_, k) in enumerate(URL_KEYS)}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, 'x')", rows)
    said = con.execute(f"SELECT record_id // 10, url_key FROM ({_WARC_SQL}) WHERE record_id % 10 = 0").fetchall()
    assert dict(said) == got


def test_odd_urls_resolve_to_themselves(spark):
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers array<string>"
    rows = [(1, "dns:a.example", 1, "response", '"x"', None, None, []), (2, "dns:b.example", 2, "revisit", '"x"', None, None, []),
            (3, "dns:a.example", 3, "revisit", '"x"', None, None, []), (4, "no scheme", 4, "revisit", '"x"', None, None, [])]
    got = {r["record_id"]: (r["status"], r["response_id"]) for r in revisits.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("response", 1), 2: ("orphan", None), 3: ("resolved", 1), 4: ("orphan", None)}


def test_revisits(spark):
    rng = random.Random(8)
    spellings = ["http://www.A.com/p/", "https://a.com:443/p#x", "http://a.com/p?utm_source=z", "http://a.com/p"]
    records, plain = [], []
    for i in range(400):
        hot = rng.random() < 0.6
        url = rng.choice(spellings) if hot else rng.choice([None, "http://b.org/?b=2&a=1", "https://b.org?a=1&b=2&ref=q"])
        key = "a.com/p" if hot else url and "b.org?a=1&b=2"
        kind = rng.choice(["response", "revisit", "revisit", "revisit", "metadata", None])
        ts = rng.choice([None, *range(60)])
        etag, date, digest = (rng.choice([None, *o]) for o in (['"1"', 'W/"1"', '"2"'], ["d1", "d2"], ["x", "y"]))
        records.append((i, url, ts, kind, etag, date, digest, None))
        plain.append((i, key, ts, kind, etag, date, digest))
    schema = "record_id long, url string, ts long, kind string, etag string, last_modified string, digest string, headers array<string>"
    table = spark.createDataFrame(records, schema)
    got = {r["record_id"]: (r["status"], r["response_id"]) for r in revisits.resolve_revisits(table).collect()}
    assert [got[i] for i in range(400)] == _resolve_plainly(plain)
    pair = spark.createDataFrame(
        [
            (1, "http://c.de/", 1, "response", '"e"', None, None, ["ETag: \"e\"", "Content-Type: text/html", "Date: old", None]),
            (2, "http://c.de", 2, "revisit", '"e"', None, None, ["date: new", "Content-Type: none", "Server: s"]),
        ],
        schema,
    )
    merged = {r["record_id"]: r["headers"] for r in revisits.resolve_revisits(pair).collect()}
    assert merged[2] == ["Content-Type: text/html", 'ETag: "e"', "date: new"]
    assert revisits.resolve_revisits(table.limit(0)).count() == 0


def test_language_model_losses(spark, docs, rows, none):
    marked = docs.withColumn("good", F.when(F.col("doc_id") % 2 == 0, True)).withColumn("chunk", F.lit(0))
    got = lm.cross_entropy_difference(marked, "good", ["doc_id", "chunk"], order=3, chunk_bytes=2000).collect()
    texts = [(r[1] or "").encode() for r in rows]
    want = corpus.byte_losses(texts, [r[0] is not None and r[0] % 2 == 0 for r in rows], 3)
    expected = sorted(((r[0] is None, r[0] or 0), len(t), *w) for r, t, w in zip(rows, texts, want))
    found = sorted(
        ((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"], r["target_loss"], r["background_loss"]) for r in got
    )
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert a[:2] == b[:2] and np.allclose(a[2:], b[2:], atol=1e-5)
    assert all(np.isclose(r["score"], r["target_loss"] - r["background_loss"]) for r in got)
    empty = none.withColumn("good", F.lit(True))
    assert lm.cross_entropy_difference(empty, "good", ["doc_id"]).count() == 0
