"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits; a bit is 1 if more than half of the hashes of
its word shingles have it. Two fingerprints link when they differ in at most two
bits. Every distinct fingerprint emits the 65 values within half that radius (one
bit); two that link meet at a value both emit. The members of a meeting value are
at most 65 distinct fingerprints, all within two bits of each other; each is
linked to the smallest of them, which the value's rows verify. Links between all
pairs need not be listed: the stars have the same components.

Copies never meet as rows: they share a fingerprint, and only distinct
fingerprints are shuffled, whatever the size of a group of copies.

Defined results: null and empty texts have fingerprint 0 and link like any other;
a null identifier takes part and never names a component that has another;
repeated rows stay repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import distinct_texts, lean, materialize, slices, text_key
from cloakframe.llm.components import components
from cloakframe.runtime import discard

SEED = 42
_digest = partial(xxhash.xxh64_digest, seed=SEED)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit fingerprint of a text as a signed integer.

    A-Z are lowered; words are runs without ASCII white space; shingles are
    ``width`` words joined by a space, repeats included (all words if fewer).
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        spans = [(0, len(line))]
    else:
        starts = np.concatenate([[0], ends[: len(words) - width] + 1])
        spans = zip(starts.tolist(), ends[width - 1 :].tolist())
    hashes = np.frombuffer(b"".join([_digest(line[a:b]) for a, b in spans]), np.uint8).reshape(-1, 8)
    counts = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 3) -> DataFrame:
    """``docs`` without the text, with ``fingerprint`` (long)."""
    names = [c for c in docs.columns if c not in (text_col, "fingerprint")]
    kept = docs.select(F.col(text_col).alias("_text"), *names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            made = [fingerprint(t, width) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(made, pa.int64())], [*names, "fingerprint"]
            )

    return kept.mapInArrow(
        lean(apply), T.StructType([*kept.schema[1:], T.StructField("fingerprint", T.LongType())])
    )


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints at most two bits apart.

    ``prints(fingerprint)`` has no repeats. The links' components are those of all
    pairs within two bits.
    """
    own = F.col("fingerprint")
    near = [own] + [own.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)]
    met = prints.select(own, F.explode(F.array(*near)).alias("variant"))
    met = met.withColumn("least", F.min("fingerprint").over(Window.partitionBy("variant")))
    apart = F.bit_count(own.bitwiseXOR(F.col("least")))
    return met.where((own != F.col("least")) & (apart <= 2)).select(own.alias("u"), F.col("least").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fingerprint long, component_id): component_id is the smallest id reachable."""
    prints = materialize(fingerprints(docs.select(id_col, text_col), text_col, width), "fingerprints")
    distinct = prints.groupBy("fingerprint").agg(F.min(id_col).alias("first_id"))
    distinct = materialize(distinct, "distinct-fingerprints")
    roots = materialize(components(ball_links(distinct.select("fingerprint"))), "roots")
    named = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    # Written, so that a class of very many fingerprints can be split in the join.
    heads = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "heads")
    classes = named.join(heads, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(id_col, "fingerprint", "component_id")


# ------------------------------- near copies by fingerprint and by similarity

#: Texts of which about one in so many is counted, to tell common shingles from rare ones.
COUNTED_ONE_IN = 16
#: Counted texts that make a shingle common; cells per common shingle of the table that
#: tells them, as bits, and the most bits it has (64 MiB).
COMMON_FROM, SPARE_BITS, TABLE_BITS = 3, 3, 26
#: Cells of the table that one row brings to the driver.
BLOCK_BITS = 16


def shingle_set(text: str, width: int) -> frozenset[int]:
    """Hashes of the text's distinct shingles (all words, if fewer than ``width``)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(
        xxhash.xxh3_64_intdigest(b" ".join(words[i : i + width]))
        for i in range(max(1, len(words) - width + 1))
    )


def _signed(hashes: frozenset[int]) -> np.ndarray:
    return np.fromiter(hashes, np.uint64, len(hashes)).view(np.int64)


def _counted_rows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 64):
        for text in part.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(_signed(shingle_set(text, width)))], ["shingle"])


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """How common shingles are, by the leading bits of their hash: the bits of the
    largest count among the counted texts' shingles of a cell, 0 for rare ones.

    They only set the order in which a text's shingles are looked at (see
    ``near_copy_classes``); any order gives the same classes, so it does no harm if a
    rare shingle shares the cell of a common one. The table has a bounded size,
    whatever the number of common shingles, and is filled in the tasks, in blocks.
    """
    some = texts.where(F.pmod(F.xxhash64("key"), F.lit(COUNTED_ONE_IN)) == 0).select("text")
    rows = some.mapInArrow(lean(lambda batches: _counted_rows(batches, width)), "shingle long")
    counts = rows.groupBy("shingle").count().where(F.col("count") >= COMMON_FROM)
    counts = materialize(counts, "common-shingles")
    many = counts.count()
    if not many:
        return np.zeros(0, np.uint8)
    bits = min(TABLE_BITS, max(BLOCK_BITS, many.bit_length() + SPARE_BITS))
    cell = F.shiftrightunsigned("shingle", 64 - bits)
    cells = counts.select(
        F.shiftright(cell, BLOCK_BITS).cast("int").alias("block"),
        cell.bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("place"),
        F.length(F.bin("count")).alias("level"),
    )

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        levels = np.zeros(1 << BLOCK_BITS, np.uint8)
        np.maximum.at(levels, group["place"].to_numpy(), group["level"].to_numpy().astype(np.uint8))
        return pd.DataFrame({"block": group["block"].iloc[:1], "levels": [levels.tobytes()]})

    cells = cells.groupBy("block", "place").agg(F.max("level").alias("level"))
    table = np.zeros(1 << bits, np.uint8)
    for block, levels in cells.groupBy("block").applyInPandas(fill, "block int, levels binary").toLocalIterator():
        table[block << BLOCK_BITS : (block + 1) << BLOCK_BITS] = np.frombuffer(levels, np.uint8)
    discard(counts)
    return table


def rarest_first(text: str, width: int, common: np.ndarray) -> np.ndarray:
    """The text's shingles in one order for all texts: by how common, then by value."""
    own = np.sort(_signed(shingle_set(text, width)))
    if not len(common):
        return own
    cells = own.view(np.uint64) >> np.uint64(65 - len(common).bit_length())
    return own[np.argsort(common[cells], kind="stable")]


def _prefix_rows(
    batches: Iterator[pa.RecordBatch], width: int, least: float, common: np.ndarray
) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 64):
        keys, shingles, sizes, rests = [], [], [], []
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            own = rarest_first(text, width, common)
            n = len(own)
            head = n - math.ceil(least * n - 1e-6) + 1
            keys += [key] * head
            shingles.append(own[:head])
            sizes.append(np.full(head, n, np.int32))
            rests.append(n - np.arange(head, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary())] + [pa.array(np.concatenate(c)) for c in (shingles, sizes, rests)],
            ["key", "shingle", "size", "rest"],
        )


def _verify(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, frozenset[int]] = {}
    for part in slices(batches, 64):
        us, vs = [], []
        for u, v, left, right in zip(*(c.to_pylist() for c in part.columns)):
            a = shingle_set(left, width)
            if v not in held:
                held.clear()  # pairs come sorted by v: its set is used again and again
                held[v] = shingle_set(right, width)
            b = held[v]
            if len(a & b) >= least * len(a | b):
                us.append(u)
                vs.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"]
        )


def fingerprint_pairs(texts: DataFrame, width: int = 3) -> DataFrame:
    """Distinct (u, v), u > v, of keys of ``texts(key, text)`` whose fingerprints link.

    The links of :func:`ball_links`, each between one text of either fingerprint, and
    of every text with that of its own fingerprint.
    """
    prints = materialize(fingerprints(texts.select("key", "text"), "text", width), "text-fingerprints")
    firsts = materialize(prints.groupBy("fingerprint").agg(F.min("key").alias("first")), "first-texts")
    same = prints.join(firsts, "fingerprint").where(F.col("key") != F.col("first"))
    one = firsts.select(F.col("fingerprint").alias("u"), F.col("first").alias("a"))
    other = firsts.select(F.col("fingerprint").alias("v"), F.col("first").alias("b"))
    near = ball_links(firsts.select("fingerprint")).distinct().join(one, "u").join(other, "v").select("a", "b")
    both = same.select(F.col("key").alias("a"), F.col("first").alias("b")).union(near)
    made = both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    made = materialize(made, "fingerprint-pairs")
    discard(prints, firsts)
    return made


def _alike(tried: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (u, v) of ``tried`` that are near copies, written."""
    # The texts in question, apart from their buckets: a text that very many are held
    # against can then be split in the join.
    needed = tried.select(F.col("u").alias("key")).union(tried.select("v")).distinct()
    some = materialize(texts.select("key", "text").join(needed, "key"), "candidate-texts")
    left = some.select(F.col("key").alias("u"), F.col("text").alias("left"))
    right = some.select(F.col("key").alias("v"), F.col("text").alias("right"))
    both = tried.join(left, "u").join(right, "v").select("u", "v", "left", "right").sortWithinPartitions("v")
    links = both.mapInArrow(lean(lambda batches: _verify(batches, width, least)), "u binary, v binary")
    links = materialize(links, "near-copies")
    discard(some)
    return links


def _may_be_alike(a: str, b: str, least: float) -> Column:
    """Whether two texts that share a shingle can reach ``least``.

    Their sizes must allow it, and if this is the first shingle they share, so must
    what either has from there on.
    """
    sizes = F.least(f"{a}.size", f"{b}.size") >= least * F.greatest(f"{a}.size", f"{b}.size") - 1e-6
    needed = least / (1 + least) * (F.col(f"{a}.size") + F.col(f"{b}.size"))
    return sizes & (F.least(f"{a}.rest", f"{b}.rest") >= needed - 1e-6)


def near_copy_classes(texts: DataFrame, width: int = 5, min_similarity: float = 0.8) -> DataFrame:
    """(key, root) for the texts that have near copies; root: one key of the class.

    ``texts(key, text)`` has one row per distinct text. Two texts are near copies
    if the Jaccard similarity of their sets of ``width``-word shingles is
    ``min_similarity`` or more; a class holds what such links connect.

    Candidates are first the texts whose fingerprints link (three-word shingles, two
    bits); every such pair is verified on the whole texts, and what it links starts the
    classes. One 64-bit fingerprint finds mostly the closest pairs, so an exact prefix
    filter follows, which finds all others: all shingles have one order, rare ones first, and two texts of that similarity share one among
    the first 1 - ``min_similarity`` of each, with enough left in both from the
    first one that they share. Every link is verified on the whole texts.

    Links between all pairs need not be listed. First each text is held against one
    text of each of its shared shingles, that which has most left from there on;
    what this links is a class. Then all pairs of different classes that share a
    shingle and may be alike are tried, so no link between classes is missed. A
    large group of near copies costs a link per text; pairs are listed one by one
    only where they share a rare shingle and are in different classes so far.
    """
    least = min_similarity
    printed = fingerprint_pairs(texts)
    found = _alike(printed, texts, width, least)

    shared_levels = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, width))
    heads = texts.select("key", "text").mapInArrow(
        lean(lambda batches: _prefix_rows(batches, width, least, shared_levels.value)),
        "key binary, shingle long, size int, rest int",
    )
    heads = materialize(heads, "prefixes")
    shared_levels.destroy()
    shared = heads.groupBy("shingle").count().where("count > 1").select("shingle")
    shared = materialize(heads.join(materialize(shared, "shared-shingles"), "shingle"), "shared-prefixes")
    discard(heads)

    # the centre of a shingle's star; min, as the one with most left is first
    centre = F.min(F.struct((F.col("size") - F.col("rest")).alias("at"), "key", "size", "rest")).alias("c")
    centres = materialize(shared.groupBy("shingle").agg(centre).select("shingle", "c.*"), "centres")
    star = shared.alias("a").join(centres.alias("b"), "shingle")
    star = star.where((F.col("a.key") != F.col("b.key")) & _may_be_alike("a", "b", least))
    tried = materialize(_pairs(star).join(printed, ["u", "v"], "left_anti"), "candidate-pairs")
    links = found.union(_alike(tried, texts, width, least))

    roots = materialize(components(links), "star-roots").withColumnRenamed("node", "key")
    placed = shared.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = materialize(placed, "placed")
    # what the texts of a class may reach at most, to rule pairs of classes out
    parts = placed.groupBy("shingle", "root").agg(
        F.min("size").alias("low"), F.max("size").alias("high"), F.max("rest").alias("rest")
    )
    parts = materialize(parts, "shingle-classes")
    a, b = parts.alias("a"), parts.alias("b")
    possible = (
        (F.col("a.root") < F.col("b.root"))
        & (F.col("a.high") >= least * F.col("b.low") - 1e-6)
        & (F.col("b.high") >= least * F.col("a.low") - 1e-6)
        & (F.least("a.rest", "b.rest") >= least / (1 + least) * (F.col("a.low") + F.col("b.low")) - 1e-6)
    )
    between = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & possible).select(
        "a.shingle", F.col("a.root").alias("left_root"), F.col("b.root").alias("right_root")
    )
    between = materialize(between, "class-pairs")
    one = between.alias("p").join(
        placed.alias("a"), (F.col("p.shingle") == F.col("a.shingle")) & (F.col("left_root") == F.col("a.root"))
    )
    both = one.join(
        placed.alias("b"), (F.col("p.shingle") == F.col("b.shingle")) & (F.col("right_root") == F.col("b.root"))
    ).where(_may_be_alike("a", "b", least))
    rest = materialize(_pairs(both).join(tried.union(printed), ["u", "v"], "left_anti"), "remaining-pairs")
    links = links.union(_alike(rest, texts, width, least))
    for done in (printed, shared, centres, tried, placed, parts, between, rest):
        discard(done)
    return components(links).select(F.col("node").alias("key"), "root")


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct (u, v), u > v, of the rows' keys a.key and b.key."""
    return met.select(F.greatest("a.key", "b.key").alias("u"), F.least("a.key", "b.key").alias("v")).distinct()


def first_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **near) -> DataFrame:
    """``docs`` with one row of each class of near copies: the one with the smallest id.

    Null texts are empty; all empty texts are one class. A null identifier comes
    last; among equal ones any one row stays. All columns are kept.
    """
    rows = materialize(
        docs.withColumn("_key", text_key(text_col)).withColumn("_row", F.monotonically_increasing_id()), "keyed"
    )
    texts = distinct_texts(rows, text_col)
    classes = materialize(near_copy_classes(texts, **near), "copy-classes")
    discard(texts)
    placed = rows.select("_key", "_row", F.col(id_col).alias("_id")).join(
        classes.withColumnRenamed("key", "_key"), "_key", "left"
    )
    # nulls last: a struct with the null flag first
    order = F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_row").alias("c"))
    heads = placed.groupBy(F.coalesce("root", "_key").alias("root")).agg(F.min(order).alias("head"))
    kept = heads.select(F.col("head.c").alias("_row"))
    return rows.join(kept, "_row").select(*docs.columns)
