"""Benchmark decontamination by spaced-seed hashing.

A mask reads some of the next ``span`` tokens and ignores the others. The tokens
that a mask reads, from every place of every test item and of every document, are
hashed; equal hashes of the same mask are hits. A substitution at an ignored place
does not hinder a hit, and the masks ignore different places. Around a hit the
document and the item are held side by side on that diagonal, and the stretch
around the hit with the best balance of equal and unequal tokens is measured: it
counts if it has ``min_tokens`` tokens of which ``min_share`` are equal. An item
with fewer than ``min_tokens`` tokens must be matched from its first token to its
last, with the same share; it has masks of its own length, that read some of the
parts it is cut into (``masks_for``).

No overlap with these settings is missed (``min_tokens`` 13, ``min_share`` 0.8). A
stretch of 26 or more tokens with the share has a half with the share, and for 13
to 25 tokens the tests try all places of the substitutions; so they do for shorter
items. With a smaller share or fewer tokens, hits are no longer sure.

Test items are taken in blocks of bounded size (``block_bytes`` of tokens), one
pass over the documents per block; a block is what is broadcast. In a pass, a
document's hashes are looked up in the block's sorted hashes where the document
is, so documents are not shuffled and a passage that a third of all documents hold
lands in no single task. Only (document, item) rows come out.

Tokens are runs of letters and digits, lowered; others separate them.

Defined results: null and empty texts and items match nothing; equal items give
one row each; repeated documents give one row each time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import lean, slices

#: Places that each mask reads (1: read, 0: ignored). Fixed values, searched so that 13
#: to 25 tokens still give a hit with any fifth of them substituted.
MASKS = ("10101111", "1110110001", "101011101", "1010001111", "1110001011")
#: Tokens of an item from which on these masks are used.
WHOLE_FROM = 13
#: Tokens of test items in a block, as bytes of their 64-bit codes.
BLOCK_BYTES = 2 << 20
CACHE_WORDS = 300_000
_WORD = re.compile(r"[^\W_]+")
_MULTIPLY, _ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Codes(dict):
    """Word -> code, worked out once."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_codes = _Codes()


def token_codes(text: str | None) -> np.ndarray:
    """A 64-bit code per token of the text."""
    if len(_codes) > CACHE_WORDS:
        _codes.clear()
    words = _WORD.findall((text or "").lower())
    return np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))


def seed_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of what the mask reads from each place on."""
    n = len(codes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask) << 16 | int(mask, 2), np.uint64)
    for i, read in enumerate(mask):
        if read == "1":
            out = (out ^ codes[i : i + n]) * _MULTIPLY
            out ^= out >> np.uint64(31)
            out += _ADD
    return out


class Block:
    """Some test items, their seed hashes in order, and where these come from."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        hashes, owners, places = [], [], []
        for i, (_, codes) in enumerate(items):
            for mask in masks_for(len(codes)):
                found = seed_hashes(codes, mask)
                hashes.append(found)
                owners.append(np.full(len(found), i, np.int32))
                places.append(np.arange(len(found), dtype=np.int32))
        joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.hashes = joined[order]
        self.owners = (np.concatenate(owners) if owners else np.zeros(0, np.int32))[order]
        self.places = (np.concatenate(places) if places else np.zeros(0, np.int32))[order]
        #: The masks in use: one per shorter item length, and the fixed ones.
        self.masks = sorted({m for _, codes in items for m in masks_for(len(codes))})
        # One bit per hash class: most places of a document end here.
        self.bits = min(24, max(10, int(np.ceil(np.log2(max(1, len(joined))))) + 5))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hashes >> np.uint64(64 - self.bits)] = True

    def hits(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, diagonal, place) of each hit of a document, once per item and diagonal."""
        known: set[tuple[int, int]] = set()
        for mask in self.masks:
            found = seed_hashes(codes, mask)
            at = np.flatnonzero(self.seen[found >> np.uint64(64 - self.bits)])
            if not len(at):
                continue
            low = np.searchsorted(self.hashes, found[at], "left")
            high = np.searchsorted(self.hashes, found[at], "right")
            hit = low < high
            for place, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
                for j in range(a, b):
                    item, diagonal = int(self.owners[j]), place - int(self.places[j])
                    # a stretch that was measured on this diagonal covers its other hits
                    if (item, diagonal) not in known:
                        known.add((item, diagonal))
                        yield item, diagonal, place


def masks_for(n: int) -> tuple[str, ...]:
    """The fixed masks, or for a shorter item masks of its length.

    A fifth of its tokens may differ: none below 5, one below 10, else two. Cut into
    three (four) parts, at least two stay whole, and there is a mask for each two.
    """
    if n >= WHOLE_FROM:
        return MASKS
    parts = (1, 3, 4)[n // 5]
    cuts = [n * i // parts for i in range(parts + 1)]
    read = combinations(range(parts), min(2, parts))
    spelled = ("".join("01"[i in two] * (cuts[i + 1] - cuts[i]) for i in range(parts)) for two in read)
    return tuple(dict.fromkeys(spelled)) if n else ()


def best_stretch(equal: np.ndarray, min_share: float) -> tuple[int, int, int]:
    """(start, length, equal tokens) of the stretch with the best balance.

    An equal token counts 1 - min_share, an unequal one -min_share, so a stretch
    with a balance of 0 or more has the share. The longest such stretch is found
    from the running balance.
    """
    balance = np.concatenate([[0.0], np.cumsum(np.where(equal, 1.0 - min_share, -min_share))])
    least = np.minimum.accumulate(balance)
    best = (0, 0)
    # for each end, the first start whose balance is no higher
    starts = np.searchsorted(-least, -balance - 1e-9, "left")
    lengths = np.arange(len(balance)) - starts
    end = int(np.argmax(lengths))
    if lengths[end] > 0:
        best = (int(starts[end]), int(lengths[end]))
    return best[0], best[1], int(np.count_nonzero(equal[best[0] : best[0] + best[1]]))


def overlaps(
    codes: np.ndarray, block: Block, min_tokens: int, min_share: float
) -> dict[int, tuple[int, int, int]]:
    """Per item number: (document token, length, equal tokens) of its longest overlap."""
    found: dict[int, tuple[int, int, int]] = {}
    for item, diagonal, _ in block.hits(codes):
        own = block.items[item][1]
        a, b = max(0, diagonal), min(len(codes), diagonal + len(own))
        equal = codes[a:b] == own[a - diagonal : b - diagonal]
        start, length, same = best_stretch(equal, min_share)
        if length >= min(min_tokens, len(own)) and length > found.get(item, (0, 0, 0))[1]:
            found[item] = (a + start, length, same)
    return found


def item_blocks(
    items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES
) -> Iterator[Block]:
    """The test items in blocks of bounded size, fetched one after another."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for row in items.select(id_col, text_col).toLocalIterator():
        codes = token_codes(row[1])
        if not len(codes):
            continue
        if held and size + 8 * len(codes) > block_bytes:
            yield Block(held)
            held, size = [], 0
        held.append((row[0], codes))
        size += 8 * len(codes)
    if held:
        yield Block(held)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_tokens: int = 13,
    min_share: float = 0.8,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(keep columns, item_id, token_start, n_tokens, n_equal) per document and item it overlaps."""
    if len(set(keep) & {"item_id", "token_start", "n_tokens", "n_equal"}):
        raise ValueError("rename the columns to keep that have a result's name")
    spark = docs.sparkSession
    kept = docs.select(F.col(text_col).alias("_text"), *keep)
    id_type = items.schema[item_id_col].dataType
    schema = T.StructType(
        [*kept.schema[1:], T.StructField("item_id", id_type)]
        + [T.StructField(n, T.IntegerType()) for n in ("token_start", "n_tokens", "n_equal")]
    )
    arrow_id = pa.int64() if isinstance(id_type, (T.LongType, T.IntegerType)) else pa.string()
    if not isinstance(id_type, (T.LongType, T.StringType)):
        raise TypeError("item identifiers are long or string")

    def one_pass(block: Block) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for part in slices(batches, 512):
                rows: list[int] = []
                cols: list[list] = [[], [], [], []]
                for i, text in enumerate(part.column(0).to_pylist()):
                    for item, values in overlaps(token_codes(text), own, min_tokens, min_share).items():
                        rows.append(i)
                        for col, value in zip(cols, (own.items[item][0], *values)):
                            col.append(value)
                taken = part.take(pa.array(rows, pa.int64())).columns[1:]
                kinds = [arrow_id, pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [*taken, *(pa.array(c, t) for c, t in zip(cols, kinds))], schema.names
                )
            _codes.clear()  # the worker goes on, with other work

        return kept.mapInArrow(lean(apply), schema)

    passes = [one_pass(block) for block in item_blocks(items, item_id_col, item_text_col, block_bytes)]
    out = spark.createDataFrame([], schema)
    for one in passes:
        out = out.union(one)
    return out


def with_item_count(
    docs: DataFrame,
    items: DataFrame,
    name: str,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    min_tokens: int = 13,
    min_share: float = 0.8,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a column ``name``: the number of test items that the text overlaps."""
    spark = docs.sparkSession
    out = docs.withColumn(name, F.lit(0))
    text_at, count_at = docs.columns.index(text_col), len(docs.columns)

    def one_pass(df: DataFrame, block: Block) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for part in slices(batches, 512):
                texts, before = part.column(text_at).to_pylist(), part.column(count_at).to_pylist()
                now = [
                    n + len(overlaps(token_codes(t), own, min_tokens, min_share))
                    for n, t in zip(before, texts)
                ]
                columns = [*part.columns[:count_at], pa.array(now, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)
            _codes.clear()

        return df.mapInArrow(lean(apply), df.schema)

    for block in item_blocks(items, item_id_col, item_text_col, block_bytes):
        out = one_pass(out, block)
    return out
