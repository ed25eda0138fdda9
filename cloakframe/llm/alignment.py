"""Alignment of the tokens of two tokenizers over the bytes of a text.

A is a byte-level BPE vocabulary, B a BPE with byte fallback that sets a space in
front of a text; both read a space and the text. The ends of a tokenizer's tokens,
as byte offsets, are the keys of a table of its places; the keys that
both tables hold, in order, cut both id lists into *groups*, and the tokens of
A and B that end at such a key are *linked*. Links are counted for each id pair over
all documents.

Neither vocabulary joins a space or a line end to what stands before it. A text is
therefore cut before every space or line end that stands alone between two
characters that are not white space: there both have an end, and each part has the
ids and groups it has in the text. Texts are taken in blocks of bounded size (or one
by one); the distinct parts of a block are aligned once, several in a line, and a
document is their concatenation, all by array operations. A text beyond a block takes
the memory of its ids.

The first pass writes one narrow row per document (digest, and its distinct linked
pairs with their numbers). The pairs are counted with map-side sums and go back to
the documents by a broadcast join if their table is below the bound of
``runtime.small_side``, else by a shuffled join, which adaptive execution splits at
the common pairs; the sums are folded inside the tasks that hold a document.

Defined results: a text that is null or empty, or whose tokens of A or of B do not
spell out the space and the text (B reads U+2581 as a space), has no tokens: zeros
and an empty digest. Repeated rows and null identifiers are rows of their own; an
empty table gives an empty result. Columns to keep that are named like a result
give way to it; their names may not start with an underscore.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakframe.llm.common import byte_slices, lean, materialize
from cloakframe.runtime import small_side

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at a time, and parts that are encoded as one line.
BLOCK_BYTES, LINE_PARTS = 3_000_000, 64
#: Bits of an id of B in a pair.
ID_BITS = 32
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_AT, _MARK = "\x01", "\u2581"
_SPACE, _NOTHING = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
_WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts, behind a space, that are cut one by one.
_ODD = rf"[{_WHITE}][{_WHITE}]|[{_WHITE}]\z|\x01"
#: Parts that a text may be cut around, on both sides.
_JOINS = rf"(?s)\A[ \n][^{_WHITE}](.*[^{_WHITE}])?\z"


def byte_alphabet() -> dict[str, int]:
    """Byte of each character by which byte-level vocabularies write it: printable
    Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_a(name: str = TOKENIZER_A):
    """Encoder of lines, the bytes of each id, and their number."""
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    made = Tokenizer.from_file(public_tokenizers.path(name))
    made.encode_special_tokens = True  # their strings are ordinary text
    alphabet = byte_alphabet()
    spelled: list[bytes] = [b""] * made.get_vocab_size()
    for token, i in made.get_vocab(with_added_tokens=False).items():
        spelled[i] = bytes(alphabet[c] for c in token)

    def encode(lines: list[str]) -> list[list[int]]:
        return [e.ids for e in made.encode_batch(lines, add_special_tokens=False)]

    return encode, spelled, np.array(list(map(len, spelled)))


def load_b(name: str = TOKENIZER_B):
    """Encoder of lines, the bytes of each id, and their number."""
    import public_tokenizers
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    spelled = []
    for i in range(made.vocab_size()):
        piece = made.id_to_piece(i)
        spelled.append(bytes([int(piece[3:-1], 16)]) if made.is_byte(i) else piece.replace(_MARK, " ").encode())

    def encode(lines: list[str]) -> list[list[int]]:
        # B sets a space before a text: it stands for that of a line, or goes again.
        coded = made.encode([s[1:] if s[0] == " " else s for s in lines], num_threads=1)
        return [ids if s[0] == " " else ids[1:] for s, ids in zip(lines, coded)]

    return encode, spelled, np.array(list(map(len, spelled)))


def cut(text: str) -> list[str]:
    """Parts of a space and the text; each begins with the space or line end that
    stands before it."""
    return _CUT.split(f" {text}")


def _cut_all(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The parts of ``texts``, the number of each text's, and the order of the texts:
    those without neighbouring white space come first and are cut by array operations."""
    spaced = pc.binary_join_element_wise(_SPACE, texts, _NOTHING)
    odd = pc.match_substring_regex(spaced, _ODD).to_numpy(zero_copy_only=False)
    even, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
    marked = texts.take(pa.array(even))
    for white in " ", "\n":
        marked = pc.replace_substring(marked, white, _AT + white)
    lists = pc.split_pattern(pc.binary_join_element_wise(_SPACE, marked, _NOTHING), _AT)
    by_hand = [cut(t) if t else [] for t in texts.take(pa.array(rest)).to_pylist()]
    parts = [lists.flatten(), pa.array(chain.from_iterable(by_hand), pa.large_string())]
    counts = np.concatenate([np.diff(lists.offsets.to_numpy()), np.fromiter(map(len, by_hand), np.int64, len(rest))])
    return pa.concat_arrays(parts), counts.astype(np.int64), np.concatenate([even, rest])


def _upto(counts: np.ndarray) -> np.ndarray:
    """Sums of all counts before each place, and of all."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _bytes(texts: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of large strings or binaries, one after the other, and their bounds."""
    _, places, data = texts.buffers()
    bounds = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = memoryview(data)[int(bounds[0]) : int(bounds[-1])] if data is not None else memoryview(b"")
    return whole, bounds - bounds[0]


class Alignment:
    """Groups of the tokens of parts, one part after the other.

    ``a`` and ``b`` hold the ids; a part has ``n_a`` and ``n_b`` of them, none if their
    bytes are not its own. Its groups end at the places ``cut_a`` in ``a`` and ``cut_b`` in
    ``b``, and are those from ``first`` of the part to that of the next one. Parts that a
    text may be cut around are encoded several in a line.
    """

    def __init__(self, parts: list[str] | pa.Array, a_side: tuple, b_side: tuple):
        parts = pa.array(parts, pa.large_string()) if isinstance(parts, list) else parts
        alone = ~pc.match_substring_regex(parts, _JOINS).to_numpy(zero_copy_only=False)
        alone |= pc.match_substring(parts, _MARK).to_numpy(zero_copy_only=False)
        self._encode(parts, alone, a_side, b_side)
        if self.again.any():  # a line that is not as its parts are
            self._encode(parts, alone | self.again, a_side, b_side)
        self.sizes = tuple(len(side[1]) for side in (a_side, b_side))
        # What stands before a part has the same length by A and by B.
        on_a, on_b = (np.zeros(self.ends[-1] + 1, bool) for _ in "ab")
        on_a[self.ends_a], on_b[self.ends_b] = True, True
        self.cut_a, self.cut_b = np.flatnonzero(on_b[self.ends_a]) + 1, np.flatnonzero(on_a[self.ends_b]) + 1
        self.n_a, self.n_b = (np.diff(np.searchsorted(e, self.ends, "right"), prepend=0) for e in (self.ends_a, self.ends_b))
        self.first = np.concatenate([[0], np.searchsorted(self.ends_a[self.cut_a - 1], self.ends, "right")])

    def _encode(self, parts: pa.Array, alone: np.ndarray, a_side: tuple, b_side: tuple) -> None:
        """The ids and their ends in bytes, and the parts' ends; ``again``: parts of lines
        whose ids are not those of the parts."""
        data, bounds = _bytes(parts)
        n, lonely = len(parts), np.flatnonzero(alone)
        starts = np.unique(np.concatenate([np.arange(0, n, LINE_PARTS), lonely, lonely + 1, [n]]))
        places = bounds[starts]
        lines = [str(data[i:j], "utf-8") for i, j in zip(places.tolist(), places[1:].tolist())]
        sound, coded = np.ones(len(lines), bool), []
        for encode, spelled, sizes in (a_side, b_side):
            found = encode(lines)
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))
            said, _ = _bytes(pa.array(spelled, pa.large_binary()).take(pa.array(ids)))
            ends = _upto(sizes[ids])
            stops = ends[_upto(counts)]
            same = [said[i:j] == data[k:m] for i, j, k, m in zip(stops.tolist(), stops[1:].tolist(), places.tolist(), places[1:].tolist())]
            sound &= np.array(same, bool)
            coded.append((ids, counts, ends[1:] - np.repeat(stops[:-1] - places[:-1], counts)))
        line = np.repeat(np.arange(len(lines)), np.diff(starts))
        several = np.diff(starts) > 1
        on = [np.zeros(bounds[-1] + 1, bool) for _ in "ab"]
        for there, (_, counts, ends) in zip(on, coded):
            there[ends[np.repeat(sound, counts)]] = True
        split = np.bincount(line, ~(on[0] & on[1])[bounds[1:]], len(lines)) > 0
        self.again = (several & split)[line]
        self.sound = sound[line].tolist()
        # Unsound parts have no tokens and no length.
        self.ends = np.cumsum(np.where(sound[line], np.diff(bounds), 0))
        (self.a, self.ends_a), (self.b, self.ends_b) = (
            (ids[kept], np.cumsum(sizes[ids[kept]]))
            for (ids, counts, _), (_, _, sizes) in zip(coded, (a_side, b_side))
            for kept in [np.repeat(sound, counts)]
        )

    def groups(self, part: int) -> list[tuple[list[int], list[int]]]:
        """(ids of A, ids of B) of each group of a part."""
        i, k = (c[self.first[part] - 1] if self.first[part] else 0 for c in (self.cut_a, self.cut_b))
        out = []
        for g in range(self.first[part], self.first[part + 1]):
            out.append((self.a[i : self.cut_a[g]].tolist(), self.b[k : self.cut_b[g]].tolist()))
            i, k = self.cut_a[g], self.cut_b[g]
        return out

    def said(self) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3;`` of each part: the ids of each group in order."""
        n_a, n_b = len(self.a), len(self.b)
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[self.cut_a - 1], last_b[self.cut_b - 1] = 1, 1
        # The ids of a group of A come before those of B: each goes behind all of the other side before it.
        at_a = np.arange(n_a) + np.concatenate([[0], self.cut_b])[np.cumsum(last_a) - last_a]
        at_b = np.arange(n_b) + np.concatenate([self.cut_a, [n_a]])[np.cumsum(last_b) - last_b]
        codes = np.empty(n_a + n_b, np.int64)
        codes[at_a], codes[at_b] = 2 * self.a + last_a, 2 * (self.sizes[0] + self.b) + last_b
        data, bounds = _bytes(_forms(*self.sizes).take(pa.array(codes)))
        ends = _upto(self.n_a + self.n_b)
        return pa.Array.from_buffers(pa.large_string(), len(self.n_a), [None, pa.py_buffer(bounds[ends]), pa.py_buffer(data)])

    def rendered(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each part."""
        return [s[:-1] for s in self.said().to_pylist()]

    def pairs(self) -> np.ndarray:
        """The linked pairs: one for each group, its last ids."""
        return self.a[self.cut_a - 1] << ID_BITS | self.b[self.cut_b - 1]

    def links(self) -> list[list[int]]:
        """The linked pairs of each part."""
        pairs = self.pairs().tolist()
        return [pairs[i:j] for i, j in zip(self.first, self.first[1:])]


@lru_cache(maxsize=1)
def _forms(n_a: int, n_b: int) -> pa.Array:
    """How ids are written: of A inside a group and last of its side, then those of B."""
    each = chain((f"{i}{mark}" for i in range(n_a) for mark in ",|"), (f"{i}{mark}" for i in range(n_b) for mark in ",;"))
    return pa.array(each, pa.large_string())


def digests(texts: pa.Array, sides: tuple[tuple, tuple]) -> tuple[list[pa.Array], np.ndarray]:
    """(n_a, n_b, n_links, digest, distinct pairs, their numbers) of the texts, as columns,
    and the order of the texts in them. Distinct parts of all of them are aligned once."""
    parts, counts, order = _cut_all(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = parts.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    made = Alignment(coded.dictionary, *sides)
    del parts, coded
    # A text with a part that is not sound has no tokens.
    unsound = _upto(~np.array(made.sound, bool)[codes])[_upto(counts)]
    sound = np.diff(unsound) == 0
    codes, counts = codes[np.repeat(sound, counts)], np.where(sound, counts, 0)
    bounds = _upto(counts)
    linked = np.diff(made.first)
    n_a, n_b, n_links = (np.diff(_upto(n[codes])[bounds]) for n in (made.n_a, made.n_b, linked))
    data, places = _bytes(made.said().take(pa.array(codes)))
    spans = places[bounds].tolist()
    lines = [hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(spans, spans[1:])]
    del data, places
    # The links of the parts of each text, one after the other, then sorted and counted.
    pairs, numbers = np.unique(made.pairs(), return_inverse=True)
    each = linked[codes]
    at = np.repeat(made.first[codes] - _upto(each)[:-1], each) + np.arange(int(each.sum()))
    keys = np.repeat(np.arange(len(counts)), n_links) * max(1, len(pairs)) + numbers[at]
    keys, times = np.unique(keys, return_counts=True)
    stops = np.searchsorted(keys, np.arange(len(counts) + 1) * max(1, len(pairs))).astype(np.int32)
    found = pairs[keys % max(1, len(pairs))]
    columns = [pa.array(c, pa.int64()) for c in (n_a, n_b, n_links)] + [pa.array(lines, pa.string())]
    columns += [pa.ListArray.from_arrays(pa.array(stops), pa.array(c, pa.int64())) for c in (found, times)]
    return columns, order


def _aligned_rows(docs: DataFrame, text_col: str, keep: list[str], name_a: str, name_b: str) -> DataFrame:
    rows = docs.select(F.col(text_col).alias("_text"), *keep).withColumn("_row", F.monotonically_increasing_id())
    kept = [*keep, "_row"]
    made = ["n_a", "n_b", "n_links", "groups_sha256", "_pairs", "_times"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = (load_a(name_a), load_b(name_b))
        for batch in byte_slices(batches, 0, BLOCK_BYTES):
            columns, order = digests(batch.column(0), sides)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(order)).columns[1:], *columns], [*kept, *made])

    long = T.LongType()
    kinds = [long, long, long, T.StringType(), T.ArrayType(long), T.ArrayType(long)]
    fields = [*rows.schema[1:], *(T.StructField(n, k) for n, k in zip(made, kinds))]
    return rows.mapInArrow(lean(apply), T.StructType(fields))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair in all documents, and whether no
    other pair with the same id of B has more. One row per pair of ids."""
    each = aligned.select(F.explode(F.arrays_zip(F.col("_pairs").alias("pair"), F.col("_times").alias("n"))).alias("e"))
    counts = each.groupBy(F.col("e.pair").alias("pair")).agg(F.sum("e.n").alias("count"))
    counts = materialize(counts.withColumn("id_b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1)), "pair-counts")
    most = counts.groupBy("id_b").agg(F.max("count").alias("most"))
    joined = counts.join(most, "id_b")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_documents(
    docs: DataFrame,
    keep: list[str],
    text_col: str = "text",
    name_a: str = TOKENIZER_A,
    name_b: str = TOKENIZER_B,
) -> DataFrame:
    """The ``keep`` columns and, for each document, the numbers of its tokens, groups
    and links, of links whose pair is the best of its id of B, the sum of the links'
    counts, and the SHA-256 of the groups (see the module)."""
    keep = [c for c in keep if c not in RESULTS]
    aligned = materialize(_aligned_rows(docs, text_col, keep, name_a, name_b), "aligned")
    counts = materialize(link_counts(aligned), "links")
    each = aligned.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("_e"))
    each = each.select("_row", F.col("_e._pairs").alias("pair"), F.col("_e._times").alias("n"))
    times = F.col("n")
    scored = (
        each.join(small_side(counts, counts.count(), 64), "pair")
        .groupBy("_row")
        .agg(
            F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"),
            F.sum(times * F.col("count")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return aligned.join(scored, "_row", "left").select(
        *keep,
        "n_a",
        "n_b",
        F.col("n_links").alias("n_groups"),
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        "groups_sha256",
    )
