"""Collocations: phrases that occur more often than their parts let expect.

Texts are lower-cased (A-Z), split into pieces and these into words. Words that occur
``min_count`` times in their language get ids; every other word ends a phrase, as
no phrase with it can reach the count. The texts become one written table of ids,
and each length of phrase is a pass over it:

* a task counts the n-grams of its part in *counting quotient filters* (``quotient``):
  exact, sorted, a few bytes per key; a full filter is sent off, a slot at a time;
* the filters of a slot, from all shards, are merged where the slot lies; n-grams
  below ``min_count`` go;
* n-grams from three words on are counted only where both (n-1)-grams in them may
  be frequent, told by a broadcast bit table of bounded size, addressed by the top
  bits of the permuted key. A false hit costs work, never a result.

Ids are spread over slots by the permutation, so no common word gathers in one task;
a slot holds at most one key per shard and key. Scores come from joins of frequent
phrases with each other; the best of a language are the only window, over rows that
each task has cut to the number wanted.

The words' ids are broadcast as a dictionary if they take at most ``max_bytes``;
otherwise the distinct words of each text are joined with the ids by a shuffle.

Defined results: a null text is empty, a null language ``und``; equal rows count each;
ties are ordered by the score, the count, then the phrase's bytes; no words give no
phrases. Only the language and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm import quotient
from cloakframe.llm.common import materialize, pieces, slices, whole, workers
from cloakframe.llm.quotient import Shape
from cloakframe.runtime import discard, small_side

MAX_WORDS = 5
#: What ends a piece, as one mark; what parts words, as a space.
_MARK = b"."
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
#: Bytes of text that are split at a time; words a task counts, keys a filter holds.
STEP, WORDS, KEYS = 1 << 20, 300_000, 1_000_000
#: Bytes of a dictionary that is broadcast, and of one of its words besides its text.
MAX_BYTES, WORD_BYTES = 64 << 20, 150
#: Occurrences for each slot; bits of the table of frequent n-grams, at most, and per n-gram.
SLOT_ENTRIES, TABLE_BITS, BITS_PER_KEY = 4_000_000, 27, 16
#: Bits of one row of Spark's bitmap aggregate.
_BITMAP = 1 << 15
BREAK = -1


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, and a mark between pieces, a step of the text at a time."""
    line = text.lower().translate(_TABLE)
    at = 0
    while at < len(line):
        stop = line.find(b" ", at + STEP)
        stop = len(line) if stop < 0 else stop
        yield line[at:stop].replace(_MARK, b" . ").split()
        at = stop


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        whole(text_col).cast("binary").alias("text"),
    )


def word_counts(texts: DataFrame, min_count: int) -> DataFrame:
    """(lang, word, f) of words with f >= min_count, and with a null word the number
    of all words of the language."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64())])

    def rows(counts: dict[str, Counter]) -> Iterator[dict]:
        for lang, words in counts.items():
            words.pop(_MARK, None)
            if words:
                yield {"lang": lang, "word": None, "f": words.total()}
            for word, f in words.items():
                yield {"lang": lang, "word": word, "f": f}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = counts.setdefault(lang, Counter())
                for words in words_of(text.as_py()):
                    mine.update(words)
            if sum(map(len, counts.values())) > WORDS:
                yield from pieces(rows(counts), schema)
                counts = {}
        yield from pieces(rows(counts), schema)

    each = texts.mapInArrow(apply, "lang string, word binary, f bigint")
    summed = each.groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return summed.where(F.col("word").isNull() | (F.col("f") >= min_count))


def with_ids(words: DataFrame) -> DataFrame:
    """Words with an ``id`` from 0 on without gaps; ``words`` is a written table."""
    at = F.monotonically_increasing_id()
    placed = materialize(
        words.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND((1 << 33) - 1).alias("_at")), "placed"
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per file
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = placed.join(F.broadcast(starts), "_part")
    return numbered.select(*words.columns, (F.col("_before") + F.col("_at")).alias("id"))


def encoded_by_dictionary(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row of ids per text, BREAK between pieces and for other words; the
    dictionary is broadcast."""
    known: dict[str, dict[bytes, int]] = {}
    for lang, word, i in vocabulary.select("lang", "word", "id").toLocalIterator():
        known.setdefault(lang, {})[bytes(word)] = i
    shared = texts.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("ids", pa.list_(pa.int64()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                look = shared.value.get(lang, {}).get
                steps = [[look(w, BREAK) for w in words] for words in words_of(text.as_py())]
                rows.append(np.concatenate([*(np.array(s, np.int64) for s in steps), [BREAK]]))
            yield pa.RecordBatch.from_arrays([pa.array(rows, schema.field(0).type)], schema=schema)

    return texts.mapInArrow(apply, "ids array<bigint>")


def encoded_by_join(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The same rows as :func:`encoded_by_dictionary`, by a shuffle of each text's
    distinct words; the hot words are on one side of the join only."""
    rows = texts.withColumn("_row", F.monotonically_increasing_id())
    made = [("words", pa.list_(pa.binary())), ("codes", pa.list_(pa.int32()))]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            words, codes = [], []
            for text in batch.column(1):
                own: dict[bytes, int] = {_MARK: BREAK}
                steps = [[own.setdefault(w, len(own) - 1) for w in some] for some in words_of(text.as_py())]
                codes.append(np.concatenate([*(np.array(s, np.int32) for s in steps), [BREAK]]))
                words.append(list(own)[1:])
            arrays = [pa.array(words, made[0][1]), pa.array(codes, made[1][1])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *arrays], ["lang", "_row", "words", "codes"]
            )

    coded = rows.mapInArrow(code, "lang string, _row bigint, words array<binary>, codes array<int>")
    coded = materialize(coded, "codes")
    each = coded.select("lang", "_row", F.posexplode("words").alias("_code", "word"))
    found = each.join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
    found = found.groupBy("_row").agg(F.collect_list(F.struct("_code", "id")).alias("found"))
    both = coded.select("_row", "codes").join(found, "_row", "left").select("codes", "found")

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for codes, pairs in zip(batch.column(0), batch.column(1)):
                codes = codes.values.to_numpy()
                ids = np.full(codes.max(initial=BREAK) + 2, BREAK, np.int64)  # the last: BREAK
                if pairs.is_valid and len(pairs):
                    ids[pairs.values.field(0).to_numpy()] = pairs.values.field(1).to_numpy()
                out.append(ids[codes])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["ids"])

    return both.mapInArrow(recode, "ids array<bigint>")


def _keys(ids: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    return quotient.permute(quotient.pack([ids[at + i] for i in range(shape.n)], shape), shape)


def _spots(limbs: np.ndarray, shape: Shape, bits: int) -> np.ndarray:
    """Bit of each permuted key in a table of 2^bits."""
    return (limbs[0] >> np.uint64(max(0, shape.width - bits))).astype(np.int64)


def _windows(ids: np.ndarray, n: int, table: np.ndarray | None, shape: Shape | None, bits: int) -> np.ndarray:
    """First places of n-grams of known words whose (n-1)-grams may be frequent."""
    inside = ids[: max(0, len(ids) - n + 1)] != BREAK
    for i in range(1, n):
        inside &= ids[i : len(ids) - n + 1 + i] != BREAK
    at = np.flatnonzero(inside)
    if table is None or not len(at):
        return at
    both = np.union1d(at, at + 1)
    spots = _spots(_keys(ids, both, shape), shape, bits)
    may = np.zeros(len(ids) + 1, bool)
    may[both] = (table[spots >> 3] >> (spots & 7)) & 1
    return at[may[at] & may[at + 1]]


def ngram_counts(encoded: DataFrame, shape: Shape, min_count: int, frequent=None) -> DataFrame:
    """(ids, a) of the n-grams with a >= min_count, and their ``spot``."""
    table, lower, table_bits = frequent or (None, None, 0)
    shared = encoded.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("slot", pa.int64()), ("filter", pa.binary())])

    def sent(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[dict]:
        if not parts:
            return
        limbs, counts = quotient.merge(parts)
        slots = quotient.slot_of(limbs, shape)
        starts = np.flatnonzero(np.diff(slots, prepend=-1))
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(slots)]):
            yield {"slot": int(slots[lo]), "filter": quotient.write(limbs[:, lo:hi], counts[lo:hi], shape)}

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches):
            ids = batch.column(0).flatten().to_numpy()
            at = _windows(ids, shape.n, shared.value, lower, table_bits)
            if len(at):
                held.append(quotient.counted(_keys(ids, at, shape)))
            if sum(len(c) for _, c in held) > KEYS:
                held = [quotient.merge(held)]
                if len(held[0][1]) > KEYS // 2:
                    yield from pieces(sent(held), schema, 64)
                    held = []
        yield from pieces(sent(held), schema, 64)

    def merged(key: tuple, group: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        limbs, counts = quotient.merge([quotient.read(f.as_py(), slot, shape) for f in group.column("filter")])
        often = counts >= min_count
        limbs = limbs[:, often]
        spots = _spots(limbs, shape, TABLE_BITS)
        ids = quotient.unpack(quotient.unpermute(limbs.copy(), shape), shape)
        ends = np.arange(0, ids.size + 1, shape.n, dtype=np.int32)
        lists = pa.ListArray.from_arrays(ends, pa.array(ids.ravel()))
        return pa.table({"ids": lists, "a": counts[often], "spot": spots})

    filters = encoded.mapInArrow(shard, "slot bigint, filter binary")
    return filters.groupBy("slot").applyInArrow(merged, "ids array<bigint>, a bigint, spot bigint")


def frequency_table(level: DataFrame, shape: Shape) -> tuple[np.ndarray, Shape, int]:
    """Bits of the places of frequent n-grams: at most 2^TABLE_BITS of them, whatever
    the number of n-grams; made in the tasks, a row for each 32,768 bits."""
    wanted = max(1, level.count()) * BITS_PER_KEY
    full = min(TABLE_BITS, shape.width)
    bits = min(full, max(3, int(wanted - 1).bit_length()))
    spot = F.shiftright("spot", full - bits)
    rows = (
        level.groupBy(F.bitmap_bucket_number(spot).alias("k"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits"))
        .collect()  # at most 2^TABLE_BITS / 32,768 rows of 4 KiB
    )
    table = np.zeros(-(-(1 << bits) // 8) + _BITMAP // 8, np.uint8)
    # Value 0 has a bucket of its own, and bucket k starts at value (k - 1) * 32,768 + 1.
    for k, some in rows:
        own = np.unpackbits(np.frombuffer(bytes(some), np.uint8), bitorder="little")
        values = np.flatnonzero(own) + ((k - 1) * _BITMAP + 1 if k > 0 else 0)
        np.bitwise_or.at(table, values >> 3, (1 << (values & 7)).astype(np.uint8))
    return table, shape, bits


def _scored(candidates: DataFrame, phrases: DataFrame, langs: DataFrame) -> DataFrame:
    """Candidates with l, r and score of the cut that scores lowest."""
    size = F.size("ids")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns(
        {"_left": F.slice("ids", 1, F.col("k")), "_right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))}
    )
    left = phrases.select(F.col("ids").alias("_left"), F.col("a").alias("l"))
    right = phrases.select(F.col("ids").alias("_right"), F.col("a").alias("r"))
    parts = cuts.join(left, "_left").join(right, "_right").join(langs, "lang")
    # 38 digits hold 1000 * a * n up to counts of 10^17.
    a, n, lo, r = (f"CAST({c} AS DECIMAL(19,0))" for c in ("a", "n", "l", "r"))
    score = F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {a} * {n}) DIV ({lo} * {r})")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return parts.groupBy("lang", "ids", "a", "n").agg(lowest).select("lang", "ids", "a", "n", "cut.l", "cut.r", "cut.score")


def _not_absorbed(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates that no longer one holds with 100 f(longer) >= percent * a.

    If a longer one does, the part of it that has one word more does: it is at
    least as frequent. So only the two parts of each candidate are told of it.
    """
    n = F.size("ids")
    parts = F.array(F.slice("ids", 1, n - 1), F.slice("ids", 2, n - 1))
    longer = candidates.where(n > 2).select(F.explode(parts).alias("ids"), F.col("a").alias("longer"))
    longest = longer.groupBy("ids").agg(F.max("longer").alias("longer"))
    rest = candidates.join(longest, "ids", "left")
    return rest.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = 100,
    first: int = 2000,
    absorb_percent: int = 100,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to MAX_WORDS words with a = f(phrase) >= min_count scores
    floor(1000 a n / (l r)) at the cut where that is lowest; one that lies in a longer
    phrase with at least ``absorb_percent`` of its count is left out.
    """
    texts = _texts(docs, text_col, lang_col)
    counts = materialize(word_counts(texts, min_count), "word-counts")
    langs = counts.where("word IS NULL").select("lang", F.col("f").alias("n"))
    vocabulary = materialize(with_ids(counts.where("word IS NOT NULL")), "vocabulary")
    words, size, total = vocabulary.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang") + WORD_BYTES), F.lit(0)),
        F.coalesce(F.sum("f"), F.lit(0)),
    ).first()
    encode = encoded_by_dictionary if size <= max_bytes else encoded_by_join
    encoded = materialize(encode(texts, vocabulary), "ids")
    bits = max(1, int(words - 1).bit_length()) if words else 1
    slots = int(max(4 * workers(docs), total // SLOT_ENTRIES) - 1).bit_length()
    levels: list[DataFrame] = []
    frequent = None
    for n in range(2, MAX_WORDS + 1):
        shape = Shape(n, bits, slots)
        level = materialize(ngram_counts(encoded, shape, min_count, frequent), f"{n}-grams")
        levels.append(level.select("ids", "a"))
        if n < MAX_WORDS:
            frequent = frequency_table(level, shape)
    discard(encoded)

    candidates = levels[0]
    for level in levels[1:]:
        candidates = candidates.unionByName(level)
    phrases = candidates.unionByName(vocabulary.select(F.array("id").alias("ids"), F.col("f").alias("a")))
    names = small_side(vocabulary.select("id", "lang", "word"), words)
    own = names.select(F.col("id").alias("_first"), "lang")
    kept = _not_absorbed(candidates, absorb_percent)
    kept = kept.withColumn("_first", F.element_at("ids", 1)).join(own, "_first").drop("_first")
    scored = _scored(kept, phrases, small_side(langs, langs.count()))

    order = [F.desc("score"), F.desc("a")]
    tied = F.rank().over(Window.partitionBy("lang").orderBy(*order))
    best = materialize(scored.withColumn("_rank", tied).where(F.col("_rank") <= first).drop("_rank"), "best")
    spelled = best.select("*", F.posexplode("ids").alias("_at", "id")).join(names.select("id", "word"), "id")
    keys = ["lang", "ids", "a", "l", "r", "n", "score"]
    in_order = F.sort_array(F.collect_list(F.struct("_at", F.col("word").cast("string").alias("word"))))
    spelled = spelled.groupBy(*keys).agg(F.array_join(F.transform(in_order, lambda w: w["word"]), " ").alias("phrase"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = spelled.withColumn("rank", place.cast("long")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
