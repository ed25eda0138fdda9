"""Removal of repeated passages: depth-limited radix sort of the suffixes.

Texts are strings of units: bytes, or words (runs without ASCII white space, which
keep characters whole). A window is the first ``length`` units of a suffix; only
suffixes with that many count. Windows are told apart digit by digit, most significant first, and a
group is left as soon as its answer is known, so the equal groups at the end are
exactly the repeated windows. No suffix is ever compared beyond ``length`` units.

The order in which a window's units are taken as digits is free, as long as equal
windows take them in the same order. Here a window's first digit is the gram (a few
neighbouring units), anywhere in the window, that hashes lowest. Neighbouring windows share them,
so one row stands for a *run* of suffixes (some 180 on prose), and all further
digits are taken outwards from there. A text that says a word or a line over and over
has one row for equal runs, with their places; neighbours among them are one place
with their number.

1. runs by their gram. A gram that occurs once ends all its windows: unique.
2. runs by all that their windows cover. Equal runs end as repeated. They
   stay in the game as one row, as partners of the runs that are still open.
3. blocks of a few windows of the open runs and their partners: first by what all
   their windows share, then, if that is not unique, by all they cover.
4. the windows of the blocks that are still open, and their partners, one by one.

Only the edges of a repeated passage reach the last passes. All windows of a run
contain its gram, so what its repeated windows cover is one span,
given by the first and the last of them.

Strings are compared by 128-bit hashes (XXH3) of all their bytes (of words, by
those of the words' 64-bit hashes). Passes are
aggregates with partial sums on those hashes, joined back to the runs; no group
is gathered in a task, however many documents share a passage. Equal texts are
taken once, with their number, in a table that is bucketed by their key: the
passes that need the texts again read it in place.

Defined results: null texts are empty; texts shorter than ``length`` keep
everything unless nothing repeats; repeated rows are copies of each other like
any equal texts; null identifiers are kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import distinct_texts, lean, materialize, slices, workers
from cloakframe.runtime import discard

#: Units of a window's first digit.
GRAMS = {"bytes": 32, "words": 6}
#: Windows of a text that are hashed at a time.
BLOCK = 1 << 20
#: Lists of a run's occurrences, at least, and runs of all texts for each list.
CHUNKS, CHUNK_RUNS = 512, 1_000_000
#: Windows of an open run that are compared at once.
STRIDE = 12
_WORD = re.compile(rb"\S+")
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: 128-bit hashes travel as two numbers; ``low`` and ``high`` count from the gram.
#: ``n`` equal runs of a text; at a place, ``times`` runs begin ``high - low + 1`` units after each other.
_RUN_KIND = "key binary, gram long, run0 long, run1 long, low short, high short, n int"
_RUN = f"{_RUN_KIND}, places array<struct<at:int,times:int>>"
_BLOCK = "run_id long, copies long, core long, cover0 long, cover1 long, low short, high short"
_WINDOW = "cover0 long, cover1 long, copies long, window0 long, window1 long, start short"
_RUN_KEY, _COVER, _SINGLE = ["run0", "run1"], ["cover0", "cover1"], ["window0", "window1"]
#: Most units in a window; places in it are 16-bit numbers.
MAX_LENGTH = 1 << 14
_ARROW = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "short": pa.int16()}


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields]
    )


def _halves(data: bytes) -> tuple[int, int]:
    """A 128-bit hash as two signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(data))


def unit_codes(text: str | None, units: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The text's bytes, a code per unit, and where units start and end in the bytes."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if units == "bytes":
        places = np.arange(len(data) + 1)
        return data, np.frombuffer(data, np.uint8), places[:-1], places[1:]
    found = [m.span() for m in _WORD.finditer(data)]
    places = np.array(found, np.int64).reshape(-1, 2)
    codes = (xxhash.xxh64_intdigest(data[a:b]) for a, b in found)
    return data, np.fromiter(codes, np.uint64, len(found)), places[:, 0], places[:, 1]


def _gram_hashes(codes: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` units from each position on (uint64)."""
    n = len(codes) - gram + 1
    word, width = codes.astype(np.uint64), 1
    if codes.dtype == np.uint8:
        width = 8
        for step in (1, 2, 4):  # eight bytes from each position as one number
            word = word[:-step] | (word[step:] << np.uint64(8 * step))
    out = np.zeros(n, np.uint64)
    for k in range(gram // width):
        out ^= word[width * k : width * k + n]
        out *= _MIX[k % 3]
        out ^= out >> np.uint64(29)
    return out * _MIX[0]


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(codes: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(gram hash, gram place, first window, last window), windows in order.

    Windows that share a gram at one place are one run; of equal grams in a window
    the first counts. A very long text is taken in blocks of windows; a run that a
    block's end cuts is two runs, which the later passes compare like any others.
    """
    for start in range(0, len(codes) - length + 1, BLOCK):
        for mark, at, first, last in _block_runs(codes[start : start + BLOCK + length - 1], length, gram):
            yield mark, start + at, start + first, start + last


def _block_runs(codes: np.ndarray, length: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    hashes = _gram_hashes(codes, gram)
    width = length - gram + 1
    least = _sliding_minimum(hashes, width)
    n = len(least)
    # the first place from each window's start on that holds the window's minimum
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    for a, b in zip(change.tolist(), [*change[1:].tolist(), n]):
        value = least[a]
        places = np.flatnonzero(hashes[a : b + width - 1] == value) + a
        start = a
        for place in places.tolist():
            stop = min(place, b - 1)
            if stop >= start:
                yield int(value.view(np.int64)), place, start, stop
                start = stop + 1
            if start >= b:
                break


def _run_rows(batches: Iterator[pa.RecordBatch], length: int, units: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 64):
        cols: list[list] = [[] for _ in range(7)]
        ends, ats, times = [0], [], []
        for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            _, codes, _, _ = unit_codes(text, units)
            raw, size = codes.tobytes(), codes.itemsize
            found: dict[tuple, list[list[int]]] = {}
            before = None
            for gram, at, first, last in runs(codes, length, GRAMS[units]):
                cover = (at - first).to_bytes(4, "little") + raw[first * size : (last + length) * size]
                kind = (gram, *_halves(cover), first - at, last - at)
                if kind == before:  # windows come in order, so it is the next place
                    found[kind][-1][1] += 1
                else:
                    found.setdefault(kind, []).append([at, 1])
                before = kind
            for kind, places in found.items():
                row = (key, *kind, sum(n for _, n in places))
                for col, value in zip(cols, row):
                    col.append(value)
                ats += [at for at, _ in places]
                times += [n for _, n in places]
                ends.append(len(ats))
        place = pa.StructArray.from_arrays([pa.array(ats, pa.int32()), pa.array(times, pa.int32())], ["at", "times"])
        places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), place)
        yield _batch(cols, _RUN_KIND).append_column("places", places)


def _block_rows(batches: Iterator[pa.RecordBatch], length: int, units: str) -> Iterator[pa.RecordBatch]:
    """A row per block of an open run; starts of windows are counted from the gram."""
    mark = xxhash.xxh3_64_intdigest
    for part in slices(batches, 32):
        cols: list[list] = [[] for _ in range(7)]
        for text, open_runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            _, codes, _, _ = unit_codes(text, units)
            raw, size = codes.tobytes(), codes.itemsize
            for r in open_runs:
                at = r["at"]
                for number in range(r["low"] // STRIDE, r["high"] // STRIDE + 1):
                    start, stop = number * STRIDE, number * STRIDE + STRIDE - 1
                    low, high = max(start, r["low"]), min(stop, r["high"])
                    shared = raw[(at + stop) * size : (at + start + length) * size]
                    core = mark(number.to_bytes(4, "little", signed=True) + shared)
                    ends = low.to_bytes(4, "little", signed=True) + high.to_bytes(4, "little", signed=True)
                    cover = ends + raw[(at + low) * size : (at + high + length) * size]
                    row = (r["run_id"], r["copies"], core - (1 << 63), *_halves(cover), low, high)
                    for col, value in zip(cols, row):
                        col.append(value)
        yield _batch(cols, _BLOCK)


def _window_rows(batches: Iterator[pa.RecordBatch], length: int, units: str) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 32):
        cols: list[list] = [[] for _ in range(6)]
        for text, blocks in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            _, codes, _, _ = unit_codes(text, units)
            raw, size = codes.tobytes(), codes.itemsize
            for b in blocks:
                for start in range(b["low"], b["high"] + 1):
                    p = b["at"] + start
                    window = _halves(raw[p * size : (p + length) * size])
                    row = (b["cover0"], b["cover1"], b["copies"], *window, start)
                    for col, value in zip(cols, row):
                        col.append(value)
        yield _batch(cols, _WINDOW)


def _still_open(kinds: DataFrame, part: str) -> DataFrame:
    """Of ``kinds(part, copies, ...)``: those whose part has several kinds, one of them single."""
    groups = kinds.groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("least"))
    # Written, so that a part with very many kinds can be split in the join.
    parts = materialize(groups.where("n > 1 AND least = 1").select(part), "open-parts")
    return kinds.join(parts, part)


def _per_text(texts: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """Each text with the list of its rows (no longer than the text)."""
    lists = rows.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("rows"))
    return texts.select("key", "text").join(lists, "key").select("text", "rows")


def repeated_spans(texts: DataFrame, length: int, units: str) -> DataFrame:
    """(key, spans): per text with repeats, the units (start, end) that repeated windows cover.

    ``texts(key, text)`` has one row per distinct text. Spans may touch or overlap;
    there is one per run, or per place where equal runs follow each other.
    """
    ends = [F.min("low").alias("low"), F.max("high").alias("high")]  # the same for equal hashes
    made = texts.select("key", "text").mapInArrow(lean(lambda batches: _run_rows(batches, length, units)), _RUN)
    # Pass 1: most grams occur once.
    every = materialize(made, "runs")
    twice = every.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    grams = materialize(twice, "grams")
    # Occurrences of equal runs are kept in lists, dealt by their hash: a passage that
    # very many texts hold is a few rows of bounded length in the joins to come.
    chunks = max(CHUNKS, every.count() // CHUNK_RUNS)
    chunk = F.pmod(F.xxhash64("key"), F.lit(chunks))
    held = F.collect_list(F.struct("key", "places")).alias("held")
    one = F.min(F.struct("key", F.col("places")[0]["at"].alias("at"))).alias("one")
    shared = every.join(grams, "gram").groupBy("gram", *_RUN_KEY, chunk.alias("chunk"))
    shared = materialize(shared.agg(held, one, F.sum("n").alias("n"), *ends), "shared-runs")
    discard(every, grams)

    # Pass 2: whole runs.
    counted = shared.groupBy("gram", *_RUN_KEY).agg(F.sum("n").alias("copies"), *ends)
    counted = materialize(counted, "run-kinds")
    settled = counted.where("copies > 1").select(*_RUN_KEY, "low", "high")
    open_kinds = materialize(
        _still_open(counted, "gram").select(*_RUN_KEY, "copies").withColumn("run_id", F.monotonically_increasing_id()),
        "open-kinds",
    )
    # A run with copies takes part with one of them, whichever text it is in.
    first = F.min("one").alias("one")
    placed = shared.join(open_kinds, _RUN_KEY).groupBy("run_id").agg(first, F.first("copies").alias("copies"), *ends)
    open_runs = materialize(placed.select("run_id", "copies", "low", "high", "one.*"), "open-runs")

    # Pass 3: blocks of windows.
    blocks = _per_text(texts, open_runs, ["run_id", "copies", "at", "low", "high"])
    blocks = materialize(blocks.mapInArrow(lean(lambda batches: _block_rows(batches, length, units)), _BLOCK), "blocks")
    block_kinds = blocks.groupBy("core", *_COVER).agg(
        F.sum("copies").alias("copies"), F.min("run_id").alias("run_id"), *ends
    )
    block_kinds = materialize(block_kinds, "block-kinds")
    settled_blocks = block_kinds.where("copies > 1").select(*_COVER, "low", "high")
    open_blocks = _still_open(block_kinds, "core").drop("core")
    open_blocks = open_blocks.join(open_runs.select("run_id", "key", "at"), "run_id")

    # Pass 4: single windows.
    windows = _per_text(texts, open_blocks, [*_COVER, "copies", "at", "low", "high"])
    windows = materialize(windows.mapInArrow(lean(lambda batches: _window_rows(batches, length, units)), _WINDOW), "windows")
    repeated = windows.groupBy(*_SINGLE).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_SINGLE)
    edges = (
        windows.where("copies = 1")
        .join(materialize(repeated, "repeated-windows"), _SINGLE)
        .groupBy(*_COVER)
        .agg(F.min("start").alias("low"), F.max("start").alias("high"))
    )

    from_blocks = (
        blocks.where("copies = 1")
        .select("run_id", *_COVER)
        .join(materialize(settled_blocks.union(edges), "covers"), _COVER)
        .groupBy("run_id")
        .agg(*ends)
        .join(open_kinds, "run_id")
        .select(*_RUN_KEY, "low", "high")
    )
    covered = materialize(settled.union(from_blocks), "covered-runs")
    discard(counted, open_kinds, open_runs, blocks, block_kinds, windows)
    # Few rows of long lists: dealt anew before they are spelled out.
    lists = shared.select("chunk", "held", *_RUN_KEY).join(covered, _RUN_KEY)
    lists = lists.repartition(workers(texts), "chunk", *_RUN_KEY)
    step = (F.col("high") - F.col("low")).cast("int") + 1

    def span(place: Column) -> Column:
        # Several times: a repeated run as a whole, so all its windows are one span.
        last = place["at"] + (place["times"] - 1) * step
        return F.struct(
            (place["at"] + F.col("low")).alias("start"),
            (last + F.col("high") + length).alias("end"),
        )

    spans = lists.select(F.explode("held").alias("o"), "low", "high").select(
        F.col("o.key").alias("key"), F.transform("o.places", span).alias("spans")
    )
    return spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans (sorted, disjoint)."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]])


_RESULT = "key binary, kept binary, spans array<struct<start:int,end:int>>, n_bytes long, n_removed long, kept_sha256 string"


def remove_repeats(
    docs: DataFrame,
    text_col: str = "text",
    length: int = 400,
    units: str = "bytes",
    with_kept: bool = True,
) -> DataFrame:
    """Per distinct text: ``key``, the remaining text, the removed spans (bytes) and counts.

    Every unit that is covered by a string of ``length`` units which also starts
    somewhere else (the same text included) is removed; strings are judged on the
    input. ``kept`` is binary. Join to the documents on ``common.text_key``.
    """
    if not GRAMS[units] < length <= MAX_LENGTH:
        raise ValueError(f"length must be over {GRAMS[units]} and at most {MAX_LENGTH} {units}")
    texts = distinct_texts(docs, text_col)
    # A text with copies is repeated as a whole, if long enough for one window.
    found = repeated_spans(texts, length, units)
    joined = texts.join(found, "key", "left").select("key", "text", "copies", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 64):
            rows = []
            for key, text, copies, spans in zip(*(c.to_pylist() for c in part.columns)):
                data, codes, starts, ends = unit_codes(text, units)
                if copies > 1 and len(codes) >= length:
                    spans = [{"start": 0, "end": len(codes)}]
                gone = merge([(s["start"], s["end"]) for s in spans or ()])
                gone = [(int(starts[a]), int(ends[b - 1])) for a, b in gone]
                kept = cut(data, gone)
                rows.append(
                    {
                        "key": key,
                        "kept": kept if with_kept else None,
                        "spans": [{"start": a, "end": b} for a, b in gone],
                        "n_bytes": len(data),
                        "n_removed": len(data) - len(kept),
                        "kept_sha256": sha256(kept).hexdigest(),
                    }
                )
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_pylist(
                rows,
                schema=pa.schema(
                    [("key", pa.binary()), ("kept", pa.binary()), ("spans", pa.list_(span)),
                     ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
                ),
            )

    return joined.mapInArrow(lean(apply), _RESULT)
