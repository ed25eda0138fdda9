"""Token ids of whole texts by a public byte-level BPE vocabulary.

The vocabulary's splitting rule never lets a token reach over a single white-space
character from the left. A text without two such characters in a row can therefore
be cut before every space and around every line end, and each part has the ids it
has in the text. A block of texts is cut, its distinct parts are encoded once, and
their ids are put back in order by array operations. Texts with runs of white space
are encoded whole. Both ways are exact. The ids are those of the JSON file of the
same vocabulary (``byte_bpe_50k.json``, library ``tokenizers``); the tests compare.
A text that spells one of that file's added tokens (``<|endoftext|>``) is cut there,
and the token has its own id, as the library does it; the parts are texts of their own.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut and encoded at a time.
BLOCK_BYTES = 3_000_000
_CUT = "\x01"
_WHITE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@lru_cache(maxsize=2)
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    made = tiktoken.Encoding(
        name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return made, sizes


@lru_cache(maxsize=2)
def added_tokens(name: str) -> dict[str, int]:
    """Texts that are one id wherever they stand, from the JSON file of the vocabulary."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def _joined(encoding, sizes, parts: pa.Array, gap: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of parts that are encoded as one text with ``gap`` before each, and counts."""
    if not len(parts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if gap:
        parts = pc.binary_join_element_wise(gap, parts, "")
    _, places, data = parts.buffers()  # the parts stand one after another in the buffer
    bounds = np.frombuffer(places, np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
    line = data[int(bounds[0]) : int(bounds[-1])].to_pybytes().decode("utf-8")
    ids = encoding.encode_to_numpy(line, disallowed_special=())
    lengths = np.diff(bounds)
    stops = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(lengths), "left") + 1
    counts = np.diff(stops, prepend=0)
    if gap:  # the gap is the first id of each part
        keep = np.ones(len(ids), bool)
        keep[stops - counts] = False
        return ids[keep], counts - 1
    return ids, counts


def _distinct_ids(parts: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A pool of ids, and each part's first place and count in it."""
    encoding, sizes = _encoding(name)
    white = pc.count_substring_regex(parts, _WHITE).to_numpy()
    size = pc.binary_length(parts).to_numpy()
    leads = pc.starts_with(parts, " ").to_numpy(zero_copy_only=False)
    spaced, plain = leads & (white == 1) & (size > 1), (white == 0) & (size > 0)
    counts = np.zeros(len(parts), np.int64)
    pools = [np.zeros(0, np.uint32)]
    groups = [np.flatnonzero(spaced), np.flatnonzero(plain), np.flatnonzero(~spaced & ~plain)]
    for group, gap in zip(groups, ("", "\n")):
        ids, counts[group] = _joined(encoding, sizes, parts.take(pa.array(group)), gap)
        pools.append(ids)
    for i in groups[2].tolist():
        pools.append(np.array(encoding.encode_ordinary(parts[i].as_py()), np.uint32))
        counts[i] = len(pools[-1])
    order = np.concatenate(groups)
    firsts = np.zeros(len(parts), np.int64)
    firsts[order] = np.cumsum(counts[order]) - counts[order]
    return np.concatenate(pools), firsts, counts


def _cut_texts(texts: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts one after another, and the number of ids of each."""
    marked = pc.replace_substring(texts, "\n", f"{_CUT}\n{_CUT}")
    marked = pc.replace_substring(marked, " ", f"{_CUT} ")
    lists = pc.split_pattern(marked, _CUT)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    pool, firsts, counts = _distinct_ids(coded.dictionary, name)
    codes = coded.indices.to_numpy()
    lengths = counts[codes]
    ends = np.cumsum(lengths)
    shift = np.repeat(firsts[codes] - (ends - lengths), lengths)
    ids = pool[shift + np.arange(len(shift))] if len(shift) else np.zeros(0, np.uint32)
    ends = np.concatenate([[0], ends])
    return ids, np.diff(ends[bounds - bounds[0]])


def _block_ids(texts: pa.Array, name: str) -> list[np.ndarray]:
    odd = pc.or_(
        pc.match_substring_regex(texts, _WHITE + "{2}"), pc.match_substring(texts, _CUT)
    ).to_numpy(zero_copy_only=False)
    even = np.flatnonzero(~odd)
    out: list[np.ndarray] = [None] * len(texts)
    if len(even):
        ids, counts = _cut_texts(texts.take(pa.array(even)), name)
        for i, some in zip(even.tolist(), np.split(ids, np.cumsum(counts)[:-1])):
            out[i] = some
    for i in np.flatnonzero(odd).tolist():
        out[i] = np.array(_encoding(name)[0].encode_ordinary(texts[i].as_py()), np.uint32)
    return out


def _with_added(texts: pa.Array, name: str, added: dict[str, int]) -> list[np.ndarray]:
    """Ids of the texts, of which some may hold added tokens."""
    pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    holds = np.logical_or.reduce([pc.match_substring(texts, t).to_numpy(zero_copy_only=False) for t in added])
    if not holds.any():
        return _block_ids(texts, name)
    cuts = [pattern.split(t.as_py()) if h else [t.as_py()] for t, h in zip(texts, holds.tolist())]
    parts = iter(_block_ids(pa.array([p for cut in cuts for p in cut[::2]], pa.string()), name))
    out = []
    for cut in cuts:
        said = [next(parts) if i % 2 == 0 else np.array([added[p]], np.uint32) for i, p in enumerate(cut)]
        out.append(np.concatenate(said))
    return out


def encode(
    texts: pa.Array | list, name: str = "byte_bpe_50k.tiktoken", json_name: str = "byte_bpe_50k.json"
) -> list[np.ndarray]:
    """Token ids (uint32) of each text without special tokens around it; null texts
    have none. Ranks come from ``name``, added tokens from ``json_name``."""
    array = pc.fill_null(pa.array(texts, pa.string()), "")
    added = added_tokens(json_name)
    sizes = np.cumsum(pc.binary_length(array).to_numpy().astype(np.int64))
    out: list[np.ndarray] = []
    while len(out) < len(array):
        at = len(out)
        before = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + BLOCK_BYTES, "right")))
        out += _with_added(array.slice(at, stop - at), name, added)
    return out
