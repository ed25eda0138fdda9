"""What a Python worker holds while it works, and after a task."""

from __future__ import annotations

import random
import tracemalloc
from pathlib import Path

import pyarrow as pa

from cloakframe.llm import tokens
from cloakframe.llm.common import lean


def _resident_mb() -> float:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 1e6


def test_a_worker_gives_back_what_it_does_not_use():
    last = []

    def apply(batches):
        held = [bytearray(50_000) for _ in range(4000)]
        yield from batches
        last.append(held[-1])  # of 200 MB, the end of the heap stays in use

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["a"])
    before = _resident_mb()
    assert list(lean(apply)([batch, batch])) == [batch, batch]
    assert _resident_mb() - before < 60


def test_encoding_takes_memory_by_its_blocks():
    draw = random.Random(1)
    words = ["".join(draw.choices("etaoinshr", k=draw.randint(2, 9))) for _ in range(5000)]

    def peak_mb(texts):
        array = pa.array(texts)
        tracemalloc.start()
        try:
            kept = sum(x.nbytes for x in tokens.encode(array))
            return (tracemalloc.get_traced_memory()[1] - kept) / 1e6
        finally:
            tracemalloc.stop()

    texts = [" ".join(draw.choices(words, k=4000)) for _ in range(450)]  # 12 MB
    peak_mb(texts[:1])
    assert peak_mb(texts) < 2 * peak_mb(texts[:100])
