"""Sharding by histogram sort: shards of near equal bytes, in key order.

Every row has a 128-bit key, the hash of its content followed by the hash of its
place in the written table, so rows of equal content lie next to each other and
yet any two rows can be told apart. Splitters are found by counting: the exact
bytes below each candidate boundary are summed over all partitions, and only the
interval that a splitter's target falls into is looked at more closely, by the
next bits of the key, until the bytes below the boundary are within the tolerance
of the target or the interval holds a single row. Then the rows are exchanged
once, to (shard, part of the shard), which numbers them.

A round's counts are at most ``2**STEP`` per splitter. Content that fills a third
of the table has one hash, but its rows go on to differ in the second half of the
key, so a splitter can pass through it.

Only DataFrame functions are used.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import materialize, workers

#: Bits of the key that a round adds.
STEP = 8
_KEYS = ("_k0", "_k1")
KEY_BITS = 128


def _prefix(rounds: int) -> Column:
    """The first ``rounds`` digits as hexadecimal text; its order is the key's."""
    text = F.concat(*[F.lpad(F.hex(F.col(k)), 16, "0") for k in _KEYS])
    return F.substring(text, 1, rounds * STEP // 4)


def splitters(rows: DataFrame, size_col: str, shards: int, tolerance: float = 1e-3) -> list[str]:
    """Hexadecimal keys; the i-th is the first key of shard i + 1.

    ``rows`` is written and has the key columns. ``tolerance`` is the share of a
    shard's bytes by which the bytes below a splitter may miss their target.
    """
    total = rows.agg(F.coalesce(F.sum(size_col), F.lit(0))).first()[0]
    targets = {i: total * i / shards for i in range(1, shards)}
    slack = tolerance * total / shards
    # for each splitter in question: the prefix that holds its target, bytes below that
    inside = {i: ("", 0) for i in targets}
    done: dict[int, str] = {}
    for rounds in range(1, KEY_BITS // STEP + 1):
        if not inside:
            break
        wanted = sorted({prefix for prefix, _ in inside.values()})
        near = rows
        if rounds > 1:
            near = rows.where(_prefix(rounds - 1).isin(wanted))
        counted = near.groupBy(_prefix(rounds).alias("p")).agg(
            F.sum(size_col).alias("bytes"), F.count(F.lit(1)).alias("rows")
        )
        by_parent: dict[str, list] = {}
        for r in sorted(counted.collect()):
            by_parent.setdefault(r["p"][: (rounds - 1) * STEP // 4], []).append(r)
        for i, (parent, below) in list(inside.items()):
            # boundaries below each child, and at the parent's end
            bounds = [below]
            for child in by_parent.get(parent, []):
                bounds.append(bounds[-1] + child["bytes"])
            children = by_parent.get(parent, [])
            best = min(range(len(bounds)), key=lambda k: abs(bounds[k] - targets[i]))
            k = max(0, min(bisect_left(bounds, targets[i]) - 1, len(children) - 1))
            single = not children or children[k]["rows"] <= 1
            if abs(bounds[best] - targets[i]) <= slack or single or rounds == KEY_BITS // STEP:
                # the boundary below child ``best``; past the last child: the parent's end
                done[i] = (
                    _padded(children[best]["p"]) if best < len(children) else _after(parent)
                )
                del inside[i]
            else:
                inside[i] = (children[k]["p"], bounds[k])
    return [done[i] for i in sorted(done)]


def _padded(prefix: str) -> str:
    return prefix.ljust(KEY_BITS // 4, "0")


def _after(prefix: str) -> str:
    """The first key after all that start with ``prefix``; '~' is above every key."""
    number = int(prefix or "0", 16) + 1
    digits = f"{number:X}".rjust(len(prefix), "0")
    return _padded(digits) if prefix and len(digits) == len(prefix) else "~"


def shard_by_bytes(
    df: DataFrame, size_col: str, content_cols: list[str], shards: int = 24, tolerance: float = 1e-3
) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in a shard).

    Shards are ranges of the key with near equal sums of ``size_col`` (a long, null
    counts 0). Rows with equal ``content_cols`` stay together unless a splitter
    passes through them. All columns of ``df`` are kept; they may not be named
    ``shard``, ``slot`` or start with an underscore. An empty table gives no row;
    with fewer rows than shards some shards stay empty.
    """
    if bad := [c for c in df.columns if c in ("shard", "slot") or c.startswith("_")]:
        raise ValueError(f"rename the columns {bad}")
    content, place = F.xxhash64(*content_cols), F.monotonically_increasing_id()
    rows = df.select("*", F.coalesce(F.col(size_col), F.lit(0)).alias("_size"), content.alias("_k0"), place.alias("_row"))
    rows = materialize(rows.withColumn("_k1", F.xxhash64("_row")), "shard-rows")
    keys = splitters(rows.select("_size", *_KEYS), "_size", shards, tolerance)

    key = _prefix(KEY_BITS // STEP)
    shard = sum([F.when(key >= F.lit(k), 1).otherwise(0) for k in keys], F.lit(0))
    parts = workers(df)
    placed = rows.withColumn("shard", shard.cast("int")).withColumn(
        "_part", F.pmod("_k1", F.lit(parts)).cast("int")
    )
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_part").orderBy(*_KEYS, "_row"))
    numbered = placed.withColumn("_rank", rank - 1).join(offsets, ["shard", "_part"])
    return numbered.select(
        *[F.col(c) for c in df.columns], "shard", (F.col("_rank") + F.col("_before")).alias("slot")
    )
