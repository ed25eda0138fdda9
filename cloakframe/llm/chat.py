"""Chat formatting with cumulative-snapshot collapse.

A chat log often holds the same conversation again and again, each time with some
more turns. A rolling hash is kept over the turns of every conversation: after
turn i it stands for the first i turns, their roles, texts and order. A
conversation that is equal to the first turns of a longer one is a snapshot of it:
its last hash is among the hashes that other conversations go on from, and an
anti-join drops it. Of equal conversations the one with the smallest identifier
stays. What is left is rendered turn by turn.

The rolling hash is a sum over turns of hashes of (position, role, text), kept in
four parts of 32 bits. Sums can be taken per block of turns and added up, so a
conversation with very many turns is dealt over many tasks (see ``blocks``), and
the hash before a turn is the hash after it less the turn's own part. Hashes are
aggregated before they are joined; however many logs share a first turn, it is one
row.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.blocks import BLOCK, ROW, attach, handed_on, inside, ordered_blocks
from cloakframe.llm.common import materialize
from cloakframe.runtime import small_side

_PARTS = ["_h0", "_h1", "_h2", "_h3"]
START, END = "<|im_start|>", "<|im_end|>\n"


def render(role: str, text: str) -> Column:
    """One turn as marked text; a null role is empty, as is a null text."""
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls among them; those of ``right`` have the prefix ``_k``."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[f"_k{k}"]) for k in keys])


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k{k}") for k in keys], *[c for c in df.columns if c not in keys])


def conversation_blocks(rows: DataFrame) -> DataFrame:
    """Per (conv_id, block) of arranged turns: ``_shift``, by which a turn's position
    is more than its ``_row``."""
    starts = rows.groupBy("conv_id", BLOCK).agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 - F.col("_first")
    return starts.select("conv_id", BLOCK, shift.alias("_shift"))


def turn_hashes(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """(conv_id, _pos, hashes) of arranged turns; texts stay where they are.

    ``_pos`` counts from 1. ``_h0`` to ``_h3``: after the turn; ``_b0`` to
    ``_b3``: before it.
    """
    said = [F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    narrow = rows.select("conv_id", BLOCK, ROW, F.xxhash64(F.lit(1), *said).alias("_x"), F.xxhash64(F.lit(2), *said).alias("_y"))
    placed = attach(narrow, starts, ["conv_id"]).withColumn("_pos", F.col(ROW) + F.col("_shift"))
    first, second = F.xxhash64(F.lit(1), "_pos", "_x", "_y"), F.xxhash64(F.lit(2), "_pos", "_y", "_x")
    low = F.lit(0xFFFFFFFF)
    parts = [F.shiftrightunsigned(first, 32), first.bitwiseAND(low), F.shiftrightunsigned(second, 32), second.bitwiseAND(low)]
    terms = [p.alias(f"_t{i}") for i, p in enumerate(parts)]
    turns = materialize(placed.select("conv_id", BLOCK, ROW, "_pos", *terms), "turn-terms")
    sums = handed_on(turns, ["conv_id"], {f"_e{i}": F.sum(f"_t{i}") for i in range(4)}, "turn-sums")
    window = inside(["conv_id"], [])
    running = [(F.sum(f"_t{i}").over(window) + F.col(f"_e{i}")).alias(h) for i, h in enumerate(_PARTS)]
    hashed = attach(turns, sums, ["conv_id"]).select("conv_id", "_pos", *running, *[f"_t{i}" for i in range(4)])
    return hashed.select("conv_id", "_pos", *_PARTS, *[(F.col(h) - F.col(f"_t{i}")).alias(f"_b{i}") for i, h in enumerate(_PARTS)])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """The turns of conversations that are no snapshot of another, with ``position``.

    ``turns`` has conv_id, turn, role and text; other columns are left out. Turns
    are ordered by (turn, role, text), nulls first; position counts from 1. Equal
    conversations are one, under the smallest identifier that is not null; rows
    with a null identifier are one conversation. An empty table gives no row.

    Texts are written once, arranged, and read once more at the end; only hashes,
    positions and row numbers go through the steps between.
    """
    rows = ordered_blocks(
        turns.select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn", "role", "text"], "turns", arranged=True
    )
    starts = materialize(conversation_blocks(rows), "turn-starts")
    hashed = materialize(turn_hashes(rows, starts), "turn-hashes")
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("_pos", *_PARTS)).alias("end"))
    ends = ends.select("conv_id", F.col("end._pos").alias("_pos"), *[F.col(f"end.{h}").alias(h) for h in _PARTS])
    one = ends.groupBy("_pos", *_PARTS).agg(F.min("conv_id").alias("conv_id"))
    before = [F.col(f"_b{i}").alias(h) for i, h in enumerate(_PARTS)]
    gone_on = hashed.where("_pos > 1").select((F.col("_pos") - 1).alias("_pos"), *before).distinct()
    kept = _renamed(one.join(gone_on, ["_pos", *_PARTS], "left_anti").select("conv_id"), ["conv_id"])
    held = materialize(starts.join(kept, _same(starts, kept, ["conv_id"]), "left_semi"), "kept-starts")
    keys = ["conv_id", BLOCK]
    side = _renamed(held, keys)
    found = rows.join(small_side(side, held.count(), 64), _same(rows, side, keys))
    return found.select("conv_id", (F.col(ROW) + F.col("_shift")).cast("int").alias("position"), "turn", "role", "text")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, position, rendered) of every turn of every maximal conversation.

    Joined in the order of position, the rendered turns are the conversation's
    text; they are left as rows, because a conversation may exceed any one row.
    """
    kept = maximal_conversations(turns)
    return kept.select("conv_id", "position", render(F.col("role"), F.col("text")).alias("rendered"))
