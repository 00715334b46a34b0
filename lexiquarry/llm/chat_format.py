"""Chat rendering after collapsing cumulative snapshots.

Logs often hold a conversation once per turn, each time with all turns so far. Rolling
hashes of turn prefixes find them: a conversation whose whole hash is a proper prefix hash
of another one is a snapshot, and an anti-join leaves the maximal conversations.

The prefix hash is an exclusive-or of hashes of (position, role, text), so it is computed
in two levels (within blocks of turns, then over the blocks' totals); a conversation with
a large share of all turns is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Turns in a block of the prefix scan, and in one rendered part.
BLOCK_TURNS = 64


def _content(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def numbered_turns(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Turns with their block, their number ``at`` in it and two hashes of role and text."""
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn("block", F.floor(F.col("turn") / block_turns))
    within = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    return turns.withColumn("at", F.row_number().over(within)).withColumns({"t1": _content(1), "t2": _content(2)})


def block_offsets(turns: DataFrame) -> DataFrame:
    """``(conv_id, block, before, n)``: turns before a block and in the whole conversation."""
    over = Window.partitionBy("conv_id").orderBy("block")
    sizes = turns.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("m"))
    return sizes.select(
        "conv_id", "block", (F.sum("m").over(over) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy("conv_id")).alias("n")
    )


def _same_block() -> Column:
    return F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & F.col("l.block").eqNullSafe(F.col("r.block"))


def turn_prefixes(turns: DataFrame, offsets: DataFrame) -> DataFrame:
    """``(conv_id, pos, n, p1, p2)``: for every turn its position (1, 2, ...), the number of
    turns of its conversation and two 64-bit hashes of the turns up to it. Texts take no
    part beyond their hashes."""
    hashed = (
        turns.select("conv_id", "block", "at", "t1", "t2")
        .alias("l")
        .join(offsets.alias("r"), _same_block())
        .select("l.conv_id", "l.block", (F.col("at") + F.col("before")).alias("pos"), "n", "t1", "t2")
        .withColumns({"h1": F.xxhash64("pos", "t1"), "h2": F.xxhash64("t2", "pos")})
    )
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = hashed.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    carry = carry.select("conv_id", "block", *(F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)))
    running = hashed.withColumn("r1", F.bit_xor("h1").over(upto)).withColumn("r2", F.bit_xor("h2").over(upto))
    return (
        running.alias("l").join(carry.alias("r"), _same_block()).select("l.conv_id", "pos", "n", F.expr("r1 ^ c1").alias("p1"), F.expr("r2 ^ c2").alias("p2"))
    )


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """Ids of the conversations that are no prefix of another; of equal ones the least id."""
    ends = prefixes.where("pos = n").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("pos < n").select("pos", "p1", "p2").distinct()
    return ends.join(proper, ["pos", "p1", "p2"], "left_anti").select("conv_id")


def format_chats(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Rendered maximal conversations: ``(conv_id, part, n_turns, chat)``.

    Turns are ordered by turn, then role, then text. A part holds up to ``block_turns``
    turns, so an ordinary conversation is one row, and the parts of a long one in order
    make the whole. A turn is ``<|role|>``, newline, text, ``<|end|>``, newline.

    Null text renders as empty, null role as ``unknown``; null turns come first; turns
    with a null conv_id are one conversation without an id and are left out. Repeated rows
    are turns of their own. An empty table gives an empty result; other columns are
    ignored.
    """
    turns = materialise(numbered_turns(conversations.where(F.col("conv_id").isNotNull()), block_turns))
    offsets = materialise(block_offsets(turns))
    kept = maximal_conversations(materialise(turn_prefixes(turns, offsets)))
    placed = turns.alias("l").join(offsets.alias("r"), _same_block())
    placed = placed.select("l.conv_id", (F.col("at") + F.col("before")).alias("pos"), "role", "text").join(kept, "conv_id", "left_semi")
    piece = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    return (
        placed.select("conv_id", F.floor((F.col("pos") - 1) / block_turns).alias("part"), F.struct("pos", piece.alias("piece")).alias("t"))
        .groupBy("conv_id", "part")
        .agg(F.count(F.lit(1)).alias("n_turns"), F.array_join(F.expr("transform(sort_array(collect_list(t)), x -> x.piece)"), "").alias("chat"))
    )
