"""Chat formatting: conversations that a longer one continues collapse into it, with DataFrame functions only.

Logs often hold a conversation again and again, each time longer. Each turn has a digest of
its place, role and text, and the digest of a prefix is the sum of those of its turns, 124 bits
in four parts that can't overflow. A conversation whose digest is that of a proper prefix
of another is dropped by an anti-join; of equal ones the smallest id stays. Turns are numbered
in one order over all conversations and summed per block of places, so that a
conversation of any length is spread over tasks; nothing gathers a conversation in a row.

Each turn that stays is rendered as a row; in order of ``place`` the rows of a conversation make its text.

Defined cases: turns go by number, null first, then by a digest of role and text; rows that repeat
wholly are one turn; a null conversation id is one conversation, whose id ranks last; a null
role is rendered as ``unknown``, a null text as an empty one, though they differ from those in
comparisons; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import numbered
from tablesmith.session import stage

ROWS_PER_BLOCK = 1024
PARTS = ("p0", "p1", "p2", "p3")
# The marks around a turn.
OPENING, CLOSING = "<|im_start|>", "<|im_end|>"


def _digest(*columns: Column | str, seed: int) -> Column:
    """A digest that tells null from other values."""
    values = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(F.lit(seed), *values, *[v.isNull() for v in values])


def _parts() -> list[Column]:
    """The digest of a turn in four parts of 31 bits."""
    parts = []
    for seed in (1, 2):
        whole = _digest("place", "role", "text", seed=seed)
        parts += [whole.bitwiseAND((1 << 31) - 1), F.shiftrightunsigned(whole, 33)]
    return [p.alias(name) for p, name in zip(parts, PARTS)]


def maximal_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, place, n_turns, snapshots): the turns of conversations that none continues.

    ``snapshots`` is the number of equal conversations that the one stands for.
    """
    rows = turns.select("conv_id", "turn", "role", "text").distinct()
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_first(), _digest("role", "text", seed=0)]
    placed = stage(numbered(rows, order, "at").withColumn("block", F.floor(F.col("at") / ROWS_PER_BLOCK)), "turns")

    # a block holds few rows of a conversation, so what follows per block is small for long conversations
    cells = placed.groupBy("block", "conv_id").agg(F.min("at").alias("cell_start"))
    whole = cells.groupBy("conv_id").agg(F.min("cell_start").alias("start"))
    owner = F.col("conv_id").eqNullSafe(F.col("of"))
    starts = cells.join(whole.withColumnRenamed("conv_id", "of"), owner).select(F.col("block").alias("cell"), "start", "of")
    told = placed.join(starts, (F.col("block") == F.col("cell")) & owner).select(
        "block", "conv_id", "turn", "role", "text", "start", (F.col("at") - F.col("start")).alias("place")
    )
    digests = stage(told.select("block", "start", "conv_id", "place", *_parts()), "digests")

    sums = [F.sum(p).alias(p) for p in PARTS]
    finals = digests.groupBy("start").agg(F.first("conv_id").alias("conv_id"), F.count("*").alias("n"), *sums)
    classes = finals.groupBy("n", *PARTS).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "start")).alias("first"), F.count("*").alias("snapshots"))

    in_cell = Window.partitionBy("block", "start").orderBy("place")
    before_cell = Window.partitionBy("start").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = digests.groupBy("block", "start").agg(*sums)
    carried = totals.select("block", "start", *[F.coalesce(F.sum(p).over(before_cell), F.lit(0)).alias(f"c_{p}") for p in PARTS])
    carried = carried.join(finals.select("start", F.col("n").alias("whole")), "start")
    running = digests.select("block", "start", "place", *[F.sum(p).over(in_cell).alias(p) for p in PARTS]).join(carried, ["block", "start"])
    prefixes = running.where(F.col("place") + 1 < F.col("whole")).select(
        (F.col("place") + 1).alias("n"), *[(F.col(p) + F.col(f"c_{p}")).alias(p) for p in PARTS]
    )
    kept = classes.join(prefixes.distinct(), ["n", *PARTS], "left_anti").select(F.col("first.start").alias("start"), F.col("n").alias("n_turns"), "snapshots")
    cells_kept = starts.select(F.col("cell").alias("block"), "start").join(kept, "start")
    return told.join(cells_kept, ["block", "start"]).select("conv_id", "turn", "role", "text", "place", "n_turns", "snapshots")


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, snapshots, rendered) of the maximal conversations, a row per turn."""
    text = F.concat(
        F.lit(OPENING), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSING + "\n")
    )
    return maximal_turns(turns).select("conv_id", "place", "n_turns", "snapshots", text.alias("rendered"))
