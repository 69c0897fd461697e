"""Chat formatting with cumulative-snapshot collapse.

Logs hold a conversation again each time it grew. A rolling hash over a conversation's turns names every prefix: the running
exclusive-or of two 64-bit hashes of place, role and text. A conversation whose whole hash is a proper prefix of another is a
snapshot of it; an anti-join on the hash keeps the others, and of equal ones the one with the least identifier. Only
those are rendered.

Results: turns are rendered and hashed in order of `turn`, then role and text; repeated rows are turns of their own. A null role is rendered as
`unknown`, a null text as empty; null and empty differ as little in the hash. A null identifier is a conversation of its own.
An empty table gives no rows. Conversations have a turn at least, as they are made of rows. Other columns aren't returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import col, materialise

#: What opens and closes a rendered turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: The role of a turn without one.
UNKNOWN = "unknown"


def prefixes(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 1), turns, and the rolling hashes h1 and h2 of the prefix that ends there."""
    rows = df.select(
        col(conv).alias("conv"),
        col(turn).alias("turn"),
        F.coalesce(col(role), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(col(role), F.lit(UNKNOWN)), F.coalesce(col(text), F.lit(""))).alias("a"),
        F.xxhash64(F.lit("second"), F.coalesce(col(text), F.lit("")), F.coalesce(col(role), F.lit(UNKNOWN))).alias("b"),
    )
    own = Window.partitionBy("conv")
    order = own.orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("turns", F.count("*").over(own))
    return rows.select(
        "conv",
        "place",
        "turns",
        F.bit_xor(F.xxhash64("place", "a")).over(upto).alias("h1"),
        F.bit_xor(F.xxhash64("b", "place")).over(upto).alias("h2"),
    )


def maximal(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n_turns, n_copies, n_snapshots of the conversations that no other one continues.

    n_snapshots counts the conversations, copies included, that are proper prefixes of this one; a prefix of several counts for each.
    """
    every = materialise(prefixes(df, conv, turn, role, text), "prefixes")
    name = ["place", "h1", "h2"]
    # Both sides are summed up by hash first, so a conversation or a first turn that is everywhere is one row of the join.
    whole = every.where("place = turns").groupBy(*name).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    proper = every.where("place < turns").groupBy(*name).agg(F.count("*").alias("n_longer"))
    kept = whole.join(proper, name, "left_anti")
    # Only prefixes that are somebody's whole conversation meet; a copy of a kept one isn't looked at again.
    stops = whole.join(proper, name, "left_semi").select(*name, F.col("n_copies").alias("n"))
    inside = every.where("place < turns").join(kept.select(F.col("conv").alias("of")), F.col("conv").eqNullSafe(F.col("of")), "left_semi")
    absorbed = inside.join(stops, name).groupBy(F.col("conv").alias("of")).agg(F.sum("n").alias("n_snapshots"))
    found = kept.join(absorbed, F.col("conv").eqNullSafe(F.col("of")), "left")
    return found.select("conv", F.col("place").cast("long").alias("n_turns"), "n_copies", F.coalesce("n_snapshots", F.lit(0)).cast("long").alias("n_snapshots"))


def render(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each maximal conversation: its identifier, n_turns, n_copies, n_snapshots and the rendered chat."""
    kept = maximal(df, conv, turn, role, text).withColumnRenamed("conv", "of")
    rows = df.select(
        col(conv).alias("conv"), col(turn).alias("turn"), F.coalesce(col(role), F.lit(UNKNOWN)).alias("role"), F.coalesce(col(text), F.lit("")).alias("text")
    ).join(kept, F.col("conv").eqNullSafe(F.col("of")))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    chats = rows.groupBy("of", "n_turns", "n_copies", "n_snapshots").agg(turns.alias("turns"))
    line = F.transform("turns", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE)))
    return chats.select(F.col("of").alias(conv), "n_turns", "n_copies", "n_snapshots", F.array_join(line, "").alias("chat"))
