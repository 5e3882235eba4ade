"""Chat formatting with cumulative-snapshot collapse; DataFrame functions only.

Chat logs often hold a conversation again and again as it grew. Every turn gets a hash of all turns up to it (a rolling
exclusive-or of two 64-bit hashes salted with the position). A conversation whose last hash is that of an inner turn of
another one is a prefix of it; an anti-join leaves the maximal ones, of equal ones the smallest id, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit(2), text, role).alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv, n_turns, copies: the conversations that are no proper prefix of another; `copies` counts equal ones."""
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "h1", "h2")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv")
    placed = turns.select("conv", "turn", "h1", "h2").withColumn("n", F.row_number().over(order)).withColumn("total", F.count("*").over(whole))
    rolled = placed.select("conv", "n", "total", *[F.bit_xor(F.xxhash64("n", h)).over(upto).alias(p) for h, p in (("h1", "p1"), ("h2", "p2"))])
    inner = rolled.where("n < total").groupBy("n", "p1", "p2").agg(F.lit(True).alias("inner"))
    last = rolled.where("n = total").groupBy("n", "p1", "p2").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    return last.join(inner, ["n", "p1", "p2"], "left_anti").select("conv", F.col("n").cast("long").alias("n_turns"), "copies")


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", start: str = "<|", end: str = "|>\n", stop: str = "<|end|>\n") -> DataFrame:
    """conv_id, n_turns, copies, rendered for every maximal conversation.

    Turns are rendered in the order of `turn` (null last; ties in the order of a hash of role and text) as start, role,
    end, text, stop. Null role and text count as empty. Rows without a conv_id form one conversation. A repeated row is
    a turn of its own. Other columns are ignored; an empty table gives an empty result. A conversation becomes one row,
    so its turns must fit in one.
    """
    turns = _turns(df, conv_col, turn_col, role_col, text_col)
    kept = maximal_conversations(turns).withColumnRenamed("conv", "kept")
    shown = turns.join(kept, F.col("conv").eqNullSafe(F.col("kept"))).drop("kept")
    line = F.concat(F.lit(start), "role", F.lit(end), "text", F.lit(stop))
    entry = F.struct(F.col("turn").isNull().alias("a"), F.col("turn").alias("b"), "h1", "h2", line.alias("line"))
    per = shown.groupBy("conv", "n_turns", "copies").agg(F.sort_array(F.collect_list(entry)).alias("lines"))
    return per.select(F.col("conv").alias(conv_col), "n_turns", "copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))
