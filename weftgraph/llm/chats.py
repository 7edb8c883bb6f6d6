"""Chat formatting with cumulative-snapshot collapse (operator 8).

Chat logs hold snapshots: a conversation is stored again each time it grows. Turns are ordered by
turn number; the rolling hash of a prefix is the running xor of hashes of (place, role, text),
two independent ones of 64 bits, one window for each conversation. A conversation whose whole
hash is a proper prefix of a longer one is left out by an anti-join; of conversations that are
equal turn by turn the smallest id stays. The maximal conversations are rendered.

No conversation meets another in a task: prefixes are aggregated (partial first) before the
anti-join, so one that a third of the logs share is one row of it.

Cases: null role counts as `user`, null text as empty; rows with a null conversation or turn take
no part. Turns of one number are ordered by role, then text; repeats of a whole row count once.
Only the named columns are read, so names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, role, text, p1, p2): turns in order with the rolling hashes of their prefixes."""
    t = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("conv is not null and turn is not null").distinct()
    w = Window.partitionBy("conv").orderBy("turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(w))
    so_far = Window.partitionBy("conv").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    for c, seed in (("p1", 1), ("p2", 2)):
        t = t.withColumn(c, F.bit_xor(F.xxhash64(F.lit(seed), "pos", "role", "text")).over(so_far))
    return t.select("conv", "pos", "role", "text", "p1", "p2")


def maximal(t: DataFrame) -> DataFrame:
    """(conv, n) of the conversations that no other extends; of equal ones the smallest id."""
    whole = t.groupBy("conv").agg(F.max(F.struct("pos", "p1", "p2")).alias("m")).select("conv", F.col("m.pos").alias("n"), "m.p1", "m.p2")
    whole = cut(whole, "whole")
    one = whole.groupBy("n", "p1", "p2").agg(F.min("conv").alias("conv"))
    inner = t.join(whole.select("conv", "n"), "conv").where("pos < n").select(F.col("pos").alias("n"), "p1", "p2").distinct()
    return one.join(inner, ["n", "p1", "p2"], "left_anti").select("conv", "n")


def render(t: DataFrame, kept: DataFrame, opening: str = OPEN, closing: str = CLOSE, escape: str = "") -> DataFrame:
    """(conv, n_turns, chat): each turn as <opening>role\\ntext<closing>\\n. `escape` is put after the first
    character of every opening or closing found in a role or text, so that no text can forge a turn;
    the empty default leaves texts as they are."""

    def safe(c):
        for mark in (opening, closing) if escape else ():
            c = F.replace(c, F.lit(mark), F.lit(mark[0] + escape + mark[1:]))
        return c

    line = F.concat(F.lit(opening), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(closing + "\n")).alias("line")
    rows = t.join(kept, "conv").select("conv", F.struct("pos", line).alias("s"))
    rows = rows.groupBy("conv").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return rows.select("conv", F.size("s").cast("long").alias("n_turns"), F.array_join("s.line", "").alias("chat"))


def collapse(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", escape: str = "") -> DataFrame:
    """(conv, n_turns, chat) of the maximal conversations; `escape` as in render."""
    t = cut(turns(rows, conv, turn, role, text), "turns")
    return render(t, cut(maximal(t), "maximal"), escape=escape).withColumnRenamed("conv", conv)
