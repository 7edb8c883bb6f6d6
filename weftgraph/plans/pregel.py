"""Generic superstep loop over Column expressions; no Python rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.loops import cut


def pregel(vertices: DataFrame, edges: DataFrame, message, combine: Callable, update, max_steps: int = 100, halt: Callable | None = None, cut_every: int = 1) -> DataFrame:
    """vertices(id, value); edges(src, dst, ...). Each step: message (over value and the edge columns)
    of the active sources, combined by `combine` (F.min, F.sum, ...) into msg for dst; `update` (over
    value and msg) gives the new value. Only vertices whose value changed send next; ends when none
    did, after max_steps, or when halt(step, changed) is true. Undeclared targets take no part."""
    v = cut(vertices.select("id", "value", F.lit(True).alias("changed")), "vertices")
    e = edges.repartition("src").persist()
    try:
        for step in range(max_steps):
            sent = e.join(v.where("changed").select(F.col("id").alias("src"), "value"), "src").select("dst", message.alias("m")).where("m is not null")
            got = sent.groupBy("dst").agg(combine("m").alias("msg"))
            new = v.join(got, v["id"] == got["dst"], "left").withColumn("new", F.when(F.col("msg").isNull(), F.col("value")).otherwise(update))
            new = new.select("id", F.col("new").alias("value"), (~F.col("new").eqNullSafe(F.col("value"))).alias("changed"))
            v = cut(new, "vertices") if (step + 1) % cut_every == 0 else new
            changed = v.where("changed").count()
            if not changed or (halt and halt(step, changed)):
                break
        return v.select("id", "value")
    finally:
        e.unpersist()
