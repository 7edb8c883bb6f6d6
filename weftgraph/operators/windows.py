"""Window helpers that do not send a table to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.loops import cut


def global_lead(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """lead(value) over the whole table: rows are range-partitioned by the order columns, lead runs
    within each partition, and the first value of each next partition closes the gaps."""
    parts = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")  # once: both readers see one numbering
    w = Window.partitionBy("_p").orderBy(*order)
    inner = parts.withColumn(out, F.lead(value).over(w)).withColumn("_last", F.row_number().over(Window.partitionBy("_p").orderBy(*[F.desc(c) for c in order])) == 1)
    heads = parts.groupBy("_p").agg(F.min_by(value, F.struct(*order)).alias("_head")).select("_p", "_head")
    # one row a partition: a small, bounded table
    nxt = heads.select(F.col("_p").alias("_q"), F.lead("_head").over(Window.orderBy("_p")).alias("_next"))
    both = inner.join(F.broadcast(nxt), F.col("_p") == F.col("_q"), "left")
    return both.withColumn(out, F.when(F.col("_last"), F.col("_next")).otherwise(F.col(out))).drop("_p", "_q", "_last", "_next")
