"""Placement of vertices and edges over tasks, by hash or by label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_hash(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """n hash partitions and a label pmod(id, n), never negative."""
    return df.repartition(n, id_col).withColumn("part", F.pmod(F.col(id_col), F.lit(n)).cast("int"))


def by_label(df: DataFrame, workers: int, part_col: str = "part") -> DataFrame:
    """Rows of one label in one of `workers` partitions; labels are taken modulo workers."""
    return df.repartition(workers, F.pmod(F.abs(F.col(part_col)), F.lit(workers)))
