"""Cutting lineage in iterative jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame

ROW_GROUP = 8 << 20  # bytes


def shared_dir(spark) -> str:
    """spark.checkpoint.dir where the cluster names one, else, on a local master only, a folder under the temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "weftgraph-shared")


def _home(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/weft-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, survives lost executors.
    A task holds a row group in memory, when it writes and when it reads."""
    spark = df.sparkSession
    path = f"{_home(spark)}/{uuid.uuid4().hex}-{name}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def _delete(spark, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing will read again."""
    for t in tables:
        if path := getattr(t, "_weft_path", None):
            _delete(t.sparkSession, path)


def clear(spark) -> None:
    """Delete every table that cut() wrote in this application; call it when the results are stored."""
    _delete(spark, _home(spark))
