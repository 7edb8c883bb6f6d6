"""Line-oriented sinks. Vertices without a label are left out rather than written as blank lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELIMITERS = {"comma": ",", "underscore": "_", "tab": "\t"}


def _write(lines: DataFrame, path: str, mode: str = "error") -> None:
    lines.write.mode(mode).text(path)


def label_lines(labels: DataFrame, delimiter: str = ",", value: str | None = None) -> DataFrame:
    """id<delimiter>part[<delimiter>value]."""
    cols = ["id", "part"] + ([value] if value else [])
    return labels.where("part is not null").select(F.concat_ws(delimiter, *[F.col(c).cast("string") for c in cols]).alias("line"))


def value_lines(values: DataFrame, value: str = "value", delimiter: str = "\t") -> DataFrame:
    """id<delimiter>value."""
    return values.select(F.concat_ws(delimiter, F.col("id").cast("string"), F.col(value).cast("string")).alias("line"))


def adjacency_lines(edges: DataFrame, vertices: DataFrame | None = None, labels: DataFrame | None = None, label_source: bool = False, label_targets: bool = False, real_only: bool = True, delimiter: str = "\t", skip_isolated: bool = False) -> DataFrame:
    """id[_part] and its neighbours [_part], ids in order. With vertices, those without neighbours
    are written too unless skip_isolated."""
    e = edges.where("not is_virtual") if real_only and "is_virtual" in edges.columns else edges
    e = e.select("src", "dst")
    lab = labels.select("id", "part") if labels is not None else None
    if label_targets:
        e = e.join(lab.select(F.col("id").alias("dst"), F.col("part").alias("dp")), "dst").select("src", "dst", F.concat_ws("_", F.col("dst").cast("string"), F.col("dp").cast("string")).alias("name"))
    else:
        e = e.select("src", "dst", F.col("dst").cast("string").alias("name"))
    rows = e.groupBy("src").agg(F.transform(F.sort_array(F.collect_list(F.struct("dst", "name"))), lambda x: x["name"]).alias("names"))
    if vertices is not None and not skip_isolated:
        rows = vertices.select(F.col("id").alias("src")).join(rows, "src", "left")
    head = F.col("src").cast("string")
    if label_source:
        rows = rows.join(lab.withColumnRenamed("id", "src"), "src")
        head = F.concat_ws("_", head, F.col("part").cast("string"))
    return rows.select(F.concat_ws(delimiter, head, F.array_join(F.coalesce("names", F.array().cast("array<string>")), delimiter)).alias("line")).select(F.regexp_replace("line", f"{delimiter}$", "").alias("line"))


def metis_lines(edges: DataFrame, header: bool = False) -> DataFrame:
    """Neighbour lists; with a header line of vertex and undirected edge counts first by sort order."""
    body = adjacency_lines(edges, skip_isolated=True)
    if not header:
        return body
    n = edges.agg(F.count_distinct("src"), F.count("*")).first()
    return edges.sparkSession.createDataFrame([(f"{n[0]} {n[1] // 2}",)], "line string").union(body)


def degree_lines(vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """id, part, out-degree, in-degree by tab."""
    return vertices.join(labels.select("id", "part"), "id").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("id", "part", "out_deg", "in_deg")]).alias("line"))


def write_labels(labels: DataFrame, path: str, delimiter: str = ",", value: str | None = None, mode: str = "error") -> None:
    _write(label_lines(labels, delimiter, value), path, mode)


def write_adjacency(edges: DataFrame, path: str, mode: str = "error", **kw) -> None:
    _write(adjacency_lines(edges, **kw), path, mode)


def write_values(values: DataFrame, path: str, value: str = "value", delimiter: str = "\t", mode: str = "error") -> None:
    _write(value_lines(values, value, delimiter), path, mode)


def write_nothing(vertices: DataFrame) -> None:
    """Runs the plan and keeps no output."""
    vertices.write.format("noop").mode("overwrite").save()


def write_metrics(spark, metrics: dict, path: str, mode: str = "error") -> None:
    """KEY,value lines in one file."""
    _write(spark.createDataFrame([(f"{k},{v}",) for k, v in metrics.items()], "line string").coalesce(1), path, mode)


def write_distribution(dist: DataFrame, path: str, mode: str = "error") -> None:
    """degree,count lines."""
    _write(dist.select(F.concat_ws(",", F.col("degree").cast("string"), F.col("n").cast("string")).alias("line")), path, mode)


def append_times(spark, row: list, path: str, delimiter: str = ",") -> None:
    _write(spark.createDataFrame([(delimiter.join(map(str, row)),)], "line string").coalesce(1), path, "append")


def edges_to_adjacency(edges: DataFrame, path: str, mode: str = "error") -> None:
    """Edge list to neighbour lists."""
    _write(adjacency_lines(edges, skip_isolated=True), path, mode)
