"""Line-oriented graph readers, generators, source sets and run collators.

One reader with a table of layouts. Lines are split natively; malformed numbers raise, as ANSI
casts do. A line without the optional part has a null part (never that of the line before).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK, CTRL, TAB = "[\t ]", "[\x01\t ]", "\t"


@dataclass(frozen=True)
class Layout:
    """kind: adjacency, edges or labels. part: none, optional or required `_part` of the source id;
    both: targets have one too. weight: constant, `optional:<default>`, `required` or None."""

    kind: str
    sep: str = BLANK
    part: str = "none"
    both: bool = False
    weight: str | float | int | None = None
    weight_type: str = "double"
    value: float | int | None = None
    virtual: bool = False
    ids: str = "long"
    reverse: bool = False


LAYOUTS: dict[str, Layout] = {
    "int_adjacency": Layout("adjacency", weight=2, weight_type="int"),
    "long_adjacency": Layout("adjacency", weight=2, weight_type="int"),
    "default_adjacency": Layout("adjacency", weight=1, weight_type="int", virtual=True),
    "part_ids": Layout("labels", part="optional"),
    "part_ids_only": Layout("labels", part="optional"),
    "part_adjacency": Layout("adjacency", part="required", both=True, weight=1.0, value=0.0),
    "part_source_adjacency": Layout("adjacency", part="optional", weight=1.0),
    "triangle_input": Layout("adjacency", part="required", both=True, weight=1.0),
    "labels_tab": Layout("labels", sep=TAB),
    "labels_ctrl": Layout("labels", sep=CTRL),
    "edges_byte": Layout("edges", sep=CTRL, weight="optional:1", weight_type="int"),
    "edges_tab_part": Layout("edges", sep=TAB, part="optional", both=True),
    "edges_part_double": Layout("edges", part="optional", both=True, weight="optional:0.0"),
    "edges_double": Layout("edges", weight="optional:0.0"),
    "edges_required": Layout("edges", weight="required"),
    "edges_zero": Layout("edges", weight=0.0),
    "edges_zero_reverse": Layout("edges", weight=0.0, reverse=True),
    "edges_tab": Layout("edges", sep=TAB),
    "edges_tab_reverse": Layout("edges", sep=TAB, reverse=True),
    "edges_text": Layout("edges", ids="string"),
    "adjacency_float": Layout("adjacency", weight=1.0, weight_type="float", value=1.0),
    "adjacency_double": Layout("adjacency", weight=1.0, value=1.0),
    "adjacency_long": Layout("adjacency", weight=1.0, value=0),
    "adjacency_plain": Layout("adjacency", value=1.0),
    "quality_input": Layout("adjacency", part="required", weight=2, weight_type="int"),
}


def _id(token, lay: Layout):
    """(id, part) columns of a token."""
    if lay.part == "none":
        return token.cast(lay.ids), F.lit(None).cast("int")
    bits = F.split(token, "_")
    part = F.get(bits, 1).cast("int") if lay.part == "optional" else F.element_at(bits, 2).cast("int")
    return F.get(bits, 0).cast(lay.ids), part


def read_graph(spark: SparkSession, path, layout: str | Layout = "long_adjacency") -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of text files. vertices(id, part, value, declared), edges(src, dst, w, is_virtual
    [, src_part, dst_part]); of repeated pairs the last one read stays, blank lines are no records."""
    lay = LAYOUTS[layout] if isinstance(layout, str) else layout
    t = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.split("value", lay.sep).alias("t"), F.monotonically_increasing_id().alias("at"))
    value = F.lit(lay.value)
    if lay.kind == "labels":
        if lay.part == "none":
            v = t.select(F.get("t", 0).cast(lay.ids).alias("id"), F.nullif(F.get("t", 1), F.lit("")).cast("int").alias("part"))
        else:
            i, p = _id(F.get("t", 0), lay)
            v = t.select(i.alias("id"), p.alias("part"))
        e = spark.createDataFrame([], f"src {lay.ids}, dst {lay.ids}, w {lay.weight_type}, is_virtual boolean")
        return v.select("id", "part", value.alias("value"), F.lit(True).alias("declared")), e
    i, p = _id(F.get("t", 0), lay)
    if lay.kind == "adjacency":
        v = t.select(i.alias("id"), p.alias("part"), value.alias("value"), F.lit(True).alias("declared"))
        rows = t.select("at", i.alias("src"), p.alias("src_part"), F.explode(F.filter(F.slice("t", 2, 2**31 - 2), lambda x: x != "")).alias("d"))
        w = F.lit(lay.weight).cast(lay.weight_type)
    else:
        if isinstance(lay.weight, str) and lay.weight.startswith("optional:"):
            w = F.coalesce(F.nullif(F.get("t", 2), F.lit("")).cast(lay.weight_type), F.lit(lay.weight.split(":")[1]).cast(lay.weight_type))
        elif lay.weight == "required":
            w = F.element_at("t", 3).cast(lay.weight_type)  # an error where it is absent
        else:
            w = F.lit(lay.weight).cast(lay.weight_type)
        rows = t.select("at", i.alias("src"), p.alias("src_part"), F.element_at("t", 2).alias("d"), w.alias("w0"))
        w = F.col("w0")
    d, dp = _id(F.col("d"), lay if lay.both else Layout("edges", ids=lay.ids))
    e = rows.select("src", d.alias("dst"), w.alias("w"), F.lit(lay.virtual).alias("is_virtual"), "src_part", dp.alias("dst_part"), "at")
    if lay.reverse:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "is_virtual", F.col("dst_part").alias("src_part"), F.col("src_part").alias("dst_part"), "at"))
    kept = F.max(F.struct("at", "w", "is_virtual", "src_part", "dst_part")).alias("k")
    e = e.groupBy("src", "dst").agg(kept).select("src", "dst", "k.w", "k.is_virtual", "k.src_part", "k.dst_part")
    if lay.kind == "edges":
        v = e.select(F.col("src").alias("id"), F.col("src_part").alias("part")).groupBy("id").agg(F.max("part").alias("part"))
        v = v.select("id", "part", value.alias("value"), F.lit(True).alias("declared"))
    if lay.part == "none":
        e = e.drop("src_part", "dst_part")
    return v, e


def ring(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """Vertex i of value 10 i; edge to (i + 1) mod n of weight 100 i."""
    r = spark.range(n)
    return r.select("id", (F.col("id") * 10.0).alias("value")), r.select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), (F.col("id") * 100.0).cast("float").alias("w"))


def generated(spark: SparkSession, n: int = 10, splits: int = 1, reverse: bool = False) -> DataFrame:
    """n records for each split, optionally in falling order of id."""
    r = spark.range(0, n * splits, 1, splits)
    return r.select((F.lit(n * splits - 1) - F.col("id")).alias("id")) if reverse else r


def generated_edges(spark: SparkSession, n: int = 10, splits: int = 1, reverse: bool = False) -> DataFrame:
    """n edges for each split, from i to i + 1, the last one back to 0; optionally in falling order of i."""
    r = generated(spark, n, splits, reverse)
    return r.select(F.col("id").alias("src"), ((F.col("id") + 1) % F.lit(n * splits)).alias("dst"))


def sources(spark: SparkSession, one: int | None = None, path: str | None = None) -> DataFrame:
    """A set of ids: one id, else a file with an id a line, else none."""
    if one is not None:
        return spark.createDataFrame([(one,)], "id long")
    if path:
        return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").cast("long").alias("id")).distinct()
    return spark.createDataFrame([], "id long")


def run_metrics(spark: SparkSession, path: str, skip: str = "GDD") -> DataFrame:
    """(file, key, value, at) of KEY,value files, `at` in the order of lines; files with `skip` in their name are left out."""
    t = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    bits = F.split("value", ",", 2)
    return t.where(~F.contains("file", F.lit(skip)) & F.contains("value", F.lit(","))).select("file", F.trim(F.get(bits, 0)).alias("key"), F.trim(F.get(bits, 1)).alias("value"), "at")


def collate(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row a file, one column a key; keys match exactly, the last value in order wins."""
    return metrics.where(F.col("key").isin(keys)).groupBy("file").pivot("key", keys).agg(F.max_by("value", "at"))


def job_logs(spark: SparkSession, path: str, counters: list[str]) -> DataFrame:
    """One row a log: its `-ca key=value` arguments as a map and the named `name=number` counters."""
    t = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    args = F.regexp_extract_all("value", F.lit(r"-ca\s+([\w.]+=[^\s,]+)"), 1)
    pairs = F.map_from_entries(F.transform(F.array_distinct(args), lambda x: F.struct(F.get(F.split(x, "=", 2), 0), F.get(F.split(x, "=", 2), 1))))
    return t.select("file", pairs.alias("args"), *[F.nullif(F.regexp_extract("value", rf"{c}\s*[=:]\s*(\d+)", 1), F.lit("")).cast("long").alias(c) for c in counters])
