"""Property graph as two DataFrames: vertices and symmetrised edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_dedup(edges: DataFrame) -> DataFrame:
    """(src, dst) once for each pair; null ends drop out."""
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null").distinct()


def symmetrize(edges: DataFrame, weight: int = 1) -> DataFrame:
    """Real edges with `weight` plus a virtual edge (weight 1) where the reverse is missing.

    One aggregation over both directions takes the place of an anti-join: a pair is real if any
    of its rows is."""
    both = edges.select("src", "dst", F.lit(1).alias("real")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("real")))
    out = both.groupBy("src", "dst").agg(F.max("real").alias("real"))
    return out.select("src", "dst", (F.col("real") == 0).alias("is_virtual"), F.when(F.col("real") == 1, weight).otherwise(1).cast("int").alias("weight"))


def symmetrize_weighted(edges: DataFrame, directed: bool = True) -> DataFrame:
    """As symmetrize, but a reciprocated edge of a directed graph weighs 2."""
    both = edges.select("src", "dst", F.lit(1).alias("out"), F.lit(0).alias("back")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("out"), F.lit(1).alias("back")))
    out = both.groupBy("src", "dst").agg(F.max("out").alias("out"), F.max("back").alias("back"))
    two = (F.col("out") == 1) & (F.col("back") == 1) & F.lit(directed)
    return out.select("src", "dst", (F.col("out") == 0).alias("is_virtual"), F.when(two, 2).otherwise(1).cast("int").alias("weight"))


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, out_deg, in_deg, sym_deg, declared): sources and listed vertices are declared,
    targets that nothing declares become vertices too. One pass over both ends of each edge."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    pair = ends.groupBy("id", "other").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    out = pair.groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"), F.count("*").alias("sym_deg"))
    if vertices is not None:
        listed = vertices.select(F.col("id").cast("long").alias("id"), F.lit(True).alias("listed")).where("id is not null").distinct()
        out = out.join(listed, "id", "full")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_deg", "in_deg", "sym_deg")]
        return out.select("id", *zero, (F.coalesce("listed", F.lit(False)) | (F.coalesce("out_deg", F.lit(0)) > 0)).alias("declared"))
    return out.select("id", "out_deg", "in_deg", "sym_deg", (F.col("out_deg") > 0).alias("declared"))


def counts(edges: DataFrame) -> DataFrame:
    """(n_vertices, n_declared, n_edges)."""
    d = degrees(edges)
    return d.agg(F.count("*").alias("n_vertices"), F.sum(F.col("declared").cast("long")).alias("n_declared"), F.sum("out_deg").alias("n_edges"))


def outdegree_hist(edges: DataFrame, cap: int = 100) -> DataFrame:
    return degrees(edges).groupBy(F.least("out_deg", F.lit(cap)).alias("bucket")).agg(F.count("*").alias("n"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy((F.col("out_deg") + F.col("in_deg")).alias("degree")).agg(F.count("*").alias("n"))


def reverse_union(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def pairs(edges: DataFrame) -> DataFrame:
    """(a, b, there, back) once for each two ends, a <= b: whether a -> b and whether b -> a is an edge. What is shuffled
    stands for both directions; repeated edges and null ends drop out."""
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.expr("max(src <= dst) AS there"), F.expr("max(src >= dst) AS back"))


@dataclass
class Graph:
    """V(id, out_deg, in_deg, sym_deg, declared), A(src, dst, is_virtual, weight), E(src, dst).
    raw: the edges as they came, where an operator may prepare them in its own way; weight: of real edges then."""

    V: DataFrame
    A: DataFrame
    E: DataFrame
    raw: DataFrame | None = None
    weight: int = 1

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None, weight: int = 1) -> Graph:
        e = edge_dedup(edges)
        return cls(degrees(e, vertices), symmetrize(e, weight), e)

    @classmethod
    def of_raw(cls, edges: DataFrame, weight: int = 1) -> Graph:
        """The same graph, nothing of it written or computed yet."""
        g = cls.of(edges, weight=weight)
        return cls(g.V, g.A, g.E, edges, weight)

    @classmethod
    def of_pairs(cls, p: DataFrame, weight: int = 1) -> Graph:
        """The same graph over the rows of pairs(), a written table: no edge is shuffled, V is a sum by vertex."""
        ends = p.selectExpr("inline(CASE WHEN a = b THEN array(struct(a AS src, b AS dst, there AS o, back AS i)) ELSE array(struct(a AS src, b AS dst, there AS o, back AS i), struct(b AS src, a AS dst, back AS o, there AS i)) END)")
        v = ends.groupBy(F.col("src").alias("id")).agg(F.count_if("o").alias("out_deg"), F.count_if("i").alias("in_deg"), F.count("*").alias("sym_deg"))
        a = ends.select("src", "dst", (~F.col("o")).alias("is_virtual"), F.when(F.col("o"), weight).otherwise(1).cast("int").alias("weight"))
        return cls(v.withColumn("declared", F.col("out_deg") > 0), a, ends.where("o").select("src", "dst"))


def from_tables(spark: SparkSession, sf_dir: str, name: str = "ps", once: bool = True) -> DataFrame:
    """Edges of a graph over the star schema: ps (part, supplier), cp (customer, part), chain
    (parts of an order in turn), uu (users in turn). once: each edge once, else as often as the tables have it, null ends too."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    far = F.lit(1_000_000_000).cast("long")
    if name == "ps":
        out = read("lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + far).alias("dst"))
    elif name == "cp":
        out = read("orders").join(read("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + far).alias("dst"))
    elif name == "chain":
        from pyspark.sql import Window

        w = Window.partitionBy("l_orderkey").orderBy("l_partkey")
        li = read("lineitem").select("l_orderkey", "l_partkey").repartition("l_orderkey").distinct()  # one shuffle, the window's
        out = li.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    elif name == "uu":
        from .operators.windows import global_lead

        out = global_lead(read("events").select("ts", "event_id", F.col("user_id").alias("src")), ["ts", "event_id"], "src", "dst").select("src", "dst").where("src <> dst")
    else:
        raise ValueError(f"no graph named {name}")
    return edge_dedup(out) if once else out


SQL = {  # the same graphs for DuckDB
    "ps": "SELECT DISTINCT l_partkey AS src, l_suppkey + 1000000000 AS dst FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL",
    "cp": "SELECT DISTINCT o_custkey AS src, l_partkey + 1000000000 AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "chain": "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS dst FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) WHERE dst IS NOT NULL",
    "uu": "SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst",
}
