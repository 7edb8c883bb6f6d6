"""Quality of a partitioning: one label join, two group-bys; all metrics from k rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph


def per_vertex(g: Graph, labels: DataFrame) -> DataFrame:
    """(id, part, out_deg, sym_deg, local_real, local_all, cv_real, cv_all)."""
    lab = labels.select("id", "part")
    a = g.A.join(lab.select(F.col("id").alias("src"), F.col("part").alias("sp")), "src").join(lab.select(F.col("id").alias("dst"), F.col("part").alias("dp")), "dst")
    far, real = F.col("sp") != F.col("dp"), ~F.col("is_virtual")
    # one row for each vertex and neighbour part first, so that distinct counts need no second shuffle of edges
    by = a.groupBy("src", "sp", "dp").agg(F.count("*").alias("n_all"), F.sum(real.cast("long")).alias("n_real"))
    v = by.groupBy("src").agg(
        F.first("sp").alias("part"), F.sum("n_real").alias("out_deg"), F.sum("n_all").alias("sym_deg"),
        F.sum(F.when(~far, F.col("n_real")).otherwise(0)).alias("local_real"), F.sum(F.when(~far, F.col("n_all")).otherwise(0)).alias("local_all"),
        F.sum((far & (F.col("n_real") > 0)).cast("long")).alias("cv_real"), F.sum(far.cast("long")).alias("cv_all"),
    )
    return v.withColumnRenamed("src", "id")


def loads(g: Graph, labels: DataFrame) -> DataFrame:
    """(part, vertices, real_load, virtual_load)."""
    v = g.V.join(labels.select("id", "part"), "id")
    return v.groupBy("part").agg(F.count("*").alias("vertices"), F.sum("out_deg").alias("real_load"), F.sum("sym_deg").alias("virtual_load"))


def edge_cut(g: Graph, labels: DataFrame) -> DataFrame:
    """(local_real, cut_real, local_virtual, cut_virtual)."""
    v = per_vertex(g, labels)
    return v.agg(
        F.sum("local_real").alias("local_real"), F.sum(F.col("out_deg") - F.col("local_real")).alias("cut_real"),
        F.sum("local_all").alias("local_virtual"), F.sum(F.col("sym_deg") - F.col("local_all")).alias("cut_virtual"),
    )


def comm_volume(g: Graph, labels: DataFrame) -> DataFrame:
    return per_vertex(g, labels).agg(F.sum("cv_real").alias("cv_real"), F.sum("cv_all").alias("cv_virtual"))


def comm_bound(g: Graph, k: int) -> DataFrame:
    return g.V.agg(F.sum(F.least(F.lit(k).cast("long"), "out_deg")).alias("bound_real"), F.sum(F.least(F.lit(k).cast("long"), "sym_deg")).alias("bound_virtual"))


def _full(q: DataFrame, k: int) -> DataFrame:
    """k rows, empty parts included."""
    parts = q.sparkSession.range(k).select(F.col("id").cast("int").alias("part"))
    return parts.join(q, "part", "left").fillna(0)


def balance(q: DataFrame, k: int) -> DataFrame:
    """max/mean and max/min of vertices and loads over the k parts (max/min null if a part is empty)."""
    aggs = []
    for c, n in (("vertices", "v"), ("real_load", "real"), ("virtual_load", "virtual")):
        aggs += [F.round(F.try_divide(F.max(c) * k, F.sum(c)), 9).alias(f"{n}_max_mean"), F.round(F.try_divide(F.max(c), F.min(c)), 9).alias(f"{n}_max_min")]
    return _full(q, k).agg(*aggs)


def avg_degree(q: DataFrame, k: int) -> DataFrame:
    d = _full(q, k).select(F.coalesce(F.try_divide("real_load", "vertices"), F.lit(0.0)).alias("d"), "real_load", "vertices")
    return d.agg(F.round(F.try_divide(F.sum("real_load"), F.sum("vertices")), 9).alias("expected"), F.round(F.try_divide(F.max("d") * k, F.sum("d")), 9).alias("max_mean"), F.round(F.try_divide(F.max("d"), F.min("d")), 9).alias("max_min"))


def _shares(q: DataFrame, k: int) -> DataFrame:
    full = _full(q, k).withColumn("avg_deg", F.coalesce(F.try_divide("real_load", "vertices"), F.lit(0.0)))
    total = full.agg(*[F.sum(c).cast("double").alias("t_" + c) for c in ("vertices", "real_load", "virtual_load", "avg_deg")])
    return full.crossJoin(F.broadcast(total))  # k rows against one


def _plog(p, q):
    return F.when(p > 0, p * F.ln(p / q)).otherwise(0.0)


def jsd(q: DataFrame, k: int) -> DataFrame:
    """Jensen-Shannon divergence to uniform, 0 * ln 0 = 0."""
    u, out = F.lit(1.0 / k), []
    for c, n in (("real_load", "real"), ("virtual_load", "virtual"), ("vertices", "v"), ("avg_deg", "avg_deg")):
        p = F.coalesce(F.try_divide(F.col(c), F.col("t_" + c)), F.lit(0.0))
        m = (p + u) / 2
        out.append(F.round(F.sum(_plog(p, m) + _plog(u, m)) / (2 * math.log(2)), 9).alias("jsd_" + n))
    return _shares(q, k).agg(*out)


def klu(q: DataFrame, k: int) -> DataFrame:
    """KL divergence to uniform over ln k (average degree: absolute, not divided); -1 if a part is empty."""
    u, out = F.lit(1.0 / k), []
    for c, n in (("real_load", "real"), ("virtual_load", "virtual"), ("vertices", "v"), ("avg_deg", "avg_deg")):
        p = F.try_divide(F.col(c), F.col("t_" + c))
        s = F.sum(_plog(F.coalesce(p, F.lit(0.0)), u))
        out.append(F.when(F.min(c) == 0, -1.0).otherwise(F.round(F.abs(s) if n == "avg_deg" else s / (math.log(k) if k > 1 else 1.0), 9)).alias("klu_" + n))
    return _shares(q, k).agg(*out)


def summary(g: Graph, labels: DataFrame, k: int) -> DataFrame:
    """All metrics of a given partitioning as one row."""
    v = per_vertex(g, labels)
    q = v.groupBy("part").agg(
        F.count("*").alias("vertices"), F.sum("out_deg").alias("real_load"), F.sum("sym_deg").alias("virtual_load"), F.sum("local_real").alias("lr"), F.sum("local_all").alias("la"),
        F.sum("cv_real").alias("cr"), F.sum("cv_all").alias("ca"), F.sum(F.least(F.lit(k).cast("long"), "out_deg")).alias("br"), F.sum(F.least(F.lit(k).cast("long"), "sym_deg")).alias("ba"),
    )
    s = q.agg(
        F.sum("vertices").alias("vertices"), F.sum("real_load").alias("real_edges"), F.sum("virtual_load").alias("virtual_edges"), F.sum("lr").alias("local_real"), (F.sum("real_load") - F.sum("lr")).alias("cut_real"),
        (F.sum("virtual_load") - F.sum("la")).alias("cut_virtual"), F.sum("cr").alias("cv_real"), F.sum("ca").alias("cv_virtual"),
        F.round(F.try_divide(F.sum("real_load") - F.sum("lr"), F.sum("real_load")), 9).alias("cut_real_pct"), F.round(F.try_divide(F.sum("lr"), F.sum("real_load")), 9).alias("local_real_pct"),
        F.round(F.try_divide(F.sum("cr"), F.sum("br")), 9).alias("cv_real_pct"), F.round(F.try_divide(F.sum("ca"), F.sum("ba")), 9).alias("cv_virtual_pct"),
        F.round(F.try_divide(F.max("real_load") * k, F.sum("real_load")), 9).alias("real_max_mean"), F.round(F.try_divide(F.max("vertices") * k, F.sum("vertices")), 9).alias("v_max_mean"),
    )
    return s


def metrics(g: Graph, labels: DataFrame, k: int) -> DataFrame:
    """(key, value): every metric of a partitioning, and the loads of its parts; for the metrics file."""
    q = loads(g, labels)
    rows = [summary(g, labels, k), balance(q, k), avg_degree(q, k).select(*[F.col(c).alias("avg_deg_" + c) for c in ("expected", "max_mean", "max_min")]), jsd(q, k), klu(q, k)]
    one = lambda d: d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in d.columns])).alias("m")).select("m.*")
    out = one(rows[0])
    known = set(rows[0].columns)
    for d in rows[1:]:
        out = out.unionByName(one(d.select(*[c for c in d.columns if c not in known])))
        known |= set(d.columns)
    parts = _full(q, k).select(F.explode(F.array(*[F.struct(F.concat(F.lit(c + "_"), F.col("part").cast("string")).alias("key"), F.col(c).cast("double").alias("value")) for c in ("vertices", "real_load", "virtual_load")])).alias("m"))
    return out.unionByName(parts.select("m.*"))
