"""Graph algorithms over vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.loops import cut
from ..plans.pregel import pregel

REGISTRY: dict[str, str] = {}


def algorithm(name: str, about: str):
    def keep(f):
        REGISTRY[name] = about
        return f

    return keep


@algorithm("Simple PageRank", "0.15/N + 0.85 * incoming shares; dangling mass is lost")
def pagerank_simple(v: DataFrame, e: DataFrame, steps: int = 30, start: float = 1.0, cut_every: int = 5) -> DataFrame:
    """(id, rank). v(id), e(src, dst)."""
    n = v.count()
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    out = cut(e.join(deg, "src").select("src", "dst", (1.0 / F.col("deg")).alias("w")), "edges").repartition("src").persist()
    r = v.select("id", F.lit(float(start)).alias("rank"))
    try:
        for i in range(steps):
            sums = out.join(r.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
            r = v.select("id").join(sums.withColumnRenamed("dst", "id"), "id", "left").select("id", (F.lit(0.15 / n) + 0.85 * F.coalesce("s", F.lit(0.0))).alias("rank"))
            if (i + 1) % cut_every == 0 or i + 1 == steps:
                r = cut(r, "ranks")
        return r
    finally:
        out.unpersist()


def _walk(v, e, steps, t, sources, eps, weighted):
    n = v.count()
    w = F.col("w") if weighted else F.try_divide(F.lit(1.0), F.col("deg"))
    deg = e.groupBy("src").agg(F.count("*").alias("deg"))
    out = cut(e.join(deg, "src").withColumn("w", w).select("src", "dst", "w"), "edges").repartition("src").persist()
    v = cut(v.select("id").join(deg.select(F.col("src").alias("id"), F.lit(1).alias("has")), "id", "left"), "vertices")
    r, before = v.select("id", "has", F.lit(1.0 / n).alias("rank")), None
    ns = None
    if sources is not None:
        sources = cut(sources.select("id").distinct().join(v.select("id"), "id", "left_semi").withColumn("is_source", F.lit(1)), "sources")
        ns = sources.count()
        if not ns:
            raise ValueError("no source vertex")
        r = r.join(sources, "id", "left")
    else:
        r = r.withColumn("is_source", F.lit(None).cast("int"))
    r = cut(r, "ranks")
    try:
        for i in range(steps):
            dang = r.where("has is null").agg(F.sum("rank")).first()[0] or 0.0
            sums = out.join(r.select(F.col("id").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("w")).alias("s"))
            base = (1 - t) * (F.coalesce("s", F.lit(0.0)) + dang / n)
            jump = F.lit(t / n) if sources is None else F.when(F.col("is_source") == 1, t / ns).otherwise(0.0)
            new = r.join(sums.withColumnRenamed("dst", "id"), "id", "left").select("id", "has", "is_source", F.col("rank").alias("old"), (base + jump).alias("rank"))
            new = cut(new, "ranks")
            total, change = new.agg(F.sum("rank"), F.sum(F.abs(F.col("rank") - F.col("old")))).first()
            r = new.select("id", "has", "is_source", (F.col("rank") / (before or 1.0)).alias("rank")) if before else new.select("id", "has", "is_source", "rank")
            before = None if abs((total or 1.0) - 1.0) < 1e-12 else total
            if i > 1 and change is not None and change < eps:
                break
        return r.select("id", "rank")
    finally:
        out.unpersist()


@algorithm("PageRank", "random walk with teleport and dangling mass, L1 convergence")
def pagerank(v: DataFrame, e: DataFrame, steps: int = 30, t: float = 0.15, eps: float = 1e-5) -> DataFrame:
    return _walk(v, e, steps, t, None, eps, False)


@algorithm("Random walk with restart", "as PageRank, with jumps to sources; edge weights are transitions")
def rwr(v: DataFrame, e: DataFrame, sources: DataFrame, steps: int = 30, t: float = 0.15, eps: float = 1e-5) -> DataFrame:
    """e(src, dst[, w]); without w each edge of a vertex is as likely."""
    return _walk(v, e, steps, t, sources, eps, "w" in e.columns)


@algorithm("Shortest paths", "Bellman-Ford from one source over weights; unreachable is null")
def sssp(v: DataFrame, e: DataFrame, source: int = 1, max_steps: int = 10_000) -> DataFrame:
    """(id, dist). e(src, dst, w)."""
    start = v.select("id", F.when(F.col("id") == source, 0.0).alias("value"))
    got = pregel(start, e, F.col("value") + F.col("w"), F.min, F.least(F.coalesce("value", F.lit(float("inf"))), "msg"), max_steps)
    return got.select("id", F.col("value").alias("dist"))


@algorithm("Connected components", "smallest id of the component over a symmetric edge table")
def connected_components(v: DataFrame, a: DataFrame, max_steps: int = 10_000) -> DataFrame:
    got = pregel(v.select("id", F.col("id").alias("value")), a.select("src", "dst"), F.col("value"), F.min, F.least("value", "msg"), max_steps)
    return got.select("id", F.col("value").alias("component"))


@algorithm("Max propagation", "largest value that reaches a vertex")
def max_propagation(v: DataFrame, e: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """v(id, value)."""
    return pregel(v, e.select("src", "dst"), F.col("value"), F.max, F.greatest("value", "msg"), max_steps)


@algorithm("Out-degree", "out-edges of every vertex")
def out_degree(v: DataFrame, e: DataFrame) -> DataFrame:
    d = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return v.select("id").join(d, "id", "left").fillna(0, ["degree"])


@algorithm("In-degree", "in-edges of every vertex")
def in_degree(v: DataFrame, e: DataFrame) -> DataFrame:
    d = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return v.select("id").join(d, "id", "left").fillna(0, ["degree"])


@algorithm("Triangle closing", "two-hop candidates ranked by frequency, those met at least twice")
def triangle_closing(a: DataFrame, least: int = 2, keep_known: bool = True, top: int | None = None) -> DataFrame:
    """(id, candidate, times, rank): the candidates of a vertex, most frequent first, ties to the smaller id; with top,
    so many of them. With keep_known=False itself and neighbours are left out."""
    two = a.select(F.col("src").alias("id"), F.col("dst").alias("via")).join(a.select(F.col("src").alias("via"), F.col("dst").alias("candidate")), "via")
    out = two.groupBy("id", "candidate").agg(F.count("*").alias("times")).where(F.col("times") >= least)
    if not keep_known:
        out = out.where("id <> candidate").join(a.select(F.col("src").alias("id"), F.col("dst").alias("candidate")), ["id", "candidate"], "left_anti")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("times"), "candidate")))
    return out.where(F.col("rank") <= top) if top else out


@algorithm("Clustering coefficient", "closed pairs of neighbours over all pairs, on a symmetric edge table")
def clustering_coefficient(a: DataFrame) -> DataFrame:
    """(id, degree, cc, cc_milli). Triangles are found once each, edges pointing from the smaller to the
    larger degree, so that a hub is never expanded to all its pairs; then dealt to their three corners."""
    a = a.select("src", "dst")
    deg = a.groupBy("src").agg(F.count("*").alias("degree"), F.sum((F.col("src") == F.col("dst")).cast("int")).alias("loops"))
    d = cut(deg, "degrees")
    s, t = d.select("src", F.col("degree").alias("sd")), d.select(F.col("src").alias("dst"), F.col("degree").alias("td"))
    up = a.where("src <> dst").join(s, "src").join(t, "dst").where("sd < td or (sd = td and src < dst)").select("src", "dst")
    up = cut(up, "oriented")
    wedge = up.alias("x").join(up.alias("y"), F.col("x.src") == F.col("y.src")).where("x.dst < y.dst").select(F.col("x.src").alias("a"), F.col("x.dst").alias("b"), F.col("y.dst").alias("c"))
    closed = wedge.join(up.select(F.least("src", "dst").alias("b"), F.greatest("src", "dst").alias("c")), ["b", "c"])
    corner = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("tri"))
    out = d.select(F.col("src").alias("id"), (F.col("degree") - F.col("loops")).alias("degree")).join(corner, "id", "left")
    cc = F.when(F.col("degree") > 1, 2.0 * F.coalesce("tri", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return out.select("id", "degree", F.round(cc, 9).alias("cc"), F.floor(F.round(cc, 9) * 1000).cast("int").alias("cc_milli"))


def neighbour_lists(a: DataFrame) -> DataFrame:
    return a.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("friends"))


@algorithm("Deadlock detection", "a vertex is free when all requests of one tag are granted; no requests: free")
def deadlock_free(e: DataFrame, initiator: int | None = None, max_steps: int = 10_000) -> DataFrame:
    """(id, free). e(src, dst, tag) wait-for edges; with an initiator only what it reaches."""
    e = cut(e.select("src", "dst", "tag").distinct(), "requests")
    v = cut(e.select(F.col("src").alias("id")).union(e.select(F.col("dst").alias("id"))).distinct(), "ids")
    if initiator is not None:
        seen = pregel(v.select("id", (F.col("id") == initiator).cast("int").alias("value")), e, F.when(F.col("value") == 1, 1), F.max, F.greatest("value", "msg"), max_steps)
        v = cut(seen.where("value = 1").select("id"), "reached")
        e = cut(e.join(v.select(F.col("id").alias("src")), "src", "left_semi"), "requests")
    free = cut(v.join(e.select(F.col("src").alias("id")), "id", "left_anti"), "free")
    for _ in range(max_steps):
        waits = e.join(free.select(F.col("id").alias("dst"), F.lit(1).alias("granted")), "dst", "left")
        done = waits.groupBy("src", "tag").agg(F.min(F.coalesce("granted", F.lit(0))).alias("ok")).where("ok = 1").select(F.col("src").alias("id")).distinct()
        new = cut(done.join(free, "id", "left_anti"), "freed")
        if not new.limit(1).count():
            break
        free = cut(free.union(new), "free")
    return v.join(free.withColumn("free", F.lit(True)), "id", "left").select("id", F.coalesce("free", F.lit(False)).alias("free"))


@algorithm("Mutation: add", "vertices and edges added; ends of new edges become vertices")
def mutate_add(v: DataFrame, e: DataFrame, new_v: DataFrame, new_e: DataFrame) -> tuple[DataFrame, DataFrame]:
    e2 = e.select("src", "dst").union(new_e.select("src", "dst")).distinct()
    v2 = v.select("id").union(new_v.select("id")).union(new_e.select("src")).union(new_e.select("dst")).distinct()
    return v2, e2


@algorithm("Mutation: remove", "vertices removed with their edges; single edges removed")
def mutate_remove(v: DataFrame, e: DataFrame, old_v: DataFrame, old_e: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = old_v.select("id")
    e2 = e.select("src", "dst").join(old_e.select("src", "dst"), ["src", "dst"], "left_anti")
    for end in ("src", "dst"):
        e2 = e2.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return v.select("id").join(gone, "id", "left_anti"), e2.select("src", "dst")


@algorithm("Checkpoint recurrence", "vertices add the sum of messages, edges the old value of their source and send it; each step a written table")
def checkpoint_recurrence(v: DataFrame, e: DataFrame, steps: int = 6) -> DataFrame:
    """(id, value). v(id, value long), e(src, dst, w double). In each of the supersteps 0..steps a vertex adds the
    whole part of the sum of its messages; every edge adds the value that its source had before, and is the message of the
    next superstep."""
    val, e = cut(v.select("id", "value"), "values"), cut(e.select("src", "dst", "w"), "edges")
    for i in range(steps + 1):
        new = val
        if i:
            got = e.groupBy(F.col("dst").alias("id")).agg(F.sum("w").cast("long").alias("s"))
            new = val.join(got, "id", "left").select("id", (F.col("value") + F.coalesce("s", F.lit(0))).alias("value"))
        e = cut(e.join(val.withColumnRenamed("id", "src"), "src").select("src", "dst", (F.col("w") + F.col("value")).alias("w")), "edges")
        val = cut(new, "values")
    return val


@algorithm("Message sum", "sum of the source ids that send to each vertex")
def message_sum(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("dst").alias("id")).agg(F.sum("src").alias("total"), F.count("*").alias("messages"))


@algorithm("Master broadcast", "each step the master sends step div 2 + 1 to all vertices, which add it")
def master_broadcast(v: DataFrame, steps: int = 10) -> DataFrame:
    """(id, value)."""
    out = v.select("id", F.lit(0).cast("long").alias("value"))
    for step in range(steps):
        sent = v.sparkSession.range(1).select(F.lit(step // 2 + 1).cast("long").alias("sent"))  # one row
        out = out.crossJoin(F.broadcast(sent)).select("id", (F.col("value") + F.col("sent")).alias("value"))
    return out
