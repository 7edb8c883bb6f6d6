"""Samplers that start label propagation: rank degree, highest degree, clustering coefficient, degree distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.loops import cut
from ..functions.rng import uniform
from ..graph import Graph
from . import algorithms, lp


def cutoff(hist: DataFrame, key: str, sigma: int) -> tuple[int | None, float]:
    """(cut, probability): all keys above cut are taken, those at cut with the probability. Keys are
    few (degrees, thousandths); they are summed on the driver."""
    taken = 0
    for k, n in sorted(((r[0], r[1]) for r in hist.select(key, "n").collect()), reverse=True):
        if taken + n >= sigma:
            return k, (sigma - taken) / n
        taken += n
    return None, 1.0


def cutoff_table(hist: DataFrame, key: str, sigma: int) -> DataFrame:
    """One row (cut, before, bucket): where the running count from the top reaches sigma."""
    w = Window.orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)  # over the few rows of a histogram
    run = hist.withColumn("total", F.sum("n").over(w)).where(F.col("total") >= sigma)
    return run.orderBy(F.desc(key)).limit(1).select(F.col(key).alias("cut"), (F.col("total") - F.col("n")).alias("before"), F.col("n").alias("bucket"))


def gd_probabilities(dist: DataFrame, sigma: int) -> DataFrame:
    """(degree, n, p, seed_p, nominate_p) of each degree."""
    total = dist.agg(F.sum("n").alias("v"), F.max("n").alias("mx"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    d = dist.crossJoin(F.broadcast(total))  # one row
    p = F.col("n") / F.col("v")
    return d.select("degree", "n", F.round(p, 9).alias("p"), F.round(p * sigma / (F.col("sq") / F.col("v")), 9).alias("seed_p"), F.round(p + (1 - F.col("mx") / F.col("v")) / 2, 9).alias("nominate_p"))


def topk_neighbours(a: DataFrame, degree: DataFrame, tau: int) -> DataFrame:
    """(src, dst, rank): each vertex's tau neighbours of the largest degree, ties to the smaller id."""
    rows = a.select("src", "dst").join(degree.select(F.col("id").alias("dst"), "degree"), "dst")
    w = Window.partitionBy("src").orderBy(F.desc("degree"), "dst")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= tau).select("src", "dst", "rank")


def _total(v: DataFrame) -> DataFrame:
    return v.select("id", (F.col("out_deg") + F.col("in_deg")).alias("degree"))


def seeds(g: Graph, kind: str, sigma: int, share: float, seed: int, step: int) -> DataFrame:
    """(id) of the first sampled vertices."""
    u = uniform(seed, step)
    deg = _total(g.V)
    if kind == "RD":
        return g.V.where(u < share).select("id")
    if kind in ("HD", "CC"):
        if kind == "HD":
            keyed = deg.select("id", F.col("degree").alias("key"))
        else:
            keyed = algorithms.clustering_coefficient(g.A).select("id", F.col("cc_milli").alias("key"))
        at, p = cutoff(keyed.groupBy("key").agg(F.count("*").alias("n")), "key", sigma)
        if at is None:
            return keyed.select("id")
        return keyed.where((F.col("key") > at) | ((F.col("key") == at) & (u < p))).select("id")
    if kind == "GD":
        prob = gd_probabilities(deg.groupBy("degree").agg(F.count("*").alias("n")), sigma)
        return deg.join(prob.select("degree", "seed_p"), "degree").where(u < F.col("seed_p")).select("id")
    raise ValueError("kind must be RD, HD, CC or GD")


def sample(g: Graph, kind: str, k: int, beta: float = 0.15, sigma: float = 0.05, tau: int = 3, seed: int = 1, max_rounds: int = 50) -> tuple[DataFrame, list[dict]]:
    """((id, part) of the sample, history). Rounds: the frontier nominates unsampled neighbours, each
    nominee joins with probability (BETA - S) / nominations; the sample's labels are uniform, among
    empty parts while there are any. Falls back to hubs after max_rounds."""
    n = g.V.where("declared").count()
    want, first = max(k, int(beta * n) + 1), int(sigma * n) + 1
    deg, step, history = _total(g.V), 10, []
    # a nominee can only be drawn while unsampled, so BETA must be reachable
    want = min(want, g.V.count())
    for attempt in range(20):
        s = cut(seeds(g, kind, first, sigma, seed, f"{step}.{attempt}").withColumn("part", F.lit(None).cast("int")), "seeds")
        if s.limit(1).count():
            break
    else:
        return _hubs(g, k, seed), [{"error": "no seed drawn; hubs instead"}]
    sampled = cut(s.select("id", F.floor(uniform(seed, f"{step}p") * k).cast("int").alias("part")), "sample")
    prob = None
    if kind == "GD":
        prob = cut(gd_probabilities(deg.groupBy("degree").agg(F.count("*").alias("n")), first).select("degree", "nominate_p"), "prob")
    frontier = sampled.select("id")
    a = cut(g.A.select("src", "dst"), "edges")
    for r in range(max_rounds):
        got = {x[0]: x[1] for x in sampled.groupBy("part").count().collect()}
        size, empty = sum(got.values()), [i for i in range(k) if i not in got]
        history.append({"round": r, "size": size, "empty": len(empty)})
        if size >= want and not empty:
            return sampled, history
        if size >= want:  # full, a part empty: members of larger parts move there
            # with the probability that a part's surplus has in it
            move = F.get(F.array(*[F.lit(max(0.0, 1 - size / k / got[i]) if i in got else 0.0) for i in range(k)]), F.col("part"))
            u = uniform(seed, f"{step + r}m")
            pick = F.get(F.array(*[F.lit(i) for i in empty]), F.floor(uniform(seed, f"{step + r}n") * len(empty)).cast("int"))
            sampled = cut(sampled.select("id", F.when(u < move, pick).otherwise(F.col("part")).alias("part")), "sample")
            continue
        cand = a.join(frontier.select(F.col("id").alias("src")), "src").join(sampled.select(F.col("id").alias("dst")), "dst", "left_anti").join(deg.select(F.col("id").alias("dst"), "degree"), "dst")
        if kind == "GD":
            u = uniform(seed, f"{step + r}g", "dst")
            picked = cand.join(prob, "degree").where(u < F.col("nominate_p")).select("dst")
        else:
            w = Window.partitionBy("src").orderBy(F.desc("degree"), "dst")
            picked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= tau).select("dst")
        picked = cut(picked.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("times")), "nominated")
        times = picked.agg(F.sum("times")).first()[0] or 0
        p = (want - size) / times if times else 0.0
        label = F.floor(uniform(seed, f"{step + r}l") * (len(empty) or k)).cast("int")
        label = F.get(F.array(*[F.lit(i) for i in empty]), label) if empty else label
        new = cut(picked.where(uniform(seed, f"{step + r}a") < p).select("id", label.alias("part")), "joined")
        if new.limit(1).count():
            sampled = cut(sampled.union(new), "sample")
            frontier = new.select("id")
        else:
            frontier = sampled.select("id")  # nobody joined: all ask again
    history.append({"error": "no full sample; hubs instead"})
    return _hubs(g, k, seed), history


def _hubs(g: Graph, k: int, seed: int) -> DataFrame:
    return lp.init_hubs(g.V, lp.hub_threshold(g), lp.Settings(k=k, seed=seed)).where("part is not null").select("id", "part")


def one_round(g: Graph, kind: str, sigma: int, share: float, tau: int, want: int, seed: int = 1) -> DataFrame:
    """(id, nominations) after seeds and one nomination, nobody joining; for tests against SQL. `want` is not used."""
    s = seeds(g, kind, sigma, share, seed, 10)
    deg = _total(g.V)
    cand = g.A.select("src", "dst").join(s.select(F.col("id").alias("src")), "src").join(s.select(F.col("id").alias("dst")), "dst", "left_anti").join(deg.select(F.col("id").alias("dst"), "degree"), "dst")
    w = Window.partitionBy("src").orderBy(F.desc("degree"), "dst")
    if kind == "GD":
        prob = gd_probabilities(deg.groupBy("degree").agg(F.count("*").alias("n")), sigma)
        picked = cand.join(prob, "degree").where(uniform(seed, "11g", "dst") < F.col("nominate_p")).select("dst")
    else:
        picked = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= tau).select("dst")
    return picked.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("nominations"))
