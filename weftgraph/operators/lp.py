"""Balanced k-way partitioning by label propagation.

A step is two jobs. The first reads the neighbour lists of vertices that moved, moves the counts of their
neighbours by the difference, scores, and writes a table; k demands are observed as it writes. The second lets
vertices of that table move, a projection, and sums up k loads. What a step shuffles of the edges shrinks with the
number of moves; counts are whole numbers, so they are those of a full histogram.
Numbers that differ by step are kept out of generated code, which is compiled once. Random choices come from md5
of (seed, step, id), so a step gives the same labels at any partitioning and after any recomputation.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.loops import cut, drop
from ..functions.rng import ceil3, ceil3_decimal, uniform
from ..graph import Graph, pairs
from . import packed

HUB = 100_000  # edges of one vertex in a partition
LOAD = {"edge": "out_deg", "vertex": "out_deg", "classic": "sym_deg", "hybrid": "sym_deg"}
MODES = tuple(LOAD)


@dataclass
class Settings:
    k: int = 8
    mode: str = "edge"
    slack: float = 0.05
    lam: float = 1.0
    kappa: float = 0.5
    window: int = 5
    threshold: float = 0.001
    max_iterations: int = 290
    seed: int = 1
    tie: str = "random"  # among the best but the current label, which stays if it is one; any: also it; min: the smallest
    strict_decimal: bool = False


@dataclass
class Loads:
    """Driver-side state: k numbers each."""

    load: list[int]
    count: list[int]
    capacity: int
    vertices: int
    demand: list[int] = field(default_factory=list)


def histogram(a: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(src, f array, ec array, total, active): neighbour weight and real out-edges by label.
    Unlabelled neighbours count for nothing."""
    changed = F.col("changed") if "changed" in labels.columns else F.lit(True)
    lab = labels.select(F.col("id").alias("dst"), F.col("part").alias("dp"), changed.alias("dch"))
    rows = a.join(lab, "dst").where("dp is not null")
    real = F.when(~F.col("is_virtual"), 1).otherwise(0)
    f = [F.sum(F.when(F.col("dp") == i, F.col("weight")).otherwise(0)).alias(f"f{i}") for i in range(k)]
    e = [F.sum(F.when(F.col("dp") == i, real).otherwise(0)).alias(f"e{i}") for i in range(k)]
    out = rows.groupBy("src").agg(*f, *e, F.sum("weight").alias("total"), F.max("dch").alias("active"))
    return out.select("src", F.array(*[f"f{i}" for i in range(k)]).alias("f"), F.array(*[f"e{i}" for i in range(k)]).alias("ec"), "total", "active")


def dealt(g: Graph) -> DataFrame:
    """The edges (src, dst, salt, is_virtual, weight): those into a vertex of more than HUB neighbours have its parts as
    salt, so that a shuffle by (dst, salt) holds at most about HUB edges of one vertex together. Of such vertices there is
    at most one for each HUB edges, so they are broadcast."""
    hubs = g.V.where(F.col("sym_deg") > HUB).select(F.col("id").alias("dst"), _salts().alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("src"), F.col("salts")), F.lit(0).cast("long"))
    return g.A.join(F.broadcast(hubs), "dst", "left").select("src", "dst", salt.alias("salt"), "is_virtual", "weight")


def gathered(a: DataFrame, s: Settings) -> DataFrame:
    """The edges of dealt() as lists: (dst, salt, weight, srcs), and is_virtual where it counts. A row holds at most
    about HUB neighbours; edges of as many weights as there are edges stay a row each."""
    kind = ["is_virtual"] if "ec" in _counts(s) else []
    return a.groupBy("dst", "salt", "weight", *kind).agg(F.collect_list("src").alias("srcs"))


def _salts():
    return F.ceil(F.col("sym_deg") / HUB).cast("long")


def blank(v: DataFrame, s: Settings) -> DataFrame:
    """Labels as a state: nothing counted yet, and every labelled vertex new to its neighbours."""
    zeros = F.array_repeat(F.lit(0).cast("long"), s.k)
    counts = [zeros.alias(c) for c in _counts(s)]
    return v.select("id", "part", "out_deg", "sym_deg", F.lit(None).cast("int").alias("old"), F.col("part").isNotNull().alias("changed"), *counts, F.lit(0).cast("long").alias("total"))


def _counts(s: Settings) -> tuple[str, ...]:
    return ("f", "ec") if s.mode == "vertex" else ("f",)


def told(state: DataFrame, a: DataFrame, s: Settings) -> DataFrame:
    """The state after changed vertices told their neighbours: f, ec and total as in histogram(), from those of the step
    before. Only edges into changed vertices are summed, and a vertex is active when it heard of any. a: rows of dealt() or
    gathered()."""
    to = "explode(sequence(0L, greatest(ceil(sym_deg / %d), 1) - 1)) AS salt" % HUB
    changed = state.where("changed").selectExpr("id AS dst", "old", "part AS new", to)
    size = {"f": "weight", "ec": "CASE WHEN is_virtual THEN 0 ELSE 1 END"}
    by = lambda c, i: f"sum(CASE WHEN new = {i} THEN {size[c]} ELSE 0 END - CASE WHEN old = {i} THEN {size[c]} ELSE 0 END) AS {c}{i}"
    sums = [F.expr(by(c, i)) for c in _counts(s) for i in range(s.k)]
    heard = a.join(changed, ["dst", "salt"])
    if "srcs" in a.columns:
        heard = heard.withColumn("src", F.explode("srcs"))
    news = heard.groupBy(F.col("src").alias("id")).agg(*sums, F.expr("sum(CASE WHEN old IS NULL THEN weight ELSE 0 END) AS more"))
    counts = [f"CASE WHEN more IS NULL THEN {c} ELSE array({', '.join(f'get({c}, {i}) + {c}{i}' for i in range(s.k))}) END AS {c}" for c in _counts(s)]
    out = state.drop("old", "changed").join(news, "id", "left")
    return out.selectExpr("id", "part", "out_deg", "sym_deg", *counts, "total + coalesce(more, 0) AS total", "more IS NOT NULL AS active")


def load_column(mode: str):
    return F.col(LOAD[mode])


def loads_of(v: DataFrame, s: Settings) -> Loads:
    """One action: k rows."""
    return moved_loads(v.withColumn("changed", F.lit(False)), s)[0]


def moved_loads(v: DataFrame, s: Settings) -> tuple[Loads, int]:
    """Loads, and the number of changed vertices. One action: a row of 2 k + 3 numbers."""
    size = load_column(s.mode)
    sums = [f"sum(CASE WHEN part = {i} THEN size END)" for i in range(s.k)] + [f"count_if(part = {i})" for i in range(s.k)]
    got = v.select("part", size.alias("size"), "changed").selectExpr(*sums, "sum(size)", "count(*)", "count_if(changed)").first()
    *each, total, n, moved = (int(x or 0) for x in got)
    return Loads(each[: s.k], each[s.k :], capacity(n if s.mode == "vertex" else total, s), n), moved


def capacity(total: int, s: Settings) -> int:
    return math.floor(total * (1 + s.slack) / s.k + 0.5)


def asked(sc: DataFrame, s: Settings, name: str) -> tuple[DataFrame, dict[int, int], float]:
    """Scores as a written table, the demand for each label that active vertices would move to, and the sum of the scores,
    both summed up as it is written."""
    seen, size = Observation(), "1L" if s.mode == "vertex" else LOAD[s.mode]
    asks = "active AND NOT best <=> part"
    sums = [F.expr(f"sum(CASE WHEN {asks} AND best = {i} THEN {size} END) AS d{i}") for i in range(s.k)]
    out = cut(sc.observe(seen, F.sum("score").alias("score"), *sums), name)
    got = seen.get
    return out, {i: int(got[f"d{i}"]) for i in range(s.k) if got[f"d{i}"] is not None}, got["score"] or 0.0


def penalties(l: Loads, s: Settings) -> list[float]:
    up = ceil3_decimal if s.strict_decimal else ceil3
    return [up(n, l.vertices) for n in l.count] if s.mode == "vertex" else [up(x, l.capacity) for x in l.load]


def scored(v: DataFrame, hist: DataFrame, l: Loads, s: Settings, step: int) -> DataFrame:
    """v plus (best, score, active). A vertex without labelled neighbours keeps its label."""
    return _scored(v.join(hist.withColumnRenamed("src", "id"), "id", "left"), l, s, step)


def _scored(out: DataFrame, l: Loads, s: Settings, step: int, also: tuple[str, ...] = ()) -> DataFrame:
    # the ordinal is one that Spark cannot fold (f has k entries), so the penalties of a step stay a reference of the generated code
    pf = [f"get(array({', '.join(_double(x) for x in penalties(l, s))}), size(f) - {s.k - i})" for i in range(s.k)]
    lam, h = _double(s.lam), []
    for i in range(s.k):
        base = f"{lam} + try_divide(CAST(get(f, {i}) AS DOUBLE), CAST(total AS DOUBLE))"
        if s.mode == "vertex":
            share = f"coalesce(try_divide(CAST(get(ec, {i}) AS DOUBLE), CAST(out_deg AS DOUBLE)), 0D)"
            h.append(f"round({base} + {lam} * ({_double(s.kappa)} * {share} - {_double(1 - s.kappa)} * {pf[i]}), 9)")
        else:
            h.append(f"round({base} - {lam} * {pf[i]}, 9)")
    out = out.withColumn("h", F.expr(f"CASE WHEN total > 0 THEN array({', '.join(h)}) END"))
    out = out.withColumn("m", F.array_max("h"))
    ties = F.filter(F.sequence(F.lit(0), F.lit(s.k - 1)), lambda i: F.get("h", i) == F.col("m"))
    pick = F.lit(0) if s.tie == "min" else F.floor(uniform(s.seed, step) * F.size("ties")).cast("int")
    stay = F.col("m").isNull()
    if s.tie != "any":  # there the current label has no precedence
        stay = stay | F.coalesce(F.get("h", F.col("part")) == F.col("m"), F.lit(False))
    return _chosen(out.withColumn("ties", F.when(~stay, ties)), stay, pick, also)


def _double(x: float) -> str:
    """The literal of exactly this number."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _chosen(out: DataFrame, stay, pick, also) -> DataFrame:
    best = F.when(stay, F.col("part")).otherwise(F.get("ties", pick))
    score = F.when(F.col("part").isNotNull(), F.get("h", F.col("part"))).otherwise(F.col("m"))
    return out.select("id", "part", "out_deg", "sym_deg", best.cast("int").alias("best"), F.coalesce(score, F.lit(0.0)).alias("score"), F.coalesce("active", F.lit(False)).alias("active"), *also)


def demand(sc: DataFrame, s: Settings) -> DataFrame:
    """(part, demand) of active vertices that would move."""
    size = F.lit(1).cast("long") if s.mode == "vertex" else load_column(s.mode)
    return sc.where("active and best is not null and not (best <=> part)").groupBy(F.col("best").alias("part")).agg(F.sum(size).alias("demand"))


def gates(l: Loads, wanted: dict[int, int], s: Settings) -> list[float]:
    used = l.count if s.mode == "vertex" else l.load
    return [max(0.0, (l.capacity - used[i]) / wanted[i]) if wanted.get(i) else 0.0 for i in range(s.k)]


def migrated(sc: DataFrame, p: list[float], s: Settings, step: int) -> DataFrame:
    """Labels after the gate: a vertex moves when its number is below its target's probability."""
    gate = F.get(F.array(*[F.lit(float(x)) for x in p]), F.col("best"))
    moves = F.col("active") & ~F.col("best").eqNullSafe(F.col("part")) & (uniform(s.seed, step) < gate)
    moves = F.coalesce(moves, F.lit(False))
    return sc.select("id", F.when(moves, F.col("best")).otherwise(F.col("part")).alias("part"), "out_deg", "sym_deg", moves.alias("changed"), F.col("part").alias("old"), *_kept(sc))


def _kept(sc: DataFrame) -> list[str]:
    """The counts that a state carries to the next step; none in plain scores."""
    return [c for c in ("f", "ec", "total") if c in sc.columns]


def init_random(v: DataFrame, s: Settings, step: int = 2) -> DataFrame:
    given = F.col("part") if "part" in v.columns else F.lit(None).cast("int")
    return v.withColumn("part", F.coalesce(given, F.floor(uniform(s.seed, step) * s.k).cast("int")))


def hub_threshold(g: Graph) -> int:
    """ceil(E / V)."""
    e, n = g.V.agg(F.sum("out_deg"), F.count("*")).first()
    return -(-int(e or 0) // max(1, n))


def init_hubs(v: DataFrame, threshold: int, s: Settings, step: int = 2) -> DataFrame:
    """Random labels for vertices above the threshold; the rest stay unlabelled."""
    given = F.col("part") if "part" in v.columns else F.lit(None).cast("int")
    return v.withColumn("part", F.coalesce(given, F.when(F.col("out_deg") > threshold, F.floor(uniform(s.seed, step) * s.k).cast("int"))))


def first_migration(sc: DataFrame, s: Settings, step: int = 4) -> DataFrame:
    """Ungated: every change applies; what is still unlabelled gets a uniform label."""
    part = F.coalesce("best", "part", F.floor(uniform(s.seed, step) * s.k).cast("int"))
    return sc.select("id", part.cast("int").alias("part"), "out_deg", "sym_deg", (~part.eqNullSafe(F.col("part"))).alias("changed"), F.col("part").alias("old"), *_kept(sc))


def reset(v: DataFrame) -> DataFrame:
    return v.withColumn("part", F.lit(None).cast("int"))


def repartition(labels: DataFrame, k: int, r: int, seed: int = 1, step: int = 2) -> DataFrame:
    """r < 0: labels of the last -r parts move to a random one of the rest; r > 0: each vertex moves
    to a random new part with probability r / (k + r)."""
    if r == 0:
        raise ValueError("r must not be 0")
    u, w = uniform(seed, step), uniform(seed, f"{step}b")
    if r < 0:
        if k + r < 1:
            raise ValueError("no part would be left")
        part = F.when(F.col("part") >= k + r, F.floor(u * (k + r)).cast("int")).otherwise(F.col("part"))
    else:
        part = F.when(u < r / (k + r), (F.floor(w * r) + k).cast("int")).otherwise(F.col("part"))
    return labels.withColumn("part", part)


class Window:
    """The last scores; they are level when the best of them and a new one differ by less than the threshold."""

    def __init__(self, s: Settings):
        self.scores: deque[float] = deque(maxlen=max(1, (s.window + 1) // 2))
        self.threshold = s.threshold

    def level(self, it: int, score: float) -> bool:
        most = max(self.scores, default=0)
        self.scores.append(score)
        return it > 2 and most != 0 and abs(1 - score / most) < self.threshold


def told_of(step: int, score: float, moved: int, l: Loads, s: Settings) -> dict:
    """A step as history and on_step have it."""
    total = sum(l.load)
    return {"step": step, "score": score, "migrations": moved, "max_mean": max(l.load) * s.k / total if total else None, "load": list(l.load), "count": list(l.count)}


def run(g: Graph, s: Settings, labels: DataFrame | None = None, on_step=None) -> tuple[DataFrame, list[dict]]:
    """(labels, history). labels: optional (id, part) to start from, null parts allowed; without it
    classic starts at random, the other modes from hubs. on_step(step, metrics) may return True to stop.
    A graph of Graph.of_raw() is packed; run from there where packed.lists() says so, with the same labels."""
    if s.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if g.raw is not None:
        table, small = packed.lists(g.raw)
        if small and labels is None and s.k <= packed.MOST_K:
            return packed.run(table, g.weight, s, on_step)
        g = packed.graph(table, g.weight) if table is not None else Graph.of_pairs(cut(pairs(g.raw), "pairs"), g.weight)
    g = Graph(cut(g.V.select("id", "out_deg", "sym_deg"), "vertices"), g.A, g.E)
    v = g.V
    if labels is not None:
        v = v.join(labels.select("id", "part"), "id", "left")
    elif s.mode == "classic":
        v = init_random(v, s)
    else:
        v = init_hubs(v, hub_threshold(g), s)
    v, history = blank(v, s), []
    parts = int(v.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = gathered(dealt(g).repartition(parts, "dst", "salt"), s).sortWithinPartitions("dst", "salt").persist()
    also = (*_counts(s), "total")
    try:
        step, old = 3, None
        if v.where("part is null").limit(1).count() > 0:
            old, _, _ = asked(_scored(told(v, a, s), loads_of(v.where("part is not null"), s), s, step, also), s, "first")
            v = first_migration(old, s, step + 1)
            step += 2
        window = Window(s)
        l, _ = moved_loads(v, s)
        for it in range(s.max_iterations):
            # the state of a step is a projection of the written scores of the step before
            sc, wanted, score = asked(_scored(told(v, a, s), l, s, step, also), s, "scored")
            if old is not None:
                drop(old)
            old = sc
            v = migrated(sc, gates(l, wanted, s), s, step + 1)
            now, moved = moved_loads(v, s)
            l.load, l.count = now.load, now.count
            history.append(told_of(step, score, moved, l, s))
            stop = bool(on_step and on_step(step, history[-1]))
            stop = window.level(it, score) or stop
            step += 2
            if stop or (moved == 0 and not wanted):
                break
        return cut(v.select("id", "part"), "labels"), history
    finally:
        a.unpersist()
