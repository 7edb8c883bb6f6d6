"""Queries that run to their operators' own end, against brute force."""

import hashlib
import heapq
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph import queries as q


@pytest.fixture(scope="module")
def path_dir(spark, tmp_path_factory):
    """A line of 30 parts, each order two neighbours of it, with a shortcut, a branch and a lone pair."""
    pairs = [(i, i + 1) for i in range(50, 80)] + [(52, 60), (55, 90), (90, 91), (100, 101)]
    d = str(tmp_path_factory.mktemp("path"))
    rows = [(k, p) for k, pair in enumerate(pairs) for p in pair]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{d}/lineitem.parquet")
    return d, pairs


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def test_shortest_paths_reach_the_fixpoint(spark, path_dir):
    d, pairs = path_dir
    out, dist, heap = defaultdict(list), {}, [(0.0, 50)]
    for s, t in pairs:
        out[s].append((t, 1.0 + (s + t) % 7))
    while heap:
        x, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = x
            for t, w in out[v]:
                heapq.heappush(heap, (x + w, t))
    got = values(q.QUERIES["sssp"](spark, d))
    assert got == {v: dist.get(v) for pair in pairs for v in pair} and got[101] is None


def walk(pairs, sources=None, steps=30, eps=1e-5):
    ids, deg = sorted({v for x in pairs for v in x}), Counter(s for s, _ in pairs)
    n, r, before = len(ids), None, None
    r = {v: 1 / n for v in ids}
    for i in range(steps):
        lost = sum(r[v] for v in ids if not deg[v])
        new = {v: 0.85 * lost / n + (0.15 / n if sources is None else 0.15 / len(sources) if v in sources else 0) for v in ids}
        for s, t in pairs:
            new[t] += 0.85 * r[s] / deg[s]
        change, total = sum(abs(new[v] - r[v]) for v in ids), sum(new.values())
        r = {v: x / (before or 1.0) for v, x in new.items()}
        before = None if abs(total - 1) < 1e-12 else total
        if i > 1 and change < eps:
            return r, i + 1
    return r, steps


def test_walks_run_to_their_own_end(spark, path_dir):
    d, pairs = path_dir
    for name, sources in (("pagerank", None), ("rwr", {50, 100})):
        want, steps = walk(pairs, sources)
        assert steps > 4 and values(q.QUERIES[name](spark, d)) == pytest.approx(want, abs=2e-9)
    ids, deg = {v for x in pairs for v in x}, Counter(s for s, _ in pairs)
    r = dict.fromkeys(ids, 1.0)
    for _ in range(30):
        new = dict.fromkeys(ids, 0.15 / len(ids))
        for s, t in pairs:
            new[t] += 0.85 * r[s] / deg[s]
        r = new
    assert values(q.QUERIES["pagerank_simple"](spark, d)) == pytest.approx(r, abs=2e-9)


def test_recurrence_takes_all_steps(spark, path_dir):
    d, pairs = path_dir
    val, edge = {v: sum(s == v for s, _ in pairs) for x in pairs for v in x}, {x: 1.0 for x in pairs}
    for i in range(7):
        got = Counter()
        for (_, t), w in edge.items() if i else ():
            got[t] += w
        edge = {(s, t): w + val[s] for (s, t), w in edge.items()}
        val = {v: x + int(got[v]) for v, x in val.items()}
    assert values(q.QUERIES["checkpoint_recurrence"](spark, d)) == val


@pytest.mark.parametrize("mode", ["edge", "vertex"])
def test_label_propagation_ends_by_its_rule(spark, path_dir, monkeypatch, mode):
    seen, run = [], q.lp.run

    def kept(g, s, *a, **kw):
        seen.append((s, run(g, s, *a, **kw)))
        return seen[-1][1]

    monkeypatch.setattr(q.lp, "run", kept)
    out = q.QUERIES[f"lp_run_{mode}"](spark, path_dir[0])
    s, (_, history) = seen[0]
    scores = [h["score"] for h in history]
    still = history[-1]["migrations"] == 0
    level = len(scores) > 3 and abs(1 - scores[-1] / max(scores[-4:-1])) < s.threshold
    assert s.max_iterations == 290 and len(history) < 290 and (still or level)
    assert out.where("part is null or part < 0 or part > 3").count() == 0 and out.count() == 35


def brute_sample(g, kind, k, beta, sigma, tau, seed):
    """samplers.sample in plain Python, on seeds that it is given."""
    from weftgraph.operators import samplers

    deg = {r.id: r.out_deg + r.in_deg for r in g.V.collect()}
    near = defaultdict(list)
    for r in g.A.collect():
        near[r.src].append(r.dst)
    n = g.V.where("declared").count()
    want, first = min(max(k, int(beta * n) + 1), len(deg)), int(sigma * n) + 1
    u = lambda step, i: int(hashlib.md5(f"{seed}:{step}:{i}".encode()).hexdigest()[:8], 16) / 2**32
    nominate = {r.degree: r.nominate_p for r in samplers.gd_probabilities(g.V.groupBy((F.col("out_deg") + F.col("in_deg")).alias("degree")).agg(F.count("*").alias("n")), first).collect()}
    for attempt in range(20):
        ids = [r.id for r in samplers.seeds(g, kind, first, sigma, seed, f"10.{attempt}").collect()]
        if ids:
            break
    part = {i: int(u("10p", i) * k) for i in ids}
    front = set(part)
    for r in range(50):
        size, empty = len(part), [i for i in range(k) if i not in part.values()]
        if size >= want and not empty:
            return part
        if size >= want:
            sizes = Counter(part.values())
            part = {i: empty[int(u(f"{10 + r}n", i) * len(empty))] if u(f"{10 + r}m", i) < 1 - size / k / sizes[p] else p for i, p in part.items()}
            continue
        times = Counter()
        for s in front:
            open_ = sorted((x for x in near[s] if x not in part), key=lambda x: (-deg[x], x))
            times.update([x for x in open_ if u(f"{10 + r}g", x) < nominate[deg[x]]] if kind == "GD" else open_[:tau])
        p = (want - size) / times.total() if times else 0.0
        labels = empty or list(range(k))
        new = {i: labels[int(u(f"{10 + r}l", i) * len(labels))] for i in times if u(f"{10 + r}a", i) < p}
        part |= new
        front = set(new) or set(part)
    raise AssertionError("no full sample")


@pytest.mark.parametrize("kind", ["RD", "HD", "CC", "GD"])
def test_samples_are_finished(spark, kind):
    d = "/root/testdata/sf0.001"
    got = values(q.QUERIES[f"sample_{kind.lower()}"](spark, d))
    g = q._g(spark, d, "uu")
    assert got == brute_sample(g, kind, q.K, 0.15, q.SIGMA_SHARE, q.TAU, q.SEED)
    assert len(got) > 0.15 * g.V.where("declared").count() and set(got.values()) == set(range(q.K))
