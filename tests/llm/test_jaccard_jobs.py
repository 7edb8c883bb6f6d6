"""The fixed cost of the Jaccard join: jobs that do not grow with the rounds of components or the levels of the search."""

import random

import numpy as np

from weftgraph.llm import common, jaccard

from .test_llm import brute_components, docs, near, words


def jobs(spark, run):
    """What run() returns, and how many jobs it started."""
    name = f"counted-{random.random()}"
    spark.sparkContext.setJobGroup(name, "")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    r = random.Random(5)
    ids = r.sample(range(10**12), 900)
    links = [(ids[i], ids[i + 1]) for i in range(0, 500)] + [(ids[600], x) for x in ids[601:700]] + [(ids[i], ids[r.randrange(700, 900)]) for i in range(700, 900)]
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    parent = {x: root(x) for a, b in links if a != b for x in (a, b)}
    e = spark.createDataFrame(links + [(None, 7), (7, 7)], "a long, b long")
    got, few = jobs(spark, lambda: {x.id: x.comp for x in common.components(e).collect()})
    assert got == parent
    monkeypatch.setattr(common, "DRIVER_EDGES", 0)
    got, many = jobs(spark, lambda: {x.id: x.comp for x in common.components(e).collect()})
    assert got == parent
    assert 0 < few <= 8 < many


def test_least_of_random_links():
    r = np.random.default_rng(6)
    for n, m in ((1, 1), (30, 10), (400, 300), (400, 2000)):
        a, b = r.integers(0, n, m) * 7 - 50, r.integers(0, n, m) * 7 - 50
        ids, low = common.smallest_linked(a, b)
        want = {int(x): int(x) for x in np.concatenate([a, b])}
        for _ in range(len(want)):
            for x, y in zip(a.tolist(), b.tolist()):
                want[x] = want[y] = min(want[x], want[y])
        assert dict(zip(ids.tolist(), low.tolist())) == want


def test_pairs_of_all_levels_are_verified_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_BLOCK", 8)
    levels, checks, absorbed, verified = [], [], jaccard.absorbed, jaccard.verified
    monkeypatch.setattr(jaccard, "absorbed", lambda *x: levels.append(1) or absorbed(*x))
    monkeypatch.setattr(jaccard, "verified", lambda *x: checks.append(1) or verified(*x))
    r = random.Random(9)
    base, other = words(r, 200), words(r, 90)
    rows = [near(r, base, 1) for _ in range(100)] + [near(r, other, 1) for _ in range(3)] + [words(r, 50)]
    texts = [" ".join(w) for w in rows]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(docs(spark, texts)).collect()), key=repr)
    assert got == brute_components(list(enumerate(texts)))
    assert len(levels) >= 2 and len(checks) == 2  # one after all levels of the first search, one after the second search
