"""What a step of label propagation costs beside its rows: jobs and compiled code."""

import random

import pytest

from weftgraph.graph import Graph
from weftgraph.operators import lp


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(3)
    e = [(i, r.choice([j for j in range(200) if j % 4 == i % 4 and j != i]) if r.random() < 0.9 else r.randrange(200)) for i in range(200) for _ in range(8)]
    return Graph.of(spark.createDataFrame([x for x in e if x[0] != x[1]], "src long, dst long"))


@pytest.mark.parametrize("mode", ["edge", "vertex"])
def test_a_step_is_two_jobs_and_compiles_nothing(spark, mixed, mode):
    seen = []

    def count(*_):
        compiled = spark._jvm.org.apache.spark.metrics.source.CodegenMetrics.METRIC_COMPILATION_TIME().getCount()
        seen.append((spark._jsparkSession.sharedState().statusStore().executionsCount(), compiled))

    _, history = lp.run(mixed, lp.Settings(k=4, mode=mode, max_iterations=8), on_step=count)
    assert len(history) == 8 and all(h["migrations"] for h in history)
    late = seen[2:]
    assert [b[0] - a[0] for a, b in zip(late, late[1:])] == [2] * 5
    assert late[-1][1] == late[0][1]


@pytest.mark.parametrize("mode, hub", [("edge", 3), ("vertex", 3), ("vertex", 100_000)])
def test_lists_hold_every_edge(spark, mixed, monkeypatch, mode, hub):
    monkeypatch.setattr(lp, "HUB", hub)
    s = lp.Settings(k=4, mode=mode)
    a = lp.dealt(mixed)
    lists = lp.gathered(a, s)
    kind = ["is_virtual"] if mode == "vertex" else []
    cols = ["src", "dst", "salt", "weight", *kind]
    assert lists.count() < a.count()
    assert sorted(lists.selectExpr("explode(srcs) AS src", *cols[1:]).collect()) == sorted(a.select(*cols).collect())
    state = lp.blank(lp.init_random(mixed.V, s), s)
    counted = [sorted(map(str, lp.told(state, x, s).collect())) for x in (a, lists)]
    assert counted[0] == counted[1]


def test_pairs_make_the_same_graph(spark):
    """Repeated and reversed edges, loops, null ends, no edges."""
    from weftgraph.graph import pairs

    r = random.Random(5)
    some = [(r.randrange(30), r.randrange(30)) for _ in range(300)] + [(None, 1), (2, None), (40, 40), (7, 50), (7, 50)]
    for rows in (some, []):
        e = spark.createDataFrame(rows, "src long, dst long")
        p = pairs(e)
        one, two = Graph.of(e, weight=3), Graph.of_pairs(p, weight=3)
        assert p.count() == len({tuple(sorted(x)) for x in rows if None not in x})
        for a, b in ((one.V, two.V), (one.A, two.A), (one.E, two.E)):
            assert a.columns == b.columns and a.dtypes == b.dtypes and sorted(a.collect()) == sorted(b.collect())
