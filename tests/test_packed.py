"""Label propagation over packed lists: the labels of the plans, one job a step."""

import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import queries as q
from weftgraph.functions.rng import uniform
from weftgraph.graph import Graph
from weftgraph.operators import lp, packed


@pytest.fixture(scope="module")
def edges(spark):
    """Groups, a hub, repeated and reversed edges, loops, null ends, negative ids."""
    r = random.Random(7)
    e = [(i, r.choice(range(i % 4, 120, 4)) if r.random() < 0.8 else r.randrange(120)) for i in range(120) for _ in range(6)]
    e += [(0, i) for i in range(1, 120, 3)] + [(i, 0) for i in range(1, 120, 2)] + e[:100] + [(b, a) for a, b in e[:50]]
    e = [(a - 40, b - 40) for a, b in e]
    return spark.createDataFrame(e + [(None, 1), (2, None), (50, 50)], "src long, dst long").repartition(3)


def same(one, two):
    (a, h), (b, k) = one, two
    assert a.dtypes == b.dtypes and sorted(a.collect()) == sorted(b.collect())
    assert [x.pop("score") for x in h] == pytest.approx([x.pop("score") for x in k], abs=1e-9)
    assert h == k and len(h) > 1


@pytest.mark.parametrize("mode, tie, weight", [("edge", "random", 1), ("edge", "any", 3), ("vertex", "random", 1), ("vertex", "min", 3), ("classic", "random", 1), ("hybrid", "any", 1)])
def test_labels_are_those_of_the_plans(spark, edges, monkeypatch, mode, tie, weight):
    s = lp.Settings(k=3, mode=mode, tie=tie, max_iterations=5)
    ran, run = [], packed.run
    monkeypatch.setattr(packed, "run", lambda *a, **kw: ran.append(1) or run(*a, **kw))
    monkeypatch.setattr(packed, "CHUNK", 50)
    monkeypatch.setattr(packed, "ROW", 40)
    got = lp.run(Graph.of_raw(edges, weight), s)
    assert ran
    same(got, lp.run(Graph.of(edges, weight=weight), s))


def test_lists_hold_the_graph(spark, edges, monkeypatch):
    monkeypatch.setattr(packed, "CHUNK", 50)
    monkeypatch.setattr(packed, "ROW", 40)
    table, small = packed.lists(edges)
    one, two = Graph.of(edges, weight=3), packed.graph(table, 3)
    assert small and table.count() > 4
    for a, b in ((one.V.select("id", "out_deg", "sym_deg"), two.V), (one.A, two.A), (one.E, two.E)):
        assert a.columns == b.columns and a.dtypes == b.dtypes and sorted(a.collect()) == sorted(b.collect())


@pytest.mark.parametrize("name, most, mode", [("MOST", 119, "edge"), ("MOST", 119, "vertex"), ("OWNED", 20, "edge")])
def test_larger_graphs_are_left_to_the_plans(spark, edges, monkeypatch, name, most, mode):
    s = lp.Settings(k=3, mode=mode, max_iterations=3)
    small = lp.run(Graph.of_raw(edges, 2), s)
    monkeypatch.setattr(packed, "run", None)
    monkeypatch.setattr(packed, "graph", packed.graph if name == "MOST" else None)
    monkeypatch.setattr(packed, "CHUNK", 5)
    monkeypatch.setattr(packed, name, most)
    same(small, lp.run(Graph.of_raw(edges, 2), s))


def test_far_ids_and_no_edges(spark):
    far = [(-(2**63), 2**63 - 1), (2**63 - 1, 5), (5, -(2**63)), (5, 6), (6, 7), (7, 5), (2**40, 5)]
    s = lp.Settings(k=2, max_iterations=3)
    for rows in (far, []):
        e = spark.createDataFrame(rows, "src long, dst long")
        a, b = (lp.run(g, s)[0] for g in (Graph.of_raw(e), Graph.of(e)))
        assert sorted(a.collect()) == sorted(b.collect()) and a.count() == len({x for y in rows for x in y})


@pytest.mark.parametrize("mode", ["edge", "vertex"])
def test_a_step_of_the_query_is_one_job(spark, monkeypatch, mode):
    seen, run = [], q.lp.run
    count = lambda *_: seen.append(spark._jsc.sc().dagScheduler().numTotalJobs())
    monkeypatch.setattr(q.lp, "run", lambda g, s: run(g, s, on_step=count))
    q.QUERIES[f"lp_run_{mode}"](spark, "/root/testdata/sf0.001")
    assert len(seen) > 4 and {b - a for a, b in zip(seen, seen[1:])} == {1}


def test_numbers_are_those_of_spark(spark):
    r = random.Random(1)
    x = [1 + i / 1024 - j / 1000 for i in range(0, 1024, 7) for j in range(0, 900, 37)]
    x += [1 + i / 2560 - j / 1000 for i in range(60) for j in range(60)] + [r.uniform(-3, 3) for _ in range(2000)]
    want = [v.y for v in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 9).alias("y")).collect()]
    assert packed.round9(np.array(x)).tolist() == want
    ids = [0, 1, -5, 2**62, -(2**63)] + list(range(100, 200))
    want = [v.u for v in spark.createDataFrame([(i,) for i in ids], "id long").select(uniform(3, 8).alias("u")).collect()]
    assert (packed.draws(3, 8, np.array(ids)) / 2**32).tolist() == want


def test_workers_need_not_find_the_package(tmp_path):
    """As where only the driver has it on its path."""
    code = """import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", __spark_entry__.queries()["lp_run_edge"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    got = subprocess.run([sys.executable, "-c", code, str(Path(__file__).resolve().parents[1])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 200" in got.stdout, got.stderr[-2000:]
