"""Hand fixtures with known results, invariants, and the SQL comparison on the smallest tables."""

import glob
import math
import os

import pytest
from pyspark.sql import functions as F

from weftgraph import graph, quality
from weftgraph.functions.rng import ceil3, ceil3_decimal
from weftgraph.graph import Graph
from weftgraph.operators import algorithms, lp, placement, samplers
from weftgraph.plans.pregel import pregel
from weftgraph.plans.sweep import sweep

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def h1(spark):
    return Graph.of(spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 3)], "src long, dst long"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, part int")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_symmetrize_and_degrees(h1):
    assert h1.A.count() == 6 and h1.A.where("is_virtual").count() == 1
    assert rows(h1.V, "id", "out_deg", "in_deg", "sym_deg") == [(1, 1, 1, 1), (2, 2, 1, 2), (3, 1, 2, 2), (4, 1, 1, 1)]
    assert rows(graph.degree_distribution(h1.E), "degree", "n") == [(2, 2), (3, 2)]


def test_quality_by_hand(h1, labels):
    assert rows(quality.loads(h1, labels), "part", "vertices", "real_load", "virtual_load") == [(0, 2, 3, 3), (1, 2, 2, 3)]
    assert tuple(quality.edge_cut(h1, labels).first()) == (4, 1, 4, 2)
    assert tuple(quality.comm_volume(h1, labels).first()) == (1, 2)
    assert tuple(quality.comm_bound(h1, 2).first()) == (5, 6)
    q = quality.loads(h1, labels)
    b = quality.balance(q, 2).first()
    assert (b.real_max_mean, b.real_max_min, b.virtual_max_mean) == (1.2, 1.5, 1.0)
    assert quality.jsd(q, 2).first().jsd_real == pytest.approx(0.007299156760, abs=1e-9)
    assert quality.klu(q, 2).first().klu_real == pytest.approx(0.029049405545, abs=1e-9)
    assert quality.klu(q, 3).first().klu_real == -1.0 and quality.balance(q, 3).first().real_max_min is None


def test_undeclared_targets(spark):
    g = Graph.of(spark.createDataFrame([(1, 2), (2, 9), (1, 2), (None, 3)], "src long, dst long"))
    assert rows(g.V, "id", "declared") == [(1, True), (2, True), (9, False)] and g.E.count() == 2


def test_isolated_vertex_keeps_its_label(spark, h1):
    v = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "id long")
    g = Graph.of(h1.E, v)
    start = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "id long, part int")
    out, _ = lp.run(g, lp.Settings(k=2, max_iterations=3), start)
    assert {r.id: r.part for r in out.collect()}[5] == 1


def test_penalty():
    assert ceil3(0, 100) == 0 and ceil3(1, 1000) == 0.001 and ceil3_decimal(1, 1000) == 0.002 and ceil3(1, 0) == 0


def test_clustering(spark):
    e = [(1, 2), (2, 3), (1, 3), (3, 4)]
    a = Graph.of(spark.createDataFrame(e, "src long, dst long")).A
    assert rows(algorithms.clustering_coefficient(a), "id", "cc_milli") == [(1, 1000), (2, 1000), (3, 333), (4, 0)]


def test_pagerank_by_hand(spark):
    g = Graph.of(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1)], "src long, dst long"))
    got = {r.id: r.rank for r in algorithms.pagerank_simple(g.V.select("id"), g.E, 30).collect()}
    for i, x in {1: 0.393894183709, 2: 0.217862977280, 3: 0.403504358201}.items():
        assert got[i] == pytest.approx(x, abs=1e-9)


def test_walks_keep_their_mass(spark):
    g = Graph.of(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long"))
    for r in (algorithms.pagerank(g.V, g.E), algorithms.rwr(g.V, g.E, g.V.where("id = 1"))):
        assert r.agg(F.sum("rank")).first()[0] == pytest.approx(1.0, abs=1e-9)
    with pytest.raises(ValueError):
        algorithms.rwr(g.V, g.E, g.V.where("id = 77"))


def test_shortest_paths_on_a_ring(spark):
    from weftgraph.sources.readers import ring

    v, e = ring(spark, 4)
    assert {r.id: r.dist for r in algorithms.sssp(v, e, 1).collect()} == {1: 0.0, 2: 100.0, 3: 300.0, 0: 600.0}


def test_components_and_max(spark):
    g = Graph.of(spark.createDataFrame([(1, 2), (2, 3), (4, 5), (0, 7)], "src long, dst long"))
    got = {r.id: r.component for r in algorithms.connected_components(g.V, g.A).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 0: 0, 7: 0}
    m = algorithms.max_propagation(g.V.select("id", F.col("id").alias("value")), g.A)
    assert {r.id: r.value for r in m.collect()} == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5, 0: 7, 7: 7}


def test_deadlock(spark):
    e = spark.createDataFrame([(1, 2, 7), (2, 1, 7)], "src long, dst long, tag long")
    assert rows(algorithms.deadlock_free(e), "id", "free") == [(1, False), (2, False)]
    more = e.union(spark.createDataFrame([(1, 3, 8)], e.schema))
    assert rows(algorithms.deadlock_free(more, 1), "id", "free") == [(1, True), (2, True), (3, True)]


def test_message_sum(spark):
    e = spark.createDataFrame([(101, 1), (102, 1), (103, 1)], "src long, dst long")
    assert algorithms.message_sum(e).first().total == 306


def test_mutations(spark, h1):
    one = spark.createDataFrame([(8, 9)], "src long, dst long")
    v, e = algorithms.mutate_add(h1.V, h1.E, spark.createDataFrame([(20,)], "id long"), one)
    assert v.count() == 7 and e.count() == 6
    v, e = algorithms.mutate_remove(v, e, spark.createDataFrame([(3,)], "id long"), one)
    assert v.count() == 6 and e.count() == 2


def test_triangle_closing(h1):
    assert all(r.times >= 2 for r in algorithms.triangle_closing(h1.A).collect())
    assert algorithms.triangle_closing(h1.A, 1, keep_known=False).where("id = candidate").count() == 0


def test_repartition(spark, labels):
    lab = spark.createDataFrame([(i, i % 4) for i in range(200)], "id long, part int")
    down = {r.id: r.part for r in lp.repartition(lab, 4, -1).collect()}
    assert all(down[i] == i % 4 if i % 4 < 3 else down[i] in (0, 1, 2) for i in range(200))
    up = {r.id: r.part for r in lp.repartition(lab, 4, 1).collect()}
    assert all(p in (i % 4, 4) for i, p in up.items()) and any(p == 4 for p in up.values())
    with pytest.raises(ValueError):
        lp.repartition(lab, 4, 0)


@pytest.fixture(scope="module")
def social(spark):
    """Four dense groups with few edges between them."""
    import random

    r = random.Random(3)
    e = [(i, r.choice([j for j in range(200) if j % 4 == i % 4 and j != i]) if r.random() < 0.9 else r.randrange(200)) for i in range(200) for _ in range(8)]
    return Graph.of(spark.createDataFrame([x for x in e if x[0] != x[1]], "src long, dst long"))


@pytest.mark.parametrize("mode", lp.MODES)
def test_label_propagation_invariants(spark, social, mode):
    out, history = lp.run(social, lp.Settings(k=4, mode=mode, max_iterations=8))
    assert out.count() == 200 and out.where("part is null or part < 0 or part >= 4").count() == 0
    s = quality.summary(social, out, 4).first()
    assert s.local_real + s.cut_real == s.real_edges == social.E.count() and s.vertices == 200
    assert history and s.cut_real_pct < 0.75
    if mode in ("edge", "vertex"):
        assert max(s.real_max_mean, s.v_max_mean) < 1.6


def test_same_labels_at_any_partitioning(spark, social):
    got = []
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(rows(lp.run(social, lp.Settings(k=4, max_iterations=2))[0], "id", "part"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


@pytest.mark.parametrize("kind", ["RD", "HD", "CC", "GD"])
def test_samplers(spark, social, kind):
    s, history = samplers.sample(social, kind, 4, beta=0.2, sigma=0.05, tau=3)
    got = rows(s, "id", "part")
    assert "error" not in history[-1], history
    assert len(got) >= 0.2 * 200 and {p for _, p in got} == {0, 1, 2, 3} and len({i for i, _ in got}) == len(got)
    out, _ = lp.run(social, lp.Settings(k=4, max_iterations=1), s)
    assert out.where("part is null").count() == 0


def test_sweep(social):
    r = sweep(social, ks=(2,), samplings=("RD", "HUBS"), max_iterations=1)
    assert [x["sampler"] for x in r] == ["RD", "HUBS"] and all(x["vertices"] == 200 for x in r)


def test_pregel_halts(spark, social):
    v = social.V.select("id", F.lit(1).cast("long").alias("value"))
    got = pregel(v, social.E, F.col("value"), F.sum, F.col("value") + F.col("msg"), max_steps=5, halt=lambda step, changed: step == 0)
    assert got.where("value > 1").count() > 0


@pytest.mark.parametrize("hub", [3, 100_000])
def test_told_counts_are_a_full_histogram(spark, social, monkeypatch, hub):
    """Counts moved by changes only, over salted hubs or not, are those counted anew."""
    monkeypatch.setattr(lp, "HUB", hub)
    s, a = lp.Settings(k=4, mode="vertex"), lp.dealt(social)
    assert a.count() == social.A.count() and (a.where("salt > 0").count() > 0) == (hub == 3)
    first = social.V.withColumn("part", F.when(F.col("id") % 5 > 0, F.col("id") % 4).cast("int"))
    state = lp.told(lp.blank(first, s), a, s)
    for new in (F.coalesce("part", F.lit(1)), F.when(F.col("id") % 3 == 0, F.lit(2)).otherwise(F.col("part")).cast("int")):
        full = lp.histogram(social.A, first.select("id", "part"), 4)
        assert rows(state.where("total > 0"), "id", "f", "ec", "total") == rows(full.withColumnRenamed("src", "id"), "id", "f", "ec", "total")
        moved = state.withColumns({"old": F.col("part"), "part": new}).withColumn("changed", ~F.col("part").eqNullSafe(F.col("old")))
        first, state = moved, lp.told(moved, a, s)
    full = lp.histogram(social.A, first.select("id", "part", "changed"), 4).withColumnRenamed("src", "id")
    assert rows(state.where("total > 0"), "id", "f", "ec", "total", "active") == rows(full, "id", "f", "ec", "total", "active")


def test_ties(spark, h1):
    start = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, part int")
    for tie in ("random", "any", "min"):
        out, history = lp.run(h1, lp.Settings(k=2, tie=tie, max_iterations=2), start)
        assert out.where("part is null").count() == 0 and len(history) <= 2


def test_job_survives_failed_tasks(spark, social):
    """A task that dies is run again and the labels are the same: nothing depends on the attempt."""
    from pyspark import TaskContext

    first = lp.init_random(social.V, lp.Settings(k=4))

    def fail_once(batches):
        import os
        import tempfile

        mark = os.path.join(tempfile.gettempdir(), f"weft-failed-{os.getppid()}-{TaskContext.get().partitionId()}")
        for b in batches:
            if not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("lost")
            yield b

    broken = first.mapInArrow(fail_once, first.schema)
    if spark.sparkContext.master.startswith("local[") and "," not in spark.sparkContext.master:
        with pytest.raises(Exception, match="lost"):  # a local master runs a task once: the second job is the retry
            broken.collect()
        while True:
            try:
                got = rows(broken, "id", "part")
                break
            except Exception as e:
                assert "lost" in str(e)
    else:
        got = rows(broken, "id", "part")
    assert got == rows(first, "id", "part")


def test_placement(spark, social):
    p = placement.by_hash(social.V, 3)
    assert p.rdd.getNumPartitions() == 3 and p.where("part < 0").count() == 0
    assert placement.by_label(p, 2).rdd.getNumPartitions() == 2


def test_empty_graph(spark):
    g = Graph.of(spark.createDataFrame([], "src long, dst long"))
    assert g.V.count() == 0 and g.A.count() == 0 and graph.counts(g.E).first().n_vertices == 0


def test_queries_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from weftgraph.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")

    def norm(frame):
        frame = frame[sorted(frame.columns)]
        one = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else x
        return sorted((tuple(map(one, r)) for r in frame.astype(object).values.tolist()), key=repr)

    for name in ("q_summary", "q_jsd", "q_klu", "lp_migrate", "lp_first_migration", "lp_score_vertex", "nominate_gd", "cc_cutoff", "rwr", "deadlock_free", "sssp", "connected_components", "checkpoint_recurrence", "mutate_counts", "triangle_closing"):
        assert norm(QUERIES[name](spark, SF).toPandas()) == norm(con.execute(ORACLES[name]).df()), name
