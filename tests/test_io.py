"""Readers, writers, collators."""

import pytest

from weftgraph.graph import Graph
from weftgraph.sources import readers, writers


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_adjacency(spark, tmp_path):
    v, e = readers.read_graph(spark, put(tmp_path, "a", "1 2 2\n2\t9\n5\n\n"), "long_adjacency")
    assert rows(v, "id", "declared") == [(1, True), (2, True), (5, True)] and rows(e, "src", "dst", "w") == [(1, 2, 2), (2, 9, 2)]


def test_every_layout_reads(spark, tmp_path):
    text = {"labels": "1\t0\n2\t1\n", "edges": "1\t2\t3\n2\t3\t4\n", "adjacency": "1 2 3\n2 3\n"}
    for name, lay in readers.LAYOUTS.items():
        t = text[lay.kind]
        if lay.part != "none":
            t = {"labels": "1_0\n2_1\n", "edges": "1_0\t2_1\t3\n2_1\t3_0\t4\n", "adjacency": "1_0 2_1\n2_1 1_0\n" if lay.both else "1_0 2\n2_1 1\n"}[lay.kind]
        v, e = readers.read_graph(spark, put(tmp_path, name, t), name)
        assert {int(r.id) for r in v.select("id").collect()} == ({1, 2, 3} if lay.reverse else {1, 2}), name
        pairs = {"labels": [], "edges": [(1, 2), (2, 3)], "adjacency": [(1, 2), (1, 3), (2, 3)]}[lay.kind]
        pairs = [(1, 2), (2, 1)] if lay.kind == "adjacency" and lay.part != "none" else pairs
        pairs = sorted({*pairs, *((b, a) for a, b in pairs)}) if lay.reverse else pairs
        assert sorted((int(r.src), int(r.dst)) for r in e.collect()) == pairs, name
        if lay.part != "none" and lay.kind != "labels":
            assert e.where("src_part is not null").count() == e.count(), name


def test_optional_parts_and_weights(spark, tmp_path):
    v, _ = readers.read_graph(spark, put(tmp_path, "p", "1_3\n2\n"), "part_ids")
    assert rows(v, "id", "part") == [(1, 3), (2, None)]
    _, e = readers.read_graph(spark, put(tmp_path, "w", "1\x012\x015\n1\x013\n"), "edges_byte")
    assert rows(e, "dst", "w") == [(2, 5), (3, 1)]
    with pytest.raises(Exception):
        readers.read_graph(spark, put(tmp_path, "r", "1 2\n"), "edges_required")[1].collect()
    with pytest.raises(Exception):
        readers.read_graph(spark, put(tmp_path, "b", "1 x\n"), "long_adjacency")[1].collect()


def test_generators_and_sources(spark, tmp_path):
    assert [r.id for r in readers.generated(spark, 3, 2, True).collect()] == [5, 4, 3, 2, 1, 0]
    assert rows(readers.sources(spark, 4), "id") == [(4,)] and readers.sources(spark).count() == 0
    assert rows(readers.sources(spark, path=put(tmp_path, "s", "3\n4\n")), "id") == [(3,), (4,)]


def test_last_of_repeats_stays(spark, tmp_path):
    _, e = readers.read_graph(spark, put(tmp_path, "d", "1 2 9\n1 3 5\n1 2 10\n1 2 4\n"), "edges_double")
    assert rows(e, "dst", "w") == [(2, 4.0), (3, 5.0)]
    put(tmp_path, "r.csv", "A,9\nB,1\nA,10\n")
    got = readers.collate(readers.run_metrics(spark, str(tmp_path / "r.csv")), ["A", "B"]).first()
    assert (got.A, got.B) == ("10", "1")
    assert rows(readers.generated_edges(spark, 2, 2), "src", "dst") == [(0, 1), (1, 2), (2, 3), (3, 0)]


def test_queries_of_files_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from weftgraph import io_queries  # noqa: F401
    from weftgraph.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name in ("read_edges_byte", "read_edges_tab_part", "read_part_adjacency", "read_labels_tab", "write_part_all", "write_metis", "quality_job"):
        got = QUERIES[name](spark, d)
        names = sorted(got.columns)
        assert rows(got, *names) == sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()), key=repr), name


def test_collate(spark, tmp_path):
    put(tmp_path, "r1.csv", "REAL EC,5\nREAL EC PCT,0.5\n\n")
    put(tmp_path, "GDD_r1.csv", "1,2\n")
    m = readers.run_metrics(spark, str(tmp_path))
    got = readers.collate(m, ["REAL EC", "REAL EC PCT"]).collect()
    assert len(got) == 1 and got[0]["REAL EC"] == "5" and got[0]["REAL EC PCT"] == "0.5"
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "j.log").write_text("run -ca k=4 -ca a.b=x\n messages=17\n")
    r = readers.job_logs(spark, str(logs), ["messages"]).first()
    assert r.args == {"k": "4", "a.b": "x"} and r.messages == 17


def test_writers(spark, tmp_path):
    g = Graph.of(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long"))
    lab = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "id long, part int")
    assert rows(writers.label_lines(lab, "_"), "line") == [("1_0",), ("2_1",)]
    assert rows(writers.adjacency_lines(g.A, g.V), "line") == [("1\t2",), ("2\t1\t3",), ("3",)]
    full = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, part int")
    assert rows(writers.adjacency_lines(g.A, labels=full, label_source=True, label_targets=True, real_only=False), "line") == [("1_0\t2_1",), ("2_1\t1_0\t3_1",), ("3_1\t2_1",)]
    assert rows(writers.metis_lines(g.A, header=True), "line")[-1] == ("3 2",)
    assert rows(writers.degree_lines(g.V, full), "line")[1] == ("2\t1\t2\t1",)
    writers.write_labels(lab, str(tmp_path / "o"))
    v, _ = readers.read_graph(spark, str(tmp_path / "o"), readers.Layout("labels", sep=","))
    assert rows(v, "id", "part") == [(1, 0), (2, 1)]
    writers.write_adjacency(g.A, str(tmp_path / "adj"), vertices=g.V)
    _, e = readers.read_graph(spark, str(tmp_path / "adj"))
    assert rows(e, "src", "dst") == rows(g.E, "src", "dst")
    writers.write_metrics(spark, {"A": 1}, str(tmp_path / "m"))
    writers.append_times(spark, [1, 2], str(tmp_path / "t"))
    writers.write_distribution(spark.createDataFrame([(1, 2)], "degree int, n long"), str(tmp_path / "d"))
    writers.edges_to_adjacency(g.E, str(tmp_path / "e2a"))
    writers.write_nothing(g.V)
