"""Queries of the readers and sinks: a graph of the star schema is written as text and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality
from .functions.loops import _home, cut
from .queries import K, _e, _g, _lab, base, query
from .sources import readers, writers

SEPARATOR = {readers.BLANK: " ", readers.CTRL: "\x01", readers.TAB: "\t"}


def _text(lines: DataFrame, name: str) -> str:
    """Write lines to the shared folder; the path."""
    path = f"{_home(lines.sparkSession)}/{uuid.uuid4().hex}-{name}"
    writers._write(lines, path)
    return path


def _lines(spark, d, lay: readers.Layout) -> DataFrame:
    """The chain graph, labels id % K, in a layout."""
    sep, e = SEPARATOR[lay.sep], _e(spark, d)
    tag = lambda c, on: F.concat_ws("_", F.col(c).cast("string"), (F.col(c) % K).cast("string")) if on else F.col(c).cast("string")
    src, dst = tag("src", lay.part != "none"), tag("dst", lay.part != "none" and lay.both)
    if lay.kind == "adjacency":
        return e.groupBy("src").agg(F.array_join(F.sort_array(F.collect_list(dst)), sep).alias("ns")).select(F.concat_ws(sep, src, "ns"))
    if lay.kind == "labels":
        v = e.select("src").distinct()
        return v.select(src if lay.part != "none" else F.concat_ws(sep, "src", F.when(F.col("src") % 3 != 0, (F.col("src") % K).cast("string"))))
    weighted = isinstance(lay.weight, str)
    w = F.when((F.col("src") % 3 != 0) | F.lit(lay.weight == "required"), ((F.col("src") + F.col("dst")) % 100).cast("string"))
    return e.select(F.concat_ws(sep, src, dst, w) if weighted else F.concat_ws(sep, src, dst))


def _read_sql(lay: readers.Layout) -> str:
    num = {"int": "INTEGER", "float": "FLOAT", "double": "DOUBLE"}[lay.weight_type]
    if lay.kind == "labels":
        part = f"src % {K}" if lay.part != "none" else f"CASE WHEN src % 3 <> 0 THEN src % {K} END"
        return base() + f"SELECT src AS id, CAST({part} AS INTEGER) AS part FROM (SELECT DISTINCT src FROM e)"
    w = lay.weight
    if isinstance(w, str):
        other = w.split(":")[1] if ":" in w else "NULL"
        w = "(src + dst) % 100" if w == "required" else f"CASE WHEN src % 3 <> 0 THEN (src + dst) % 100 ELSE {other} END"
    kind = "VARCHAR" if lay.ids == "string" else "BIGINT"
    cols = f"CAST(src AS {kind}) AS src, CAST(dst AS {kind}) AS dst, CAST({'NULL' if w is None else w} AS {num}) AS w, {str(lay.virtual).lower()} AS is_virtual"
    if lay.part != "none":
        cols += f", CAST(src % {K} AS INTEGER) AS src_part, CAST({f'dst % {K}' if lay.both else 'NULL'} AS INTEGER) AS dst_part"
    out = f"SELECT {cols} FROM e"
    return base() + (f"SELECT DISTINCT * FROM ({out} UNION ALL {out.replace('FROM e', 'FROM (SELECT dst AS src, src AS dst FROM e)')})" if lay.reverse else out)


def _reader(name: str, lay: readers.Layout):
    @query(f"read_{name}", _read_sql(lay))
    def q(spark, d):
        v, e = readers.read_graph(spark, _text(_lines(spark, d, lay), name), name)
        return v.select("id", "part") if lay.kind == "labels" else e


for _name, _lay in readers.LAYOUTS.items():
    _reader(_name, _lay)


@query("read_ring", "SELECT range AS src, (range + 1) % 1000 AS dst, CAST(100 * range AS FLOAT) AS w, 10.0::DOUBLE * range AS value FROM range(1000)")
def read_ring(spark, d):
    v, e = readers.ring(spark, 1000)
    return e.join(v.withColumnRenamed("id", "src"), "src")


@query("read_generated", "SELECT range AS id, (range + 1) % 30 AS next FROM range(30)")
def read_generated(spark, d):
    return readers.generated(spark, 10, 3, True).join(readers.generated_edges(spark, 10, 3).select(F.col("src").alias("id"), F.col("dst").alias("next")), "id")


@query("read_sources", base() + "SELECT id FROM v WHERE id % 50 = 0")
def read_sources(spark, d):
    return readers.sources(spark, path=_text(_g(spark, d).V.where("id % 50 = 0").select(F.col("id").cast("string")), "sources"))


# -- sinks: the lines that are written ------------------------------------------------------

def _sink(name: str, sql: str):
    def keep(f):
        @query(f"write_{name}", base() + sql)
        def q(spark, d):
            return spark.read.text(_text(f(_g(spark, d)), name)).select(F.col("value").alias("line"))

        return f

    return keep


LABELLED = "SELECT id || '{s}' || part AS line FROM lab"
NAMES = "string_agg({n}, chr(9) ORDER BY dst)"


@_sink("labels_comma", LABELLED.format(s=","))
def _comma(g):
    return writers.label_lines(_lab(g), ",")


@_sink("labels_underscore", LABELLED.format(s="_"))
def _underscore(g):
    return writers.label_lines(_lab(g), "_")


@_sink("labels_tab", "SELECT id || chr(9) || part AS line FROM lab WHERE id % 5 <> 0")
def _tab(g):  # unlabelled vertices are left out
    return writers.label_lines(_lab(g).withColumn("part", F.when(F.col("id") % 5 != 0, F.col("part"))), "\t")


@_sink("labels_value", "SELECT lab.id || chr(9) || part || chr(9) || sym_deg AS line FROM lab JOIN v ON v.id = lab.id")
def _value(g):
    return writers.label_lines(_lab(g).join(g.V.select("id", "sym_deg"), "id"), "\t", "sym_deg")


@_sink("part_real", "SELECT lab.id || '_' || part || coalesce(chr(9) || ns, '') AS line FROM lab LEFT JOIN (SELECT src, " + NAMES.format(n="CAST(dst AS VARCHAR)") + " AS ns FROM e GROUP BY src) n ON n.src = lab.id")
def _part_real(g):
    return writers.adjacency_lines(g.A, g.V, _lab(g), label_source=True)


@_sink("part_all", "SELECT src || '_' || any_value(s.part) || chr(9) || " + NAMES.format(n="dst || '_' || t.part") + " AS line FROM a JOIN lab s ON s.id = src JOIN lab t ON t.id = dst GROUP BY src")
def _part_all(g):
    return writers.adjacency_lines(g.A, labels=_lab(g), label_source=True, label_targets=True, real_only=False)


REAL = "SELECT v.id || coalesce(chr(9) || ns, '') AS line FROM v LEFT JOIN (SELECT src, " + NAMES.format(n="CAST(dst AS VARCHAR)") + " AS ns FROM e GROUP BY src) n ON n.src = v.id"


@_sink("real", REAL)
def _real(g):
    return writers.adjacency_lines(g.A, g.V)


@_sink("adjacency", REAL.replace("chr(9)", "' '"))
def _adjacency(g):
    return writers.adjacency_lines(g.E, g.V, delimiter=" ")


@_sink("skip_isolated", "SELECT src || chr(9) || " + NAMES.format(n="CAST(dst AS VARCHAR)") + " AS line FROM e GROUP BY src")
def _skip(g):
    return writers.adjacency_lines(g.A, skip_isolated=True)


@_sink("metis", "SELECT src || chr(9) || " + NAMES.format(n="CAST(dst AS VARCHAR)") + " AS line FROM e GROUP BY src UNION ALL SELECT count(DISTINCT src) || ' ' || count(*) // 2 FROM a")
def _metis(g):
    return writers.metis_lines(g.A, header=True)


@_sink("degrees", "SELECT v.id || chr(9) || part || chr(9) || out_deg || chr(9) || in_deg AS line FROM v JOIN lab ON lab.id = v.id")
def _degrees(g):
    return writers.degree_lines(g.V, _lab(g))


@_sink("values", "SELECT id || chr(9) || sym_deg AS line FROM v")
def _values(g):
    return writers.value_lines(g.V, "sym_deg")


@_sink("distribution", "SELECT degree || ',' || n AS line FROM (SELECT out_deg + in_deg AS degree, count(*) AS n FROM v GROUP BY 1)")
def _distribution(g):
    dist = g.V.groupBy((F.col("out_deg") + F.col("in_deg")).alias("degree")).agg(F.count("*").alias("n"))
    return dist.select(F.concat_ws(",", F.col("degree").cast("string"), F.col("n").cast("string")))


@query("quality_job", base() + """, j AS (SELECT a.src, s.part AS sp, t.part AS dp, NOT a.is_virtual AS real FROM a JOIN lab s ON s.id = a.src JOIN lab t ON t.id = a.dst),
m AS (SELECT 'local_real' AS key, count(*) FILTER (WHERE real AND sp = dp) AS value FROM j UNION ALL SELECT 'cut_real', count(*) FILTER (WHERE real AND sp <> dp) FROM j
UNION ALL SELECT 'cut_virtual', count(*) FILTER (WHERE sp <> dp) FROM j UNION ALL SELECT 'vertices', count(*) FROM v
UNION ALL SELECT 'vertices_' || part, count(*) FROM lab GROUP BY part UNION ALL SELECT 'real_load_' || part, sum(out_deg) FROM v JOIN lab ON lab.id = v.id GROUP BY part)
SELECT key, CAST(value AS DOUBLE) AS value FROM m""")
def quality_job(spark, d):
    """Reads a labelled graph, measures it, writes the metrics file and reads that: its whole-number keys."""
    g = _g(spark, d)
    lines = writers.adjacency_lines(g.A, g.V, _lab(g), label_source=True, delimiter=" ")
    v, e = readers.read_graph(spark, _text(lines, "quality-input"), "quality_input")
    read = cut(e.select("src", "dst"), "read")
    from .graph import Graph

    m = quality.metrics(Graph.of(read, v), v.select("id", "part"), K)
    file = readers.run_metrics(spark, _text(m.select(F.concat_ws(",", "key", F.col("value").cast("string"))), "metrics"))
    keys = [f"{c}_{i}" for c in ("vertices", "real_load") for i in range(K)] + ["local_real", "cut_real", "cut_virtual", "vertices"]
    return file.where(F.col("key").isin(keys)).select("key", F.col("value").cast("double").alias("value"))
