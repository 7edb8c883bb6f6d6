"""The registered graph queries, each with the same computation as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, quality
from .functions.loops import cut
from .functions.rng import uniform, uniform_sql
from .graph import SQL, Graph, from_tables
from .operators import algorithms, lp, samplers

K, SEED, SIGMA_SHARE, TAU = 4, 1, 0.05, 3
S = {m: lp.Settings(k=K, mode=m, seed=SEED, tie="min") for m in lp.MODES}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def base(name: str = "chain") -> str:
    return f"""WITH e AS ({SQL[name]}),
a AS (SELECT src, dst, max(r) = 0 AS is_virtual, CAST(1 AS INTEGER) AS weight FROM (SELECT src, dst, 1 AS r FROM e UNION ALL SELECT dst, src, 0 FROM e) GROUP BY src, dst),
v AS (SELECT id, CAST(sum(o) AS BIGINT) AS out_deg, CAST(sum(i) AS BIGINT) AS in_deg, count(*) AS sym_deg, sum(o) > 0 AS declared FROM
  (SELECT id, other, sum(o) AS o, sum(i) AS i FROM (SELECT src AS id, dst AS other, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, src, 0, 1 FROM e) GROUP BY id, other) GROUP BY id),
lab AS (SELECT id, CAST(id % {K} AS INTEGER) AS part FROM v)
"""


def _e(spark, d, name="chain") -> DataFrame:
    return from_tables(spark, d, name)


def _g(spark, d, name="chain") -> Graph:
    """The graph over one written edge list: every part of it reads that table."""
    return Graph.of(cut(_e(spark, d, name), "graph"))


def _raw(spark, d, name="chain") -> Graph:
    """The same graph over the edges as often as the tables have them: lp.run prepares them once."""
    return Graph.of_raw(from_tables(spark, d, name, once=False))


def _lab(g: Graph) -> DataFrame:
    return g.V.select("id", F.pmod("id", F.lit(K)).cast("int").alias("part"))


# -- preparation ---------------------------------------------------------------------------

@query("graph_counts", base() + "SELECT count(*) AS n_vertices, CAST(sum(declared::INT) AS BIGINT) AS n_declared, CAST(sum(out_deg) AS BIGINT) AS n_edges FROM v")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.counts(_e(spark, d))


@query("edge_dedup", base("ps") + "SELECT src, dst FROM e")
def edge_dedup(spark, d):
    return _e(spark, d, "ps")


@query("symmetrize", base() + "SELECT * FROM a")
def symmetrize(spark, d):
    return graph.symmetrize(_e(spark, d))


@query("symmetrize_weighted", base("uu") + """SELECT src, dst, max(o) = 0 AS is_virtual, CAST(CASE WHEN max(o) = 1 AND max(b) = 1 THEN 2 ELSE 1 END AS INTEGER) AS weight
FROM (SELECT src, dst, 1 AS o, 0 AS b FROM e UNION ALL SELECT dst, src, 0, 1 FROM e) GROUP BY src, dst""")
def symmetrize_weighted(spark, d):
    return graph.symmetrize_weighted(_e(spark, d, "uu"))


@query("degrees", base() + "SELECT * FROM v")
def degrees(spark, d):
    return graph.degrees(_e(spark, d))


@query("max_degree", base() + "SELECT max(out_deg + in_deg) AS max_degree FROM v")
def max_degree(spark, d):
    return graph.degrees(_e(spark, d)).agg(F.max(F.col("out_deg") + F.col("in_deg")).alias("max_degree"))


@query("outdegree_hist", base() + "SELECT least(out_deg, 100) AS bucket, count(*) AS n FROM v GROUP BY 1")
def outdegree_hist(spark, d):
    return graph.outdegree_hist(_e(spark, d))


@query("degree_distribution", base() + "SELECT out_deg + in_deg AS degree, count(*) AS n FROM v GROUP BY 1")
def degree_distribution(spark, d):
    return graph.degree_distribution(_e(spark, d))


@query("reverse_union", base("cp") + "SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def reverse_union(spark, d):
    return graph.reverse_union(_e(spark, d, "cp"))


@query("reset_labels", base() + "SELECT id, CAST(NULL AS INTEGER) AS part FROM lab")
def reset_labels(spark, d):
    return lp.reset(_lab(_g(spark, d)))


# -- label propagation ---------------------------------------------------------------------

def _hist_sql(where: str = "") -> str:
    return f"""hist AS (SELECT a.src, l.part AS i, CAST(sum(weight) AS BIGINT) AS f, CAST(sum(CASE WHEN is_virtual THEN 0 ELSE 1 END) AS BIGINT) AS ec
  FROM a JOIN st l ON a.dst = l.id WHERE l.part IS NOT NULL GROUP BY a.src, l.part),
tot AS (SELECT src, sum(f) AS total FROM hist GROUP BY src)"""


def _score_sql(mode: str, state: str) -> str:
    s, size = S[mode], "sym_deg" if mode in ("classic", "hybrid") else "out_deg"
    if mode == "vertex":
        pf = "CASE WHEN c.n > 0 THEN ((1000 * coalesce(p.n, 0) + c.n - 1) // c.n) / 1000.0 ELSE 0 END"
        h = f"{s.lam} + coalesce(f, 0)::DOUBLE / total::DOUBLE + {s.lam} * ({s.kappa} * CASE WHEN out_deg > 0 THEN coalesce(ec, 0)::DOUBLE / out_deg::DOUBLE ELSE 0 END - {1 - s.kappa} * pf)"
    else:
        pf = "CASE WHEN c.cap > 0 THEN ((1000 * coalesce(p.load, 0) + c.cap - 1) // c.cap) / 1000.0 ELSE 0 END"
        h = f"{s.lam} + coalesce(f, 0)::DOUBLE / total::DOUBLE - {s.lam} * pf"
    return f""", st AS ({state}), {_hist_sql()},
pl AS (SELECT part, CAST(sum({size}) AS BIGINT) AS load, count(*) AS n FROM st WHERE part IS NOT NULL GROUP BY part),
c AS (SELECT CAST(floor({'sum(n)' if mode == 'vertex' else 'sum(load)'} * {1 + s.slack} / {K} + 0.5) AS BIGINT) AS cap, CAST(sum(n) AS BIGINT) AS n FROM pl),
pen AS (SELECT CAST(k.i AS INTEGER) AS i, CAST({pf} AS DOUBLE) AS pf, coalesce(p.load, 0) AS load, coalesce(p.n, 0) AS n, c.cap FROM range({K}) k(i) CROSS JOIN c LEFT JOIN pl p ON p.part = k.i),
h AS (SELECT st.id, pen.i, round({h}, 9) AS h FROM st JOIN tot ON st.id = tot.src CROSS JOIN pen LEFT JOIN hist ON hist.src = st.id AND hist.i = pen.i),
mx AS (SELECT id, max(h) AS m FROM h GROUP BY id),
bst AS (SELECT h.id, min(h.i) AS low, max(m) AS m FROM h JOIN mx USING (id) WHERE h = m GROUP BY h.id),
sc AS (SELECT st.id, st.part, st.out_deg, st.sym_deg, CASE WHEN b.m IS NULL OR cur.h = b.m THEN st.part ELSE b.low END AS best,
  CASE WHEN b.m IS NULL THEN 0.0 WHEN st.part IS NULL THEN b.m ELSE cur.h END AS score, b.m IS NOT NULL AS active
  FROM st LEFT JOIN bst b ON b.id = st.id LEFT JOIN h cur ON cur.id = st.id AND cur.i = st.part)
"""


FULL = "SELECT v.id, lab.part, out_deg, sym_deg FROM v JOIN lab USING (id)"
HUBS = f"SELECT id, CASE WHEN out_deg > (SELECT (sum(out_deg) + count(*) - 1) // count(*) FROM v) THEN CAST(floor({uniform_sql(SEED, 2, 'id')} * {K}) AS INTEGER) END AS part, out_deg, sym_deg FROM v"
SCORE_OUT = "SELECT id, part, best, score FROM sc"


def _full(g: Graph) -> DataFrame:
    return g.V.join(_lab(g), "id").select("id", "part", "out_deg", "sym_deg")


def _hubs(g: Graph) -> DataFrame:
    return cut(lp.init_hubs(g.V, lp.hub_threshold(g), S["edge"]).select("id", "part", "out_deg", "sym_deg"), "hubs")


def _scored(g: Graph, v: DataFrame, mode: str, step: int = 3) -> tuple[DataFrame, lp.Loads]:
    v = cut(v, "state")
    l = lp.loads_of(v.where("part is not null"), S[mode])
    return lp.scored(v, lp.histogram(g.A, v, K), l, S[mode], step), l


@query("label_histogram", base() + f", st AS ({FULL}), {_hist_sql()} SELECT src, i AS part, f, ec FROM hist")
def label_histogram(spark, d):
    g = _g(spark, d)
    h = lp.histogram(g.A, _lab(g), K)
    return h.select("src", F.posexplode(F.arrays_zip("f", "ec")).alias("part", "x")).select("src", "part", "x.f", "x.ec").where("f > 0")


def _score_query(mode: str, name: str, state=_full, sql: str = FULL):
    @query(name, base() + _score_sql(mode, sql) + SCORE_OUT)
    def q(spark, d):
        g = _g(spark, d)
        return _scored(g, state(g), mode)[0].select("id", "part", "best", "score")


_score_query("edge", "lp_score_edge")
_score_query("vertex", "lp_score_vertex")
_score_query("classic", "lp_score_classic")
_score_query("edge", "lp_first_score", _hubs, HUBS)
_score_query("hybrid", "lp_hybrid", _hubs, HUBS)

DEMAND = ", dem AS (SELECT best AS i, CAST(sum(out_deg) AS BIGINT) AS demand FROM sc WHERE active AND best IS NOT NULL AND best IS DISTINCT FROM part GROUP BY best)"
MOVED = f""", gate AS (SELECT pen.i, greatest(0.0, CAST(cap - load AS DOUBLE) / demand) AS p FROM pen JOIN dem USING (i)),
moved AS (SELECT sc.id, out_deg, CASE WHEN active AND best IS DISTINCT FROM part AND {uniform_sql(SEED, 4, 'sc.id')} < coalesce(p, 0) THEN best ELSE part END AS part FROM sc LEFT JOIN gate ON gate.i = sc.best)"""


@query("lp_demand", base() + _score_sql("edge", FULL) + DEMAND + " SELECT i AS part, demand FROM dem")
def lp_demand(spark, d):
    g = _g(spark, d)
    return lp.demand(_scored(g, _full(g), "edge")[0], S["edge"])


def _moved(spark, d) -> DataFrame:
    g = _g(spark, d)
    sc, l = _scored(g, _full(g), "edge")
    sc = cut(sc, "scored")
    wanted = {r[0]: r[1] for r in lp.demand(sc, S["edge"]).collect()}  # k rows
    return lp.migrated(sc, lp.gates(l, wanted, S["edge"]), S["edge"], 4)


@query("lp_migrate", base() + _score_sql("edge", FULL) + DEMAND + MOVED + " SELECT id, part FROM moved")
def lp_migrate(spark, d):
    return _moved(spark, d).select("id", "part")


@query("partition_loads", base() + _score_sql("edge", FULL) + DEMAND + MOVED + " SELECT part, CAST(sum(out_deg) AS BIGINT) AS load, count(*) AS vertices FROM moved GROUP BY part")
def partition_loads(spark, d):
    return _moved(spark, d).groupBy("part").agg(F.sum("out_deg").alias("load"), F.count("*").alias("vertices"))


@query("lp_first_migration", base() + _score_sql("edge", HUBS) + f" SELECT id, coalesce(best, part, CAST(floor({uniform_sql(SEED, 4, 'id')} * {K}) AS INTEGER)) AS part FROM sc")
def lp_first_migration(spark, d):
    g = _g(spark, d)
    return lp.first_migration(_scored(g, _hubs(g), "edge")[0], S["edge"], 4).select("id", "part")


@query("init_random", base() + f"SELECT id, CAST(floor({uniform_sql(SEED, 2, 'id')} * {K}) AS INTEGER) AS part FROM v")
def init_random(spark, d):
    return lp.init_random(_g(spark, d).V, S["classic"]).select("id", "part")


@query("init_hubs", base() + f"SELECT id, part FROM ({HUBS})")
def init_hubs(spark, d):
    return _hubs(_g(spark, d)).select("id", "part")


@query("repartition_up", base() + f"SELECT id, CAST(CASE WHEN {uniform_sql(SEED, 2, 'id')} < {1 / (K + 1)} THEN floor({uniform_sql(SEED, '2b', 'id')} * 1) + {K} ELSE part END AS INTEGER) AS part FROM lab")
def repartition_up(spark, d):
    return lp.repartition(_lab(_g(spark, d)), K, 1, SEED)


@query("repartition_down", base() + f"SELECT id, CAST(CASE WHEN part >= {K - 1} THEN floor({uniform_sql(SEED, 2, 'id')} * {K - 1}) ELSE part END AS INTEGER) AS part FROM lab")
def repartition_down(spark, d):
    return lp.repartition(_lab(_g(spark, d)), K, -1, SEED)


def _run_step(mode: str, source: str, step: str) -> str:
    """CTEs that score the labels of `source` at a step, ties drawn."""
    s, size = S[mode], "out_deg"
    if mode == "vertex":
        pf = "CASE WHEN c.n > 0 THEN ((1000 * coalesce(p.n, 0) + c.n - 1) // c.n) / 1000.0 ELSE 0 END"
        h = f"{s.lam} + coalesce(f, 0)::DOUBLE / total::DOUBLE + {s.lam} * ({s.kappa} * CASE WHEN out_deg > 0 THEN coalesce(ec, 0)::DOUBLE / out_deg::DOUBLE ELSE 0 END - {1 - s.kappa} * pf)"
    else:
        pf = "CASE WHEN c.cap > 0 THEN ((1000 * coalesce(p.load, 0) + c.cap - 1) // c.cap) / 1000.0 ELSE 0 END"
        h = f"{s.lam} + coalesce(f, 0)::DOUBLE / total::DOUBLE - {s.lam} * pf"
    return f"""st AS (SELECT * FROM {source}),
hist AS (SELECT a.src, l.part AS i, CAST(sum(weight) AS BIGINT) AS f, CAST(sum(CASE WHEN is_virtual THEN 0 ELSE 1 END) AS BIGINT) AS ec, bool_or(l.changed) AS act FROM a JOIN st l ON a.dst = l.id WHERE l.part IS NOT NULL GROUP BY a.src, l.part),
tot AS (SELECT src, sum(f) AS total, bool_or(act) AS active FROM hist GROUP BY src),
pl AS (SELECT part, CAST(sum({size}) AS BIGINT) AS load, count(*) AS n FROM st WHERE part IS NOT NULL GROUP BY part),
c AS (SELECT CAST(floor({'sum(n)' if mode == 'vertex' else 'sum(load)'} * {1 + s.slack} / {K} + 0.5) AS BIGINT) AS cap, CAST(sum(n) AS BIGINT) AS n FROM pl),
pen AS (SELECT CAST(k.i AS INTEGER) AS i, CAST({pf} AS DOUBLE) AS pf, coalesce(p.load, 0) AS load, coalesce(p.n, 0) AS n, c.cap FROM range({K}) k(i) CROSS JOIN c LEFT JOIN pl p ON p.part = k.i),
h AS (SELECT st.id, pen.i, round({h}, 9) AS h FROM st JOIN tot ON st.id = tot.src CROSS JOIN pen LEFT JOIN hist ON hist.src = st.id AND hist.i = pen.i),
mx AS (SELECT id, max(h) AS m FROM h GROUP BY id),
bst AS (SELECT h.id, list(h.i ORDER BY h.i) AS ties, max(m) AS m FROM h JOIN mx ON mx.id = h.id WHERE h = m GROUP BY h.id),
sc AS (SELECT st.*, CASE WHEN b.m IS NULL OR cur.h = b.m THEN st.part ELSE b.ties[1 + CAST(floor({_draw(step, 'st.id')} * len(b.ties)) AS INTEGER)] END AS best,
  CASE WHEN b.m IS NULL THEN 0.0 WHEN st.part IS NULL THEN b.m ELSE cur.h END AS score, coalesce(tot.active, false) AS active
  FROM st LEFT JOIN bst b ON b.id = st.id LEFT JOIN h cur ON cur.id = st.id AND cur.i = st.part LEFT JOIN tot ON tot.src = st.id)"""


def _draw(step: str, col: str) -> str:
    return f"(CAST('0x' || substr(md5('{SEED}:' || ({step}) || ':' || {col}), 1, 8) AS BIGINT) / 4294967296.0)"


def _lp_run_sql(mode: str) -> str:
    """The whole run: first scores and ungated migration, then gated steps until the window of scores is level."""
    s = lp.Settings(k=K, mode=mode)
    used, size, keep = ("n", "1", (s.window + 1) // 2) if mode == "vertex" else ("load", "out_deg", (s.window + 1) // 2)
    first = _run_step(mode, "hub", "3")
    return f"""WITH RECURSIVE {base()[5:]}, hub AS (SELECT *, true AS changed FROM ({HUBS})),
start AS MATERIALIZED (WITH {first} SELECT id, out_deg, sym_deg, part AS old, CAST(coalesce(best, part, CAST(floor({_draw('4', 'id')} * {K}) AS INTEGER)) AS INTEGER) AS part FROM sc),
run AS (SELECT id, part, out_deg, sym_deg, part IS DISTINCT FROM old AS changed, 5 AS step, 0 AS it, CAST([] AS DOUBLE[]) AS scores, false AS done FROM start
UNION ALL (WITH {_run_step(mode, '(SELECT * FROM run WHERE NOT done)', 'st.step')},
dem AS (SELECT best AS i, CAST(sum({size}) AS BIGINT) AS demand FROM sc WHERE active AND best IS NOT NULL AND best IS DISTINCT FROM part GROUP BY best),
gate AS (SELECT pen.i, greatest(0.0, CAST(cap - {used} AS DOUBLE) / demand) AS p FROM pen JOIN dem ON dem.i = pen.i),
mv AS (SELECT sc.*, coalesce(active AND best IS DISTINCT FROM part AND {_draw('sc.step + 1', 'sc.id')} < coalesce(p, 0), false) AS moves FROM sc LEFT JOIN gate ON gate.i = sc.best),
t AS (SELECT sum(score) AS score, bool_or(moves) AS moved, (SELECT count(*) FROM dem) AS wanted FROM mv)
SELECT mv.id, CASE WHEN moves THEN best ELSE part END, out_deg, sym_deg, moves, step + 2, it + 1, list_append(scores, t.score)[-{keep}:],
  it + 1 >= {s.max_iterations} OR (it > 2 AND list_max(scores) <> 0 AND abs(1 - t.score / list_max(scores)) < {s.threshold}) OR (NOT t.moved AND t.wanted = 0)
FROM mv CROSS JOIN t))
SELECT id, part FROM run WHERE step = (SELECT max(step) FROM run)"""


@query("lp_run_edge", _lp_run_sql("edge"))
def lp_run_edge(spark, d):
    return lp.run(_raw(spark, d), lp.Settings(k=K, mode="edge"))[0]


@query("lp_run_vertex", _lp_run_sql("vertex"))
def lp_run_vertex(spark, d):
    return lp.run(_raw(spark, d), lp.Settings(k=K, mode="vertex"))[0]


# -- quality -------------------------------------------------------------------------------

LOADS = ", q AS (SELECT part, count(*) AS vertices, CAST(sum(out_deg) AS BIGINT) AS real_load, CAST(sum(sym_deg) AS BIGINT) AS virtual_load FROM v JOIN lab USING (id) GROUP BY part)"
PER_VERTEX = """, j AS (SELECT a.src, s.part AS sp, t.part AS dp, NOT a.is_virtual AS real FROM a JOIN lab s ON s.id = a.src JOIN lab t ON t.id = a.dst),
pv AS (SELECT src AS id, count(*) FILTER (WHERE real) AS out_deg, count(*) AS sym_deg, count(*) FILTER (WHERE real AND sp = dp) AS lr, count(*) FILTER (WHERE sp = dp) AS la,
  count(DISTINCT dp) FILTER (WHERE real AND sp <> dp) AS cr, count(DISTINCT dp) FILTER (WHERE sp <> dp) AS ca FROM j GROUP BY src)"""
SHARES = f""", f AS (SELECT k.i AS part, coalesce(vertices, 0) AS vertices, coalesce(real_load, 0) AS real_load, coalesce(virtual_load, 0) AS virtual_load,
  CASE WHEN vertices > 0 THEN real_load / vertices::DOUBLE ELSE 0.0 END AS avg_deg FROM range({K}) k(i) LEFT JOIN q ON q.part = k.i),
t AS (SELECT sum(vertices)::DOUBLE AS tv, sum(real_load)::DOUBLE AS tr, sum(virtual_load)::DOUBLE AS tl, sum(avg_deg) AS ta FROM f)"""
FOUR = (("real", "real_load", "tr"), ("virtual", "virtual_load", "tl"), ("v", "vertices", "tv"), ("avg_deg", "avg_deg", "ta"))


def _jsd_sql() -> str:
    u = 1 / K
    one = lambda c, t: f"CASE WHEN {c} > 0 THEN {c} / {t} * ln(({c} / {t}) / (({c} / {t} + {u}) / 2)) ELSE 0 END + {u} * ln({u} / (({c} / {t} + {u}) / 2))"
    return "SELECT " + ", ".join(f"round(sum({one(c, t)}) / (2 * ln(2)), 9) AS jsd_{n}" for n, c, t in FOUR) + " FROM f, t"


def _klu_sql() -> str:
    u = 1 / K
    one = lambda c, t: f"sum(CASE WHEN {c} > 0 THEN {c} / {t} * ln(({c} / {t}) / {u}) ELSE 0 END)"
    return "SELECT " + ", ".join(f"CASE WHEN min({c}) = 0 THEN -1.0 ELSE round({'abs(' + one(c, t) + ')' if n == 'avg_deg' else one(c, t) + f' / ln({K})'}, 9) END AS klu_{n}" for n, c, t in FOUR) + " FROM f, t"


def _q(spark, d):
    g = _g(spark, d)
    return quality.loads(g, _lab(g))


@query("q_loads", base() + LOADS + " SELECT * FROM q")
def q_loads(spark, d):
    return _q(spark, d)


@query("q_edge_cut", base() + PER_VERTEX + " SELECT CAST(sum(lr) AS BIGINT) AS local_real, CAST(sum(out_deg - lr) AS BIGINT) AS cut_real, CAST(sum(la) AS BIGINT) AS local_virtual, CAST(sum(sym_deg - la) AS BIGINT) AS cut_virtual FROM pv")
def q_edge_cut(spark, d):
    g = _g(spark, d)
    return quality.edge_cut(g, _lab(g))


@query("q_comm_volume", base() + PER_VERTEX + " SELECT CAST(sum(cr) AS BIGINT) AS cv_real, CAST(sum(ca) AS BIGINT) AS cv_virtual FROM pv")
def q_comm_volume(spark, d):
    g = _g(spark, d)
    return quality.comm_volume(g, _lab(g))


@query("q_comm_bound", base() + f"SELECT CAST(sum(least({K}, out_deg)) AS BIGINT) AS bound_real, CAST(sum(least({K}, sym_deg)) AS BIGINT) AS bound_virtual FROM v")
def q_comm_bound(spark, d):
    return quality.comm_bound(_g(spark, d), K)


@query("q_balance", base() + LOADS + SHARES + " SELECT " + ", ".join(f"round(max({c}) * {K} / sum({c})::DOUBLE, 9) AS {n}_max_mean, round(max({c}) / nullif(min({c}), 0)::DOUBLE, 9) AS {n}_max_min" for n, c in (("v", "vertices"), ("real", "real_load"), ("virtual", "virtual_load"))) + " FROM f")
def q_balance(spark, d):
    return quality.balance(_q(spark, d), K)


@query("q_avg_degree", base() + LOADS + SHARES + f" SELECT round(sum(real_load) / sum(vertices)::DOUBLE, 9) AS expected, round(max(avg_deg) * {K} / sum(avg_deg), 9) AS max_mean, round(max(avg_deg) / nullif(min(avg_deg), 0), 9) AS max_min FROM f")
def q_avg_degree(spark, d):
    return quality.avg_degree(_q(spark, d), K)


@query("q_jsd", base() + LOADS + SHARES + _jsd_sql())
def q_jsd(spark, d):
    return quality.jsd(_q(spark, d), K)


@query("q_klu", base() + LOADS + SHARES + _klu_sql())
def q_klu(spark, d):
    return quality.klu(_q(spark, d), K)


@query("q_summary", base("ps") + PER_VERTEX + f""", s AS (SELECT part, count(*) AS n, sum(out_deg) AS load FROM pv JOIN lab USING (id) GROUP BY part)
SELECT count(*) AS vertices, CAST(sum(out_deg) AS BIGINT) AS real_edges, CAST(sum(sym_deg) AS BIGINT) AS virtual_edges, CAST(sum(lr) AS BIGINT) AS local_real, CAST(sum(out_deg - lr) AS BIGINT) AS cut_real,
CAST(sum(sym_deg - la) AS BIGINT) AS cut_virtual, CAST(sum(cr) AS BIGINT) AS cv_real, CAST(sum(ca) AS BIGINT) AS cv_virtual, round(sum(out_deg - lr) / sum(out_deg)::DOUBLE, 9) AS cut_real_pct, round(sum(lr) / sum(out_deg)::DOUBLE, 9) AS local_real_pct,
round(sum(cr) / sum(least({K}, out_deg))::DOUBLE, 9) AS cv_real_pct, round(sum(ca) / sum(least({K}, sym_deg))::DOUBLE, 9) AS cv_virtual_pct,
round((SELECT max(load) * {K} / sum(load)::DOUBLE FROM s), 9) AS real_max_mean, round((SELECT max(n) * {K} / sum(n)::DOUBLE FROM s), 9) AS v_max_mean FROM pv""")
def q_summary(spark, d):
    g = _g(spark, d, "ps")
    return quality.summary(g, _lab(g), K)


# -- samplers ------------------------------------------------------------------------------

CC = """, tri AS (SELECT x.src AS id, count(*) AS n FROM a x JOIN a y ON x.src = y.src AND x.dst <> y.dst JOIN a z ON z.src = x.dst AND z.dst = y.dst GROUP BY x.src),
cc AS (SELECT v.id, sym_deg AS degree, round(CASE WHEN sym_deg > 1 THEN coalesce(tri.n, 0)::DOUBLE / (sym_deg * (sym_deg - 1)) ELSE 0 END, 9) AS cc FROM v LEFT JOIN tri USING (id)),
ccm AS (SELECT *, CAST(floor(cc * 1000) AS INTEGER) AS cc_milli FROM cc)"""
SIG = ", sg AS (SELECT CAST(floor(0.05 * count(*) FILTER (WHERE declared)) AS BIGINT) + 1 AS sigma FROM v)"


def _cut_sql(table: str, key: str) -> str:
    return f""", hst AS (SELECT {key} AS key, count(*) AS n FROM {table} GROUP BY 1), rn AS (SELECT key, n, CAST(sum(n) OVER (ORDER BY key DESC) AS BIGINT) AS total FROM hst),
ct AS (SELECT key AS cut, total - n AS before, n AS bucket FROM rn, sg WHERE total >= sigma ORDER BY key DESC LIMIT 1)"""


GD = """, dst AS (SELECT out_deg + in_deg AS degree, count(*) AS n FROM v GROUP BY 1), dt AS (SELECT CAST(sum(n) AS BIGINT) AS v, max(n) AS mx, CAST(sum(n * n) AS BIGINT) AS sq FROM dst),
gd AS (SELECT degree, n, round(n / v::DOUBLE, 9) AS p, round(n / v::DOUBLE * sigma / (sq / v::DOUBLE), 9) AS seed_p, round(n / v::DOUBLE + (1 - mx / v::DOUBLE) / 2, 9) AS nominate_p FROM dst, dt, sg)"""
U10 = uniform_sql(SEED, 10, "v.id")


def _round_sql(seeds: str, pick: str) -> str:
    return f""", sd AS ({seeds}), cand AS (SELECT a.src, a.dst, w.out_deg + w.in_deg AS degree FROM a JOIN sd ON sd.id = a.src JOIN v w ON w.id = a.dst WHERE a.dst NOT IN (SELECT id FROM sd)),
pk AS ({pick}) SELECT dst AS id, count(*) AS nominations FROM pk GROUP BY dst"""


TOP = f"SELECT dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY degree DESC, dst) AS rk FROM cand) WHERE rk <= {TAU}"


def _sigma(g: Graph) -> int:
    return int(SIGMA_SHARE * g.V.where("declared").count()) + 1


def _sample_query(kind: str, sql: str):
    @query(f"nominate_{kind.lower()}", base("uu") + sql)
    def q(spark, d):
        g = _g(spark, d, "uu")
        return samplers.one_round(g, kind, _sigma(g), SIGMA_SHARE, TAU, 0, SEED)


_sample_query("RD", _round_sql(f"SELECT id FROM v WHERE {U10} < {SIGMA_SHARE}", TOP))
_sample_query("HD", SIG + _cut_sql("(SELECT out_deg + in_deg AS dg FROM v)", "dg") + _round_sql(f"SELECT id FROM v, ct, sg WHERE out_deg + in_deg > cut OR (out_deg + in_deg = cut AND {U10} < (sigma - before) / bucket::DOUBLE)", TOP))
_sample_query("CC", SIG + CC + _cut_sql("ccm", "cc_milli") + _round_sql(f"SELECT v.id FROM ccm v, ct, sg WHERE cc_milli > cut OR (cc_milli = cut AND {U10} < (sigma - before) / bucket::DOUBLE)", TOP))
_sample_query("GD", SIG + GD + _round_sql(f"SELECT id FROM v JOIN gd ON gd.degree = v.out_deg + v.in_deg WHERE {U10} < seed_p", f"SELECT dst FROM cand JOIN gd USING (degree) WHERE {uniform_sql(SEED, '11g', 'dst')} < nominate_p"))


def _sample_full(kind: str):
    @query(f"sample_{kind.lower()}")
    def q(spark, d):
        return samplers.sample(_g(spark, d, "uu"), kind, K, sigma=SIGMA_SHARE, tau=TAU, seed=SEED)[0]


for _kind in ("RD", "HD", "CC", "GD"):
    _sample_full(_kind)


@query("hd_cutoff", base("uu") + SIG + _cut_sql("(SELECT out_deg + in_deg AS dg FROM v)", "dg") + " SELECT * FROM ct")
def hd_cutoff(spark, d):
    g = _g(spark, d, "uu")
    hist = g.V.groupBy((F.col("out_deg") + F.col("in_deg")).alias("key")).agg(F.count("*").alias("n"))
    return samplers.cutoff_table(hist, "key", _sigma(g))


@query("cc_cutoff", base("uu") + SIG + CC + _cut_sql("ccm", "cc_milli") + " SELECT * FROM ct")
def cc_cutoff(spark, d):
    g = _g(spark, d, "uu")
    hist = algorithms.clustering_coefficient(g.A).groupBy(F.col("cc_milli").alias("key")).agg(F.count("*").alias("n"))
    return samplers.cutoff_table(hist, "key", _sigma(g))


@query("gd_probabilities", base("uu") + SIG + GD + " SELECT * FROM gd")
def gd_probabilities(spark, d):
    g = _g(spark, d, "uu")
    return samplers.gd_probabilities(g.V.groupBy((F.col("out_deg") + F.col("in_deg")).alias("degree")).agg(F.count("*").alias("n")), _sigma(g))


@query("topk_neighbours", base() + f"SELECT src, dst, CAST(rk AS INTEGER) AS rank FROM (SELECT a.src, a.dst, row_number() OVER (PARTITION BY a.src ORDER BY out_deg + in_deg DESC, a.dst) AS rk FROM a JOIN v ON v.id = a.dst) WHERE rk <= {TAU}")
def topk_neighbours(spark, d):
    g = _g(spark, d)
    return samplers.topk_neighbours(g.A, g.V.select("id", (F.col("out_deg") + F.col("in_deg")).alias("degree")), TAU)


@query("clustering_coefficient", base("uu") + CC + " SELECT id, degree, cc, cc_milli FROM ccm")
def clustering_coefficient(spark, d):
    return algorithms.clustering_coefficient(_g(spark, d, "uu").A)


@query("cc_histogram", base("uu") + CC + " SELECT cc_milli, count(*) AS n FROM ccm GROUP BY 1")
def cc_histogram(spark, d):
    return algorithms.clustering_coefficient(_g(spark, d, "uu").A).groupBy("cc_milli").agg(F.count("*").alias("n"))


@query("neighbour_lists", base("uu") + "SELECT src AS id, len(list(dst)) AS n, list_aggregate(list(dst ORDER BY dst), 'string_agg', ',') AS friends FROM a GROUP BY src")
def neighbour_lists(spark, d):
    out = algorithms.neighbour_lists(_g(spark, d, "uu").A)
    return out.select("id", F.size("friends").cast("long").alias("n"), F.array_join(F.transform("friends", lambda x: x.cast("string")), ",").alias("friends"))


# -- algorithms ----------------------------------------------------------------------------

def _steps(first: str, step: str, n: int) -> str:
    """Unrolled CTEs r0..rn; {p} in step is the one before."""
    return f", r0 AS ({first})" + "".join(f", r{i + 1} AS MATERIALIZED ({step.format(p=f'r{i}', i=i)})" for i in range(n))


DEG = ", dg AS (SELECT src, count(*) AS deg FROM e GROUP BY src), n AS (SELECT count(*) AS n FROM v)"
SUMS = "SELECT e.dst, sum(rank * (1.0::DOUBLE / deg)) AS s FROM e JOIN {p} r ON r.id = e.src JOIN dg ON dg.src = e.src GROUP BY e.dst"


def _loop(first: str, step: str, again: str) -> str:
    """A recursive table r(id, x, step, change): {p} in step is the step before; goes on while `again` holds."""
    return f", r AS ({first} UNION ALL (WITH p AS (SELECT * FROM r WHERE {again}) {step}))"


def _rec(name: str = "chain") -> str:
    return "WITH RECURSIVE " + base(name)[5:]


LAST = "FROM r WHERE step = (SELECT max(step) FROM r)"
SUMS = "SELECT e.dst, sum(rank * (1.0::DOUBLE / deg)) AS s FROM e JOIN p ON p.id = e.src JOIN dg ON dg.src = e.src GROUP BY e.dst"


@query("pagerank_simple", _rec() + DEG + _loop("SELECT id, 1.0::DOUBLE AS rank, 0 AS step FROM v", f"SELECT p.id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(s, 0), step + 1 FROM p CROSS JOIN n LEFT JOIN ({SUMS}) x ON x.dst = p.id", "step < 30") + f" SELECT id, round(rank, 9) AS rank {LAST}")
def pagerank_simple(spark, d):
    g = _g(spark, d)
    return algorithms.pagerank_simple(g.V.select("id"), g.E).select("id", F.round("rank", 9).alias("rank"))


def _walk_sql(sources: str, jump: str) -> str:
    """30 steps, or fewer once the L1 change is below 1e-5; ranks are scaled by the sum of the step before."""
    walk = f"""SELECT q.id, q.rank / CASE WHEN before IS NULL THEN 1.0::DOUBLE ELSE before END AS rank, step, CASE WHEN before IS NULL AND abs(total - 1) >= 1e-12 THEN total END AS before,
  step = 30 OR (step > 2 AND change < 1e-5) AS done FROM (SELECT z.*, sum(rank) OVER () AS total, sum(abs(rank - old)) OVER () AS change FROM
  (SELECT p.id, p.rank AS old, step + 1 AS step, before, 0.85::DOUBLE * (coalesce(s, 0) + (SELECT coalesce(sum(rank), 0) FROM p q WHERE q.id NOT IN (SELECT src FROM dg)) / n) + {jump} AS rank
   FROM p CROSS JOIN n LEFT JOIN ({SUMS}) x ON x.dst = p.id) z) q"""
    return _rec() + DEG + sources + _loop("SELECT id, 1.0::DOUBLE / n AS rank, 0 AS step, NULL::DOUBLE AS before, false AS done FROM v, n", walk, "NOT done") + f" SELECT id, round(rank, 9) AS rank {LAST}"


@query("pagerank", _walk_sql("", "0.15::DOUBLE / n"))
def pagerank(spark, d):
    g = _g(spark, d)
    return algorithms.pagerank(g.V.select("id"), g.E).select("id", F.round("rank", 9).alias("rank"))


@query("rwr", _walk_sql(", so AS (SELECT id FROM v WHERE id % 50 = 0)", "CASE WHEN p.id IN (SELECT id FROM so) THEN 0.15::DOUBLE / (SELECT count(*) FROM so) ELSE 0 END"))
def rwr(spark, d):
    g = _g(spark, d)
    return algorithms.rwr(g.V.select("id"), g.E, g.V.where("id % 50 = 0")).select("id", F.round("rank", 9).alias("rank"))


@query("sssp", _rec() + ", w AS (SELECT src, dst, (1 + (src + dst) % 7)::DOUBLE AS w FROM e)" + _loop("SELECT id, CASE WHEN id = (SELECT min(id) FROM v) THEN 0.0::DOUBLE END AS dist, 0 AS step, true AS changed FROM v",
    "SELECT p.id, least(p.dist, m.d), step + 1, coalesce(m.d < coalesce(p.dist, 'inf'::DOUBLE), false) FROM p LEFT JOIN (SELECT w.dst, min(p.dist + w) AS d FROM p JOIN w ON w.src = p.id GROUP BY w.dst) m ON m.dst = p.id", "(SELECT bool_or(changed) FROM r)") + f" SELECT id, dist {LAST}")
def sssp(spark, d):
    g = _g(spark, d)
    source = g.V.agg(F.min("id")).first()[0]
    return algorithms.sssp(g.V.select("id"), g.E.withColumn("w", (1 + (F.col("src") + F.col("dst")) % 7).cast("double")), source)


@query("connected_components", _rec() + _loop("SELECT id, id AS c, 0 AS step, true AS changed FROM v", "SELECT p.id, least(p.c, m.c), step + 1, coalesce(m.c < p.c, false) FROM p LEFT JOIN (SELECT a.src, min(p.c) AS c FROM a JOIN p ON p.id = a.dst GROUP BY a.src) m ON m.src = p.id", "(SELECT bool_or(changed) FROM r)") + f" SELECT id, c AS component {LAST}")
def connected_components(spark, d):
    g = _g(spark, d)
    return algorithms.connected_components(g.V.select("id"), g.A)


@query("max_propagation", _rec("uu") + _loop("SELECT id, out_deg AS c, 0 AS step, true AS changed FROM v", "SELECT p.id, greatest(p.c, m.c), step + 1, coalesce(m.c > p.c, false) FROM p LEFT JOIN (SELECT e.dst, max(p.c) AS c FROM e JOIN p ON p.id = e.src GROUP BY e.dst) m ON m.dst = p.id", "(SELECT bool_or(changed) FROM r)") + f" SELECT id, c AS value {LAST}")
def max_propagation(spark, d):
    g = _g(spark, d, "uu")
    return algorithms.max_propagation(g.V.select("id", F.col("out_deg").alias("value")), g.E)


@query("out_degree", base("ps") + "SELECT id, out_deg AS degree FROM v")
def out_degree(spark, d):
    g = _g(spark, d, "ps")
    return algorithms.out_degree(g.V, g.E)


@query("in_degree", base("ps") + "SELECT id, in_deg AS degree FROM v")
def in_degree(spark, d):
    g = _g(spark, d, "ps")
    return algorithms.in_degree(g.V, g.E)


@query("triangle_closing", base("uu") + "SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY times DESC, candidate) AS INTEGER) AS rank FROM (SELECT x.src AS id, y.dst AS candidate, count(*) AS times FROM a x JOIN a y ON x.dst = y.src GROUP BY 1, 2 HAVING count(*) >= 2)")
def triangle_closing(spark, d):
    return algorithms.triangle_closing(_g(spark, d, "uu").A)


@query("deadlock_free", base("uu") + ", rq AS (SELECT src, dst, dst % 4 AS tag FROM e WHERE src % 5 <> 0), ids AS (SELECT src AS id FROM rq UNION SELECT dst FROM rq)" + _steps("SELECT id FROM ids WHERE id NOT IN (SELECT src FROM rq)", "SELECT id FROM {p} UNION SELECT src FROM (SELECT rq.src, rq.tag FROM rq LEFT JOIN {p} q ON q.id = rq.dst GROUP BY 1, 2 HAVING count(*) = count(q.id))", 14) + " SELECT id, id IN (SELECT id FROM r14) AS free FROM ids")
def deadlock_free(spark, d):
    e = _e(spark, d, "uu").where("src % 5 <> 0").select("src", "dst", (F.col("dst") % 4).alias("tag"))
    return algorithms.deadlock_free(e)


@query("mutate_add", base() + ", ne AS (SELECT id AS src, id + 5000000000 AS dst FROM v WHERE id % 10 = 0) SELECT src, dst FROM e UNION SELECT src, dst FROM ne")
def mutate_add(spark, d):
    g = _g(spark, d)
    new = g.V.where("id % 10 = 0").select(F.col("id").alias("src"), (F.col("id") + F.lit(5_000_000_000)).alias("dst"))
    return algorithms.mutate_add(g.V, g.E, g.V.limit(0), new)[1]


@query("mutate_remove", base() + "SELECT src, dst FROM e WHERE src % 10 <> 0 AND dst % 10 <> 0 AND NOT (src % 3 = 0 AND dst % 3 = 0)")
def mutate_remove(spark, d):
    g = _g(spark, d)
    return algorithms.mutate_remove(g.V, g.E, g.V.where("id % 10 = 0"), g.E.where("src % 3 = 0 and dst % 3 = 0"))[1]


def _checkpoint_sql(steps: int = 6) -> str:
    out = base() + ", x0 AS (SELECT id, out_deg AS value FROM v), w0 AS (SELECT src, dst, 1.0::DOUBLE AS w FROM e)"
    for i in range(steps + 1):
        new = f"SELECT p.id, p.value + coalesce(m.s, 0) AS value FROM x{i} p LEFT JOIN (SELECT dst, CAST(trunc(sum(w)) AS BIGINT) AS s FROM w{i} GROUP BY dst) m ON m.dst = p.id" if i else "SELECT * FROM x0"
        out += f", w{i + 1} AS MATERIALIZED (SELECT src, dst, w + value AS w FROM w{i} JOIN x{i} ON id = src), x{i + 1} AS MATERIALIZED ({new})"
    return out + f" SELECT id, value FROM x{steps + 1}"


@query("checkpoint_recurrence", _checkpoint_sql())
def checkpoint_recurrence(spark, d):
    g = _g(spark, d)
    return algorithms.checkpoint_recurrence(g.V.select("id", F.col("out_deg").alias("value")), g.E.withColumn("w", F.lit(1.0)))


@query("mutate_counts", base() + """, added AS (SELECT id AS src, id + 5000000000 AS dst FROM v WHERE id % 10 = 0), ne AS (SELECT src, dst FROM e UNION SELECT src, dst FROM added),
nv AS (SELECT id FROM v UNION SELECT dst FROM added), lv AS (SELECT id FROM nv WHERE id % 7 <> 0), le AS (SELECT * FROM ne WHERE src % 7 <> 0 AND dst % 7 <> 0)
SELECT 'add' AS step, (SELECT count(*) FROM nv) AS n_vertices, (SELECT count(*) FROM ne) AS n_edges UNION ALL SELECT 'remove', (SELECT count(*) FROM lv), (SELECT count(*) FROM le)""")
def mutate_counts(spark, d):
    g = _g(spark, d)
    new = g.V.where("id % 10 = 0").select(F.col("id").alias("src"), (F.col("id") + F.lit(5_000_000_000)).alias("dst"))
    v, e = algorithms.mutate_add(g.V, g.E, g.V.limit(0), new)
    v2, e2 = algorithms.mutate_remove(v, e, v.where("id % 7 = 0"), e.limit(0))
    count = lambda step, v, e: v.agg(F.count("*").alias("n_vertices")).crossJoin(e.agg(F.count("*").alias("n_edges"))).select(F.lit(step).alias("step"), "n_vertices", "n_edges")  # noqa: E731  one row each
    return count("add", v, e).unionByName(count("remove", v2, e2))


@query("message_sum", base() + "SELECT dst AS id, CAST(sum(src) AS BIGINT) AS total, count(*) AS messages FROM e GROUP BY dst")
def message_sum(spark, d):
    return algorithms.message_sum(_e(spark, d))


@query("master_broadcast", base() + "SELECT id, CAST(30 AS BIGINT) AS value FROM v")
def master_broadcast(spark, d):
    return algorithms.master_broadcast(_g(spark, d).V)
