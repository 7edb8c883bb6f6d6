"""Label propagation over packed lists, for graphs of at most MOST vertices: one job a step, nothing shuffled in it.

The edges are dealt once, both directions, to the owner of their first end, deduplicated there by sorting, and written as
binary lists. The driver keeps ids, degrees and a label for each vertex. A step sends a byte for each vertex to all tasks
(its label, and whether it moved); they count the labels of whole lists, score, and return those that would move, each with
its number for the gate; the driver lets them move. Numbers and choices are those of lp, to the bit.
Graphs with more vertices are left to the plans of lp, over the same lists; those with more edges at one owner than OWNED,
as where a vertex has millions of neighbours, to plans over their edges as they came.
"""

from __future__ import annotations

import hashlib
import sys
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.loops import cut, drop
from ..graph import Graph

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not find this package, as with plans

MOST = 2_000_000  # vertices; the driver holds 20 bytes for each, and some more for a step
MOST_K = 127  # labels in a byte, with a bit for those that moved
OWNED = 8_000_000  # directed edges of one owner, 16 bytes each as they are sorted
CHUNK = 1_000_000  # edges dealt together
ROW = 500_000  # edges of a row, beside those of its last vertex

DEALT = "owner int, ids binary, n binary, base long, dst binary, real binary"
LISTS = "ids binary, n binary, outs binary, base long, dst binary, real binary, vertices long, over boolean"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _rows(batches):
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))


def _once(src, dst, real):
    """The distinct (src, dst) in order, real where any of the same is."""
    if not len(src):
        return src, dst, real
    low = min(src.min(), dst.min()).item()
    wide = max(src.max(), dst.max()).item() - low + 1
    if wide < 1 << 31:  # a pair and its kind are one number
        key = ((src - low) * wide + (dst - low)) * 2 + ~real
        key.sort()
        pair = key >> 1
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        pair, real = pair[first], (key[first] & 1) == 0
        src = pair // wide
        return src + low, pair - src * wide + low, real
    at = np.lexsort((~real, dst, src))
    src, dst, real = src[at], dst[at], real[at]
    first = np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])])
    return src[first], dst[first], real[first]


def _runs(src):
    """Where each value of a sorted array begins, and how often it is there."""
    at = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]])) if len(src) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(src))).astype(np.int32)


def _narrow(dst):
    """(base, bytes): 4 bytes a number where the range allows."""
    low = dst.min().item()
    return (low, (dst - low).astype(np.uint32).tobytes()) if dst.max().item() - low < 1 << 32 else (0, dst.tobytes())


def _wide(base, data, n: int):
    return np.frombuffer(data, np.uint32).astype(np.int64) + base if len(data) == 4 * n else np.frombuffer(data, np.int64)


def _owner(ids, owners: int):
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % owners


def _deal(owners: int):
    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
            size += b.num_rows
            if size >= CHUNK:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    def out(held):
        s, d = (np.concatenate(x).astype(np.int64) for x in zip(*held))
        src, dst, real = _once(np.concatenate([s, d]), np.concatenate([d, s]), np.arange(2 * len(s)) < len(s))
        at, n = _runs(src)
        to = _owner(src[at], owners)
        order = np.argsort(to, kind="stable")
        rows = []
        each = np.split(order, np.flatnonzero(np.diff(to[order])) + 1)
        for mine in each:
            edges = _spread(at[mine], n[mine])
            rows.append((int(to[mine[0]]), src[at[mine]].tobytes(), n[mine].tobytes(), *_narrow(dst[edges]), np.packbits(real[edges]).tobytes()))
        return _batch(DEALT, *zip(*rows))

    return run


def _spread(at, n):
    """The places at, at + 1, ... of each run."""
    ends = np.cumsum(n, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - n), n)


def _own(most: int):
    """The lists of an owner's vertices; a row that says so where it has more edges than it may hold."""

    def run(batches):
        held, size, limit = [], 0, CHUNK * 4
        for _, ids, n, base, dst, real in _rows(batches):
            n = np.frombuffer(n, np.int32)
            edges = int(n.sum(dtype=np.int64))
            held.append((np.repeat(np.frombuffer(ids, np.int64), n), _wide(base, dst, edges), np.unpackbits(np.frombuffer(real, np.uint8), count=edges).astype(bool)))
            size += edges
            if size > limit:  # edges that repeat go before more come
                held = [_once(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                limit = max(limit, 2 * size)
                if size > most:
                    yield _batch(LISTS, [b""], [b""], [b""], [0], [b""], [b""], [0], [True])
                    return
        if not held:
            return
        src, dst, real = _once(*(np.concatenate(x) for x in zip(*held)))
        del held
        at, n = _runs(src)
        for mine in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // ROW)) + 1):
            a, b = at[mine[0]], at[mine[-1]] + n[mine[-1]]
            outs = np.add.reduceat(real[a:b].astype(np.int32), at[mine] - a).astype(np.int32)
            row = src[at[mine]].tobytes(), n[mine].tobytes(), outs.tobytes(), *_narrow(dst[a:b]), np.packbits(real[a:b]).tobytes(), len(mine), False
            yield _batch(LISTS, *([x] for x in row))

    return run


def lists(edges: DataFrame) -> tuple[DataFrame | None, bool]:
    """Written rows of LISTS, whole lists of several vertices each, and whether run() may take them; no rows where an owner
    would hold too many edges, or there are none."""
    spark = edges.sparkSession
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    out = cut(e.mapInArrow(_deal(owners), DEALT).repartitionById(owners, F.col("owner")).mapInArrow(_own(OWNED), LISTS), "lists")
    n, over = out.agg(F.sum("vertices"), F.max("over")).first()
    if n and not over:
        return out, n <= MOST
    drop(out)
    return None, False


def _vertices(batches):
    for ids, n, outs in _rows(batches):
        n = np.frombuffer(n, np.int32)
        yield _batch("id long, out_deg long, sym_deg long", np.frombuffer(ids, np.int64), np.frombuffer(outs, np.int32), n)


def _edges(batches):
    for ids, n, base, dst, real in _rows(batches):
        n = np.frombuffer(n, np.int32)
        src = np.repeat(np.frombuffer(ids, np.int64), n)
        dst, real = _wide(base, dst, len(src)), np.unpackbits(np.frombuffer(real, np.uint8), count=len(src)).astype(bool)
        for i in range(0, len(src), 1 << 16):
            at = slice(i, i + (1 << 16))
            yield _batch("src long, dst long, real boolean", src[at], dst[at], real[at])


def graph(table: DataFrame, weight: int) -> Graph:
    """The vertices (id, out_deg, sym_deg) and edges of lists(), for the plans."""
    v = table.select("ids", "n", "outs").mapInArrow(_vertices, "id long, out_deg long, sym_deg long")
    e = table.select("ids", "n", "base", "dst", "real").mapInArrow(_edges, "src long, dst long, real boolean")
    a = e.select("src", "dst", (~F.col("real")).alias("is_virtual"), F.when(F.col("real"), weight).otherwise(1).cast("int").alias("weight"))
    return Graph(v, a, e.where("real").select("src", "dst"))


LINKED = "id binary, at binary, n binary, outs binary, nbr binary, real binary"


def _link(ids):
    """Lists of places among the sorted ids in place of ids."""

    def run(batches):
        known = ids.value
        for own, n, outs, base, dst, real in _rows(batches):
            size = int(np.frombuffer(n, np.int32).sum(dtype=np.int64))
            places = [np.searchsorted(known, x).astype(np.int32).tobytes() for x in (np.frombuffer(own, np.int64), _wide(base, dst, size))]
            yield _batch(LINKED, [own], [places[0]], [n], [outs], [places[1]], [real])

    return run


def draws(seed: int, step: int, ids) -> np.ndarray:
    """The whole numbers below 2 ** 32 whose 2 ** 32nd parts are uniform() of rng."""
    start = f"{seed}:{step}:".encode()
    digests = b"".join([hashlib.md5(start + b"%d" % i).digest() for i in ids.tolist()])
    return np.frombuffer(digests, ">u4").reshape(-1, 4)[:, 0].astype(np.uint32)


def round9(x: np.ndarray) -> np.ndarray:
    """round(x, 9) as Spark has it: half up on the shortest decimal text of each number."""
    from decimal import ROUND_HALF_UP, Decimal

    y = x * 1e9
    out = np.floor(y + 0.5) / 1e9
    for i in np.argwhere(np.abs(y - np.floor(y) - 0.5) < 1e-5):
        out[tuple(i)] = float(Decimal(repr(float(x[tuple(i)]))).quantize(Decimal("1e-9"), ROUND_HALF_UP))
    return out


ASKS = "at binary, best binary, draw binary, score double"


def _step(codes, pf: list[float], s, weight: int, step: int, gate: bool):
    """Those that would move, with their label and their number for the gate, and the sum of the scores."""
    s = SimpleNamespace(**vars(s))
    k, lam, kappa = s.k, float(s.lam), float(s.kappa)

    def run(batches):
        known = np.frombuffer(codes.value, np.uint8)
        for row in _rows(batches):
            yield _batch(ASKS, *([x] for x in one(known, *row)))

    def one(known, ids, at, n, outs, nbr, real):
        at, n = np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)
        m, code = len(at), known[np.frombuffer(nbr, np.int32)]
        rows = np.repeat(np.arange(m), n)
        key = rows * (k + 1) + (code >> 1)
        counts = lambda x: np.bincount(x, minlength=m * (k + 1)).reshape(m, k + 1)[:, :k]
        f = counts(key)
        if s.mode == "vertex" or weight != 1:
            ec = counts(key[np.unpackbits(np.frombuffer(real, np.uint8), count=len(key)).astype(bool)])
            f = f + (weight - 1) * ec
        active = np.zeros(m, bool)
        active[rows[(code & 1).astype(bool)]] = True
        total = f.sum(1)
        heard = total > 0
        h = lam + f / np.maximum(total, 1)[:, None]
        if s.mode == "vertex":
            out = np.frombuffer(outs, np.int32)[:, None]
            share = np.where(out > 0, ec / np.maximum(out, 1), 0.0)
            h = h + lam * (kappa * share - (1 - kappa) * np.array(pf))
        else:
            h = h - lam * np.array(pf)
        h = round9(h)
        top = h.max(1)
        part = (known[at] >> 1).astype(np.int64)
        own = np.where(part < k, h[np.arange(m), np.minimum(part, k - 1)], top)
        moves = heard & active
        if s.tie != "any":
            moves &= (part == k) | (own != top)
        who = np.flatnonzero(moves)
        ties = h[who] == top[who, None]
        pick, some = np.zeros(len(who), np.int64), ties.sum(1)
        own_ids = np.frombuffer(ids, np.int64)
        if s.tie != "min":
            many = np.flatnonzero(some > 1)
            pick[many] = np.floor(draws(s.seed, step, own_ids[who[many]]) / 4294967296.0 * some[many])
        best = np.argmax(np.cumsum(ties, 1) > pick[:, None], 1) if len(who) else pick
        who, best = who[best != part[who]], best[best != part[who]]
        draw = draws(s.seed, step + 1, own_ids[who]) if gate else np.zeros(0, np.uint32)
        return at[who].tobytes(), best.astype(np.uint8).tobytes(), draw.tobytes(), float(own[heard].sum())

    return run


def run(table: DataFrame, weight: int, s, on_step=None) -> tuple[DataFrame, list[dict]]:
    """lp.run over a table of lists(); weight: of real edges."""
    from . import lp

    spark = table.sparkSession
    got = table.select("ids", "n", "outs").toArrow()
    ids, sym, out = (np.frombuffer(b"".join(got[c].to_pylist()), t) for c, t in (("ids", np.int64), ("n", np.int32), ("outs", np.int32)))
    del got
    order = np.argsort(ids)
    ids, sym, out = ids[order], sym[order], out[order]
    size = {"out_deg": out, "sym_deg": sym}[lp.LOAD[s.mode]]
    k, known = s.k, spark.sparkContext.broadcast(ids)
    linked = table.select("ids", "n", "outs", "base", "dst", "real").mapInArrow(_link(known), LINKED).persist(StorageLevel.MEMORY_AND_DISK)

    def start(who, step):
        return np.floor(draws(s.seed, step, ids[who]) / 4294967296.0 * k).astype(np.uint8)

    def loads(part) -> lp.Loads:
        """Unlabelled vertices, of label k, count for nothing."""
        each = [[int(x) for x in np.bincount(part, weights=w, minlength=k + 1)[:k]] for w in (size, None)]
        n, total = sum(each[1]), sum(each[0])
        return lp.Loads(*each, lp.capacity(n if s.mode == "vertex" else total, s), n)

    def asked(part, changed, l, step, gate):
        codes = spark.sparkContext.broadcast((part * 2 + changed).astype(np.uint8).tobytes())
        got = linked.mapInArrow(_step(codes, lp.penalties(l, s), s, weight, step, gate), ASKS).toArrow()
        codes.destroy()
        at, best, draw = (np.frombuffer(b"".join(got[c].to_pylist()), t) for c, t in (("at", np.int32), ("best", np.uint8), ("draw", np.uint32)))
        return at, best, draw, sum(sorted(got["score"].to_pylist()))  # the same sum in any order of the tasks

    try:
        part, step = np.full(len(ids), k, np.uint8), 3
        first = np.arange(len(ids)) if s.mode == "classic" else np.flatnonzero(out > -(-int(out.sum(dtype=np.int64)) // len(ids)))
        part[first] = start(first, 2)
        changed = part < k
        if not changed.all():
            at, best, _, _ = asked(part, changed, loads(part), step, False)
            old, part = part, part.copy()
            part[at] = best
            rest = np.flatnonzero(part == k)
            part[rest] = start(rest, step + 1)
            changed = part != old
            step += 2
        l = loads(part)
        history, window = [], lp.Window(s)
        for it in range(s.max_iterations):
            at, best, draw, score = asked(part, changed, l, step, True)
            w = np.ones(len(at)) if s.mode == "vertex" else size[at]
            wanted = {i: int(x) for i, (x, n) in enumerate(zip(np.bincount(best, weights=w, minlength=k), np.bincount(best, minlength=k))) if n}
            go = draw / 4294967296.0 < np.array(lp.gates(l, wanted, s))[best]
            part, changed = part.copy(), np.zeros(len(ids), bool)
            part[at[go]], changed[at[go]] = best[go], True
            now, moved = loads(part), int(go.sum())
            l.load, l.count = now.load, now.count
            history.append(lp.told_of(step, score, moved, l, s))
            stop = bool(on_step and on_step(step, history[-1]))
            stop = window.level(it, score) or stop
            step += 2
            if stop or (moved == 0 and not wanted):
                break
        labels = spark.createDataFrame(pa.table([pa.array(ids), pa.array(part.astype(np.int32))], ["id", "part"]))
        return cut(labels, "labels"), history
    finally:
        linked.unpersist()
        known.destroy()
        drop(table)
