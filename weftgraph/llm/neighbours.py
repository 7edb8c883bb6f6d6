"""Approximate nearest neighbours by adaptive dimension scan (operator 7).

Inverted lists over a seeded random rotation. Centroids are fitted on at most SAMPLE_ROWS distinct
vectors (the smallest hashes, so the same at any partitioning; documented bound); every vector is
indexed. There are about 2 sqrt(n) lists, an eighth of the sample at most. The number of lists that a query
probes is fitted too: the fewest with which the sample's own neighbours are found with `recall`, so clustered
vectors take few and vectors without any structure about half. Equal vectors are folded first, within each
partition and then by hash, keeping the k + 1 smallest ids: no more can be in a result, so a vector that a
third of the rows share is one entry.

1. Each query scans its nearest list, which gives it a threshold: the distance of the k-th found.
2. It takes the threshold to its other lists; a list whose radius puts all of it farther is left out.

A list is stored in blocks of BLOCK vectors, dimensions in columns. A query scans the columns of a
block group by group. After d of D dimensions the partial squared distance of a rotated vector
estimates the whole one as partial * D / d; the hypothesis that the vector is nearer than the
current k-th is rejected when that exceeds threshold * (1 + EPS / sqrt(d))**2, and the vector is
left. Survivors of all dimensions are measured on the original vectors in double precision, ties
to the smaller id. A task holds one block of a list and at most about QUERY_BLOCK queries at a time; a list that is
larger, or that more queries probe, is dealt over several.

Cases: null vectors, zero vectors and those with null or non-finite components take no part, as query
or candidate; nor do null ids. Vectors of different lengths are searched apart. Repeated rows (equal id and
vector) count once. With fewer than k candidates all are returned. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut

SAMPLE_ROWS, BLOCK, QUERY_BLOCK, GROUP, EPS = 16384, 4096, 1024, 16, 2.1


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = col(vec_col).cast("array<double>")
    rows = vectors.select(col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return rows.where(good)


def folded(rows: DataFrame, keep: int) -> DataFrame:
    """(key, v binary, ids array<long>): distinct vectors with their `keep` smallest ids."""

    def local(batches):
        held: dict[bytes, list[int]] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(set(x))[:keep] for x in held.values()], pa.list_(pa.int64()))], names=["v", "ids"])
            held.clear()
            return out

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = held.setdefault((np.array(v) + 0.0).tobytes(), [])  # + 0.0: no negative zero
                got.append(i)
                if len(got) > 64 + 2 * keep:
                    got[:] = sorted(set(got))[:keep]
            if len(held) > 20_000:
                yield flush()
        yield flush()

    part = rows.mapInArrow(local, "v binary, ids array<long>").withColumn("key", F.xxhash64("v"))
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    # two steps, so that a vector in every partition does not gather all partitions' ids at once
    part = part.groupBy("key", "v", (F.spark_partition_id() % 64).alias("salt")).agg(ids)
    return part.groupBy("key", "v").agg(ids)


def packed(rows: DataFrame) -> DataFrame:
    """(id, key, v binary) of each row."""

    def run(batches):
        for b in batches:
            v = [(np.array(x) + 0.0).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary())], names=["id", "v"])

    return rows.mapInArrow(run, "id long, v binary").select("id", F.xxhash64("v").alias("key"), "v")


def fit(index: DataFrame, k: int, recall: float, sample_rows: int = SAMPLE_ROWS, rounds: int = 8) -> tuple[np.ndarray, int]:
    """Centroids by k-means on a bounded sample, and the number of lists to probe."""
    n = index.count()
    rows = index.orderBy("key", "v").limit(sample_rows).select("v").collect()
    if not rows:
        return np.empty((0, 0)), 0
    x = np.array([np.frombuffer(r[0]) for r in rows])
    size = max(1, min(len(x) // 8, int(2 * math.sqrt(n))))
    g = np.random.default_rng(3)
    c = x[g.permutation(len(x))[:size]]
    nearest = lambda: np.concatenate([np.argmin((c * c).sum(1) - 2 * x[i : i + 2048] @ c.T, axis=1) for i in range(0, len(x), 2048)])
    for _ in range(rounds):
        own = nearest()
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=size)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    own, ranks = nearest(), []
    for i in g.permutation(len(x))[:512]:  # in which of its lists, by nearness, are a sample vector's neighbours?
        d = ((x - x[i]) ** 2).sum(1)
        near = np.argsort(d, kind="stable")[: k + 1]
        order = np.argsort(((c - x[i]) ** 2).sum(1), kind="stable")
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        ranks += place[own[near[near != i][:k]]].tolist()
    ranks = np.sort(ranks) if ranks else np.zeros(1, np.int64)
    return c, min(size, int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)]) + 1)


def scan_block(q: np.ndarray, cols: np.ndarray, threshold: float, eps: float = EPS) -> np.ndarray:
    """Places in a block (dim x n, rotated) that no test rejects against squared distance `threshold`."""
    dim, n = cols.shape
    at, part = np.arange(n), np.zeros(n)
    threshold += 1e-9 * max(1.0, float(q @ q))  # rotation rounds: equal vectors stay
    for d in range(0, dim, GROUP):
        diff = cols[d : d + GROUP][:, at] - q[d : d + GROUP, None] if len(at) < n else cols[d : d + GROUP] - q[d : d + GROUP, None]
        part = part + np.einsum("ij,ij->j", diff, diff)
        done = min(dim, d + GROUP)
        if done < dim and threshold < math.inf:
            ok = part * (dim / done) <= threshold * (1 + eps / math.sqrt(done)) ** 2
            at, part = at[ok], part[ok]
        if not len(at):
            break
    return at[part <= threshold] if threshold < math.inf else at


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt((d * d).sum(1))


def _scan(units: DataFrame, turn, k: int) -> DataFrame:
    """(key, v, ids, scores): what each query finds in each unit. units: (list, block, turn, v, ids, key, far);
    rows with a key are queries, with squared distances of at most `far`; `turn` is the rotation."""

    def run(batches):
        r = turn.value[1]

        def results(points, ids, keys, qs, fars):
            x = np.array([np.frombuffer(p) for p in points])
            cols = np.ascontiguousarray((x @ r).T)
            count = np.array([len(i) for i in ids])
            for key, raw, far in zip(keys, qs, fars):
                q = np.frombuffer(raw)
                p = q @ r
                if far == math.inf:
                    # the first vectors give a threshold that holds for k others at least
                    first = np.argsort(((cols[:GROUP, :] - p[:GROUP, None]) ** 2).sum(0), kind="stable")[: 4 * k]
                    near = _exact(q, x[first])
                    o = np.argsort(near, kind="stable")
                    enough = np.searchsorted(np.cumsum(count[first][o]), k + 1)
                    far = math.inf if enough >= len(o) else float(near[o[enough]]) ** 2
                at = scan_block(p, cols, far)
                if len(at):
                    found = sorted((float(s), i) for s, p in zip(_exact(q, x[at]), at) for i in ids[p])[: k + 1]
                    yield key, raw, [i for _, i in found], [s for s, _ in found]

        def flush(part):
            points, asks = [p for p in part if p[2] is None], [p for p in part if p[2] is not None]
            got = list(results([p[0] for p in points], [p[1] for p in points], [p[2] for p in asks], [p[0] for p in asks], [p[3] for p in asks])) if points and asks else []
            types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*got) if got else [[]] * 4, types)], names=["key", "v", "ids", "scores"])

        part, at = [], None
        for b in batches:
            for *unit, v, ids, key, far in zip(*(b.column(c).to_pylist() for c in ("list", "block", "turn", "v", "ids", "key", "far"))):
                if at != unit:
                    if part:
                        yield flush(part)
                    part, at = [], unit
                part.append((v, ids, key, far))
        if part:
            yield flush(part)

    dealt = units.repartition("list", "block", "turn").sortWithinPartitions("list", "block", "turn")
    return dealt.mapInArrow(run, "key long, v binary, ids array<long>, scores array<double>")


def _units(stored: DataFrame, routed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Queries (list, key, v, far) and stored vectors (list, block, v, ids) as units: every block of a list with every
    turn of its queries. Queries of a list are counted first; the counts are one row a list."""
    asked = cut(routed.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("turns")), "asked")
    points = stored.join(F.broadcast(asked), "list").select("list", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "v", "ids", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("far"))
    asks = routed.join(F.broadcast(asked), "list").join(F.broadcast(sizes), "list")
    asks = asks.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("v"), "turns").cast("int").alias("turn"), "v", F.lit(None).cast("array<long>").alias("ids"), "key", "far")
    return points.unionByName(asks)


def _best(got: DataFrame, k: int) -> DataFrame:
    """(key, v, best): the k + 1 nearest (score, id) of all that a query found, salted first."""
    zipped = F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("id"))
    top = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k + 1).alias("best")
    part = got.groupBy("key", "v", (F.spark_partition_id() % 16).alias("salt")).agg(top(zipped))
    return part.groupBy("key", "v").agg(top("best"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.97, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of every query, its own id left out."""
    spark = vectors.sparkSession
    vectors, queries = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    lengths = sorted(r[0] for r in queries.select(F.size("v")).distinct().collect())
    out = None
    for n in lengths:
        got = _search(*(x.where(F.size("v") == n) for x in (vectors, queries)), k, recall)
        out = got if out is None else out.union(got)
    if out is None:
        out = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    return out.withColumnRenamed("id", id_col)


def _search(vectors: DataFrame, queries: DataFrame, k: int, recall: float) -> DataFrame:
    """search() of usable vectors of one length."""
    spark = vectors.sparkSession
    index = cut(folded(vectors, k + 1), "vectors")
    asked = cut(packed(queries).distinct(), "queries")
    centres, probes = fit(index, k, recall)
    n_lists = len(centres)
    if not n_lists:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    held = spark.sparkContext.broadcast((centres, rotation(centres.shape[1])))  # SAMPLE_ROWS / 8 x dim numbers at most

    def assign(batches):
        c, _ = held.value
        for b in batches:
            x = np.array([np.frombuffer(v) for v in b.column("v").to_pylist()]) if b.num_rows else np.empty((0, c.shape[1]))
            own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(_exact(c[own], x)), *b.columns], names=["list", "radius", "key", "v", "ids"])

    lists = cut(index.mapInArrow(assign, "list int, radius double, key long, v binary, ids array<long>"), "lists")
    sizes = cut(lists.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("radius").alias("radius")), "list-sizes")
    radius = np.full(n_lists, -np.inf)
    for r in sizes.select("list", "radius").collect():  # one row a list
        radius[r[0]] = r[1]
    stored = lists.join(F.broadcast(sizes), "list").select("list", F.pmod("key", "blocks").cast("int").alias("block"), "v", "ids")

    def route(nearest):
        def run(batches):
            c, _ = held.value
            full = np.flatnonzero(radius >= 0)
            for b in batches:
                lists = []
                for v, far in zip(b.column("v").to_pylist(), b.column("far").to_pylist()):
                    d = _exact(np.frombuffer(v), c[full])
                    o = np.argsort(d, kind="stable")[:probes]
                    if nearest:
                        o = o[:1]
                    else:
                        o = o[1:][d[o[1:]] - radius[full[o[1:]]] <= math.sqrt(far) + 1e-9]
                    lists.append(full[o].astype(np.int32).tolist())
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), b.column("far"), pa.array(lists, pa.list_(pa.int32()))], names=["key", "v", "far", "lists"])

        return run

    def routed(rows, nearest):
        got = rows.mapInArrow(route(nearest), "key long, v binary, far double, lists array<int>")
        return got.select("key", "v", "far", F.explode("lists").alias("list"))

    plain = asked.select("key", "v").distinct().withColumn("far", F.lit(math.inf))
    first = cut(_best(_scan(_units(stored, cut(routed(plain, True), "routed"), sizes), held, k), k), "first")
    far = F.when(F.size("best") > k, F.pow(F.element_at("best", k + 1)["score"], 2)).otherwise(F.lit(math.inf))
    rest = cut(routed(first.select("key", "v", far.alias("far")), False), "routed")
    found = _scan(_units(stored, rest, sizes), held, k).unionByName(first.select("key", "v", F.col("best.id").alias("ids"), F.col("best.score").alias("scores")))
    best = cut(_best(found, k), "best")
    named = asked.select("key", "v", F.col("id").alias("query_id")).join(best, ["key", "v"])
    own = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = named.select("query_id", F.posexplode(own).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("id"), F.col("b.score").alias("score"))
