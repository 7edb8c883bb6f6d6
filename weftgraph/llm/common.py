"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.loops import cut, drop, shared_dir  # noqa: F401  (operators take them from here)

BROADCAST_ROWS = 1_000_000  # rows of at most 24 bytes
DRIVER_EDGES = 500_000  # of 16 bytes
SALT = 32


def col(name: str):
    """The top-level column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(*cols):
    """128 bits (binary) that tell rows apart by the given columns, nulls included."""
    parts = [x for c in cols for x in (c, c.isNull())]
    half = lambda *first: F.lpad(F.hex(F.xxhash64(*first, *parts)), 16, "0")
    return F.unhex(F.concat(half(F.lit(11)), half(F.lit(12), F.lit("b"))))


def only(df: DataFrame, keys: DataFrame, how: str, on) -> DataFrame:
    """Semi or anti join with a written table of narrow keys; broadcast up to BROADCAST_ROWS, shuffled beyond."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def without(docs: DataFrame, gone: DataFrame, key) -> DataFrame:
    """docs less the rows whose key is in the one column of `gone`, a written table; docs may have any column names."""
    name, taken = "gone", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return only(docs, gone.toDF(name), "left_anti", key == F.col(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """A-Z only, unlike lower()."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def smallest_linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id that each is linked with, itself included) of the links a to b."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, low = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(u):
        # both ends are roots; a root hangs on the smallest of its smaller neighbours, then all hang on roots
        np.minimum.at(low, np.maximum(u, v), np.minimum(u, v))
        while (low[low] != low).any():
            low = low[low]
        u, v = low[u], low[v]
        u, v = u[u != v], v[u != v]
    return ids, ids[low]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id in edges; comp is the smallest id it is linked with, itself included.

    Up to DRIVER_EDGES distinct links are joined on the driver, since a round costs some twenty jobs' fixed time
    however few they are. Beyond that, rounds of large-star and small-star (Kiveris et al., 2014) until
    nothing changes, O(log n) of them: each keeps the components and O(edges) rows, and hangs neighbours on
    the smallest id of a neighbourhood. A node with many links is aggregated by a partial min before the shuffle, and
    its joins have one row on the other side, so AQE can split them. Every round is a written
    table, the one before it is deleted; the driver sees three sums. Null ends and self links give no link.
    """
    e = (
        edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = cut(e, "edges")
    if e.count() <= DRIVER_EDGES:
        got = e.toArrow()
        drop(e)
        both = smallest_linked(got["a"].to_numpy(), got["b"].to_numpy())
        return e.sparkSession.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in both], ["id", "comp"]))
    before = None
    while True:
        both = e.select("a", "b").union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        new = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(e)
        e = new
        now = e.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if (now[0] == now[1] and now == before) or now[0] == 0:
            break
        before = now
    roots = e.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("comp"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(roots).distinct()


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20, read: int = 1024) -> None:
    """Texts go to Python `rows` or about `size` bytes at a time, and Parquet is read `read` rows at a time,
    where the session has Spark's defaults (10,000, 64 MB, 4,096), so that the buffers on both sides stay
    small; another setting is left alone. Batches hold all rows at any setting."""
    for key, usual, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size),
        ("spark.sql.parquet.columnarReaderBatchSize", "4096", read),
    ):
        if spark.conf.get(key) == usual:
            spark.conf.set(key, str(value))


#: What operators keep in a worker between tasks, by operator.
KEPT: dict[str, dict] = {}


def begin(own: str | None) -> None:
    """What operators other than `own` have kept in this worker goes."""
    for k, v in KEPT.items():
        if k != own:
            v.clear()


def release() -> None:
    """Memory that was freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def lean(run, own: str | None = None):
    """run, a function for mapInArrow, in a worker that holds nothing of other operators before it and no
    freed memory after it: workers live on between tasks, beside the JVM that runs the next stage."""

    def whole(batches):
        begin(own)
        yield from run(batches)
        release()

    return whole


def slices(batches, rows: int = 512, size: int = 16 << 20):
    """Arrow batches in parts of few rows and about `size` bytes, so that Python holds few texts at
    once; memory that Arrow keeps for later goes back to the system at the end."""
    for b in batches:
        step = max(1, min(rows, int(b.num_rows * size / max(1, b.nbytes))))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
        del b
        pa.default_memory_pool().release_unused()


# -- sums of arrays of a fixed size over all tasks ------------------------------------------

PARTS = "block long, part long, data binary"


def _step(cols: int) -> int:
    return max(1, 32_768 // cols)


def emit(m: np.ndarray):
    """The blocks of an array, with a number of the task that is the salt of the sum."""
    from pyspark import TaskContext

    step = _step(m.shape[1])
    at = list(range(0, len(m), step))
    part = TaskContext.get().partitionId()
    arrays = [pa.array(range(len(at)), pa.int64()), pa.array([part] * len(at), pa.int64()), pa.array([np.ascontiguousarray(m[i : i + step], np.float64).tobytes() for i in at], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["block", "part", "data"])


def summed(parts: DataFrame, rows: int, cols: int) -> np.ndarray:
    """Sum of (block, part, data) arrays of float64, each block a stretch of a rows x cols array: first
    those of SALT tasks, then of SALT * SALT, then all."""

    def add(batches):
        key, total = None, None

        def out():
            arrays = [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([total.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "part", "data"])

        for b in batches:
            for *k, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                x = np.frombuffer(x, np.float64)
                if k == key:
                    total = total + x
                    continue
                if key is not None:
                    yield out()
                key, total = k, x
        if key is not None:
            yield out()

    for _ in range(3):
        parts = parts.select("block", F.floor(F.col("part") / SALT).cast("long").alias("part"), "data")
        parts = parts.repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(lean(add), PARTS)
    got = parts.toArrow()  # rows x cols numbers for each SALT ** 3 tasks
    out = np.zeros(rows * cols)
    step = _step(cols) * cols
    for k, x in zip(got["block"].to_pylist(), got["data"].to_pylist()):
        x = np.frombuffer(x, np.float64)
        out[k * step : k * step + len(x)] += x
    return out.reshape(rows, cols)
