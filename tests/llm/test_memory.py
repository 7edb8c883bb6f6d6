"""What workers and executors hold: bounded batches and row groups, nothing left behind by other operators."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from weftgraph.functions.loops import cut
from weftgraph.llm import common


def test_batches_of_wide_rows_are_bounded(spark):
    common.small_batches(spark)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "size"])

    rows = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    got = rows.mapInArrow(run, "rows long, size long").collect()
    assert sum(r["rows"] for r in got) == 3000
    assert max(r["size"] for r in got) <= 12 << 20


def test_tables_have_small_row_groups(spark):
    def run(batches):
        for b in batches:
            out = [np.random.default_rng(i).bytes(20_000) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "data"])

    t = cut(spark.range(0, 2000, 1, 1).mapInArrow(run, "id long, data binary"), "groups")
    at = t._weft_path.removeprefix("file://")
    files = [pq.ParquetFile(os.path.join(at, f)) for f in os.listdir(at) if f.endswith(".parquet")]
    assert sum(f.metadata.num_rows for f in files) == t.count() == 2000
    assert max(f.metadata.row_group(g).total_byte_size for f in files for g in range(f.num_row_groups)) <= 16 << 20


def test_what_one_operator_kept_goes_before_the_next():
    mine, other = common.KEPT.setdefault("mine", {}), common.KEPT.setdefault("other", {})
    mine["x"] = other["x"] = bytes(1)
    assert list(common.lean(lambda batches: iter(batches), "mine")([1, 2])) == [1, 2]
    assert mine and not other


def test_freed_memory_goes_back():
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGESIZE")

    def run(batches):
        held = [[np.ones(1000) for _ in range(20_000)] for _ in range(1)]  # 160 MB, small pieces
        pins.append(held[0][-1])  # the last piece stays, so the heap cannot shrink from its top
        yield from batches

    pins, before = [], resident()
    assert list(common.lean(run)([1])) == [1]
    assert resident() - before < 60 << 20
