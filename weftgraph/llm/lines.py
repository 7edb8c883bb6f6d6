"""Line dedup by levelled sorted runs (operator 3).

A run is a table of line hashes, sorted within hash partitions: (h1, h2, n, last), the 128-bit
hash of a line's key, the number of documents that hold it and the largest id among them. A batch
of documents becomes one run of level 0. When a level holds `fanout` runs, a compaction merges
them into one run of the next level, so a store of N batches has O(log N) runs and rewrites each
row O(log N) times. A batch is cleaned by merge-anti-joining its lines with the runs.

`dedup_lines` feeds a corpus to the store in batches by a hash of the id (all rows, each in one; ids of any
ordered type), then anti-joins every line with the merged runs: a key found in at least `min_docs` documents
loses its lines except in the largest id that holds it. `drop_seen` is the incremental form: a
new batch loses the lines that the store already has often enough, and is then added.

The merge of runs and the joins with them are Spark's: they deal and sort the rows again, so that a line of a third
of all documents can be split; the order that the runs are stored in saves them nothing.

Only lines are exploded, never one document's group into one task; a line that a third of the
documents share is aggregated before the shuffle, and its join is one that AQE can split.

Cases: null or empty text is one empty line. Each row is a document of its own, also if its id
repeats; a null id counts as smaller than any other. Rows with the largest id all keep the line.
A key that only null ids hold is kept in all of them. The whole input row is returned as struct
`doc`, so no column name can clash. An empty table gives an empty table. Hashes are two
independent 64-bit ones; a chance collision needs about 2**64 different lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, col, cut, drop

BLANKS = " \t\n\x0b\x0c\r"
BATCHES, FANOUT = 4, 4


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, id_col: str, text_col: str, min_len: int) -> DataFrame:
    """(id, th, pos, h1, h2) of every line whose key is long enough; th tells rows of one id apart."""
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    out = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    out = out.where(F.length("line") >= min_len).withColumn("key", key).where(F.length("key") >= min_len)
    low = ascii_lower(F.col("key"))
    return out.select("id", "th", "pos", F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(7), low, F.lit("b")).alias("h2"))


class RunStore:
    """Levels of sorted runs in the shared folder; the driver holds their names only."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

    def _write(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(cut(run.sortWithinPartitions("h1", "h2"), f"run-level-{level}"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merge(full), level + 1)
            drop(*full)

    def add(self, docs: DataFrame, id_col: str, text_col: str, min_len: int) -> None:
        """The batch's lines, once for each document, as a run of level 0."""
        # a document's repeats of a line are folded within its array, before any shuffle
        text = F.array_distinct(F.transform(_lines(F.col(text_col)), lambda x: ascii_lower(F.btrim(x, F.lit(BLANKS)))))
        key = F.explode(F.filter(text, lambda x: F.length(x) >= min_len)).alias("key")
        keyed = docs.select(F.col(id_col).alias("id"), key)
        hashed = keyed.select("id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key", F.lit("b")).alias("h2"))
        self._write(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last")), 0)

    def merged(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return None if not runs else runs[0] if len(runs) == 1 else self._merge(runs)


def _anti(docs: DataFrame, seen: DataFrame | None, id_col: str, text_col: str, min_len: int) -> DataFrame:
    """docs without the lines of `seen` (h1, h2, last), but for those of the id `last`."""
    lines = _lines(F.col(f"doc.{text_col}"))
    base = docs.select(F.struct("*").alias("doc"))
    if seen is None:
        return base.select("doc", F.coalesce(f"doc.{text_col}", F.lit("")).alias("kept"), F.size(lines).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    hit = _keyed(docs, id_col, text_col, min_len).join(seen, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last")))
    drops = hit.groupBy("id", "th").agg(F.collect_set("pos").alias("drops"))
    base = base.withColumn("th2", F.xxhash64(f"doc.{text_col}"))
    both = base.join(drops, F.col(f"doc.{id_col}").eqNullSafe(F.col("id")) & (F.col("th2") == F.col("th")), "left")
    kept = F.when(F.col("drops").isNull(), F.coalesce(f"doc.{text_col}", F.lit(""))).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drops", i)), "\n")
    )
    gone = F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long")
    return both.select("doc", kept.alias("kept"), F.size(lines).cast("long").alias("n_lines"), gone.alias("n_dropped"))


def drop_seen(batch: DataFrame, store: RunStore, id_col: str = "doc_id", text_col: str = "text", min_len: int = 40, min_docs: int = 1) -> DataFrame:
    """(doc, kept, n_lines, n_dropped): a new batch without the lines of earlier batches; adds its own."""
    seen = store.merged()
    if seen is not None:
        seen = seen.where(F.col("n") >= min_docs).select("h1", "h2")
    out = cut(_anti_all(batch, seen, id_col, text_col, min_len), "batch")
    store.add(out.select(f"doc.{id_col}", F.col("kept").alias(text_col)), id_col, text_col, min_len)
    return out


def _anti_all(batch, seen, id_col, text_col, min_len):
    """As _anti, where no row may keep a seen line: ids are replaced by a number that is never null."""
    if seen is None:
        return _anti(batch, None, id_col, text_col, min_len)
    wrapped = batch.select(F.struct("*").alias("row"), F.xxhash64(id_col).alias("rid"), F.col(text_col).alias("rtext"))
    out = _anti(wrapped, seen.withColumn("last", F.lit(None).cast("long")), "rid", "rtext", min_len)
    return out.select(F.col("doc.row").alias("doc"), "kept", "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 40, min_docs: int = 5, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc, kept, n_lines, n_dropped) for every row of docs."""
    spark = docs.sparkSession
    store = RunStore(spark, fanout)
    for k in range(batches):
        store.add(docs.where(F.pmod(F.xxhash64(col(id_col)), F.lit(batches)) == k), id_col, text_col, min_len)
    seen = store.merged().where(F.col("n") >= min_docs).select("h1", "h2", "last")
    return _anti(docs, seen, id_col, text_col, min_len)
