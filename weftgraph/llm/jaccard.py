"""N-gram Jaccard join by a count-vector R-tree (operator 4).

A document is the set of its distinct 5-word shingles, hashed to 64 bits (kept to 48 for storage;
the size is that of the 64-bit set). Exact copies of a set form one class; one document stands
for each. Candidate pairs come from cells, so that no task sees the whole corpus:

1. Order. All shingles of all classes are counted in a sketch of fixed size; buckets far above
   the mean hold frequent shingles. Shingles are ordered by (frequency class, hash). Any order
   known to all is exact; this one puts passages that many documents share last.
2. Cells. Two sets with Jaccard >= t share one of their first n - ceil(t n) + 1 shingles. Every
   class is dealt to the cells of these, in the order of their sizes; a cell is parted where a
   size is too small for the next one. Cells of one member, and cells with the same members
   as another, drop out. A frequent shingle is dealt over many tasks and never gathered in one.
3. Points. Hashing shingles into groups gives each class a point, its counts by group. The
   overlap of two sets is at most the sum of the smaller coordinates; an R-tree over points
   bounds whole boxes (sum of min(box top, query)), then single points.
4. First search, in blocks of CELL_BLOCK members of a cell, members in the order of their ids: each
   searches the R-tree of the block's representatives. One that can reach a representative makes
   a pair with the nearest (by the bound) and is absorbed; any other becomes a representative and
   goes into the tree. The representatives of a cell of many blocks are searched again, as a smaller
   cell, for as long as that halves them. Then the pairs of all levels are verified on their sets, once; the links
   make components.
5. Second search, for what absorption may have hidden: in cells that absorbed a member or have many
   blocks, and whose members are not all of one component, all members outside the cell's
   largest component are searched in the trees of all its blocks, for members of other components.
   A task holds one block and CELL_BLOCK of those who ask. Surviving pairs are verified on their sets.
6. All links join in components; members of a class share the class's component.

All links but those of exact copies are found by the R-trees. Nothing is capped or sampled: exact
but for chance collisions of hashes (48 bits within two sets, 128 bits for classes). Pairs within a component
already found need no check, so a group of near copies costs its size, not its square; what
costs the square of a cell, in blocks, are members that cannot reach each other and share a shingle that is
among the rarest fifth of both.

Cases: null or empty text, or blanks only: no shingle, linked with nothing. Fewer than five words:
the sequence is the one shingle. Null ids take no part in links (component null). Rows that share an id
count as one node. Other columns are not read, so names cannot clash. Empty tables: empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, PARTS, col, components, cut, emit, lean, only, slices, small_batches, summed, without

BUCKETS = 21  # bits of the sketch
CELL_BLOCK, LEAF, FAN, COARSE, SALT_ROWS = 2048, 16, 8, 64, 65_536
BAND, BAND_BITS = 1.02, 10  # ratio of sizes in one band, bits of a band's number
CACHE_WORDS = 150_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word):
        v = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:  # longer ones are not kept
            self[word] = v
        return v


def shingles(text: str | None, seen: _Hashes, k: int = 5) -> np.ndarray:
    """The distinct k-word shingles as sorted 64-bit hashes."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if len(seen) > CACHE_WORDS:
        seen.clear()
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, n)
    m = min(n, k)
    out = h[: n - m + 1] * MIX + np.uint64(m)
    for i in range(1, m):
        out ^= out >> np.uint64(31)
        out = (out + h[i : n - m + 1 + i]) * MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def pack(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash."""
    return (s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel().astype(np.int64)


def groups_of(n: int) -> int:
    return 512 if n < 1200 else 2048 if n < 5000 else 8192


def point(s: np.ndarray, n: int) -> bytes:
    """Counts by group, two to a byte; a count beyond 15 stays 15, which keeps every bound valid."""
    g = groups_of(n)
    c = np.minimum(np.bincount(((s >> np.uint64(20)) & np.uint64(g - 1)).astype(np.int64), minlength=g), 15).astype(np.uint8)
    return (c[::2] | c[1::2] << 4).tobytes()


def counts(p: bytes) -> np.ndarray:
    b = np.frombuffer(p, np.uint8)
    out = np.empty(2 * len(b), np.int16)
    out[::2], out[1::2] = b & 15, b >> 4
    return out


def fold(v: np.ndarray, g: int) -> np.ndarray:
    """Counts by fewer groups; the groups of a coarser point are sums of those of a finer one."""
    return v.reshape(-1, g).sum(0, dtype=np.int16)


def reaches(v: np.ndarray, sizes: np.ndarray, q: np.ndarray, n: int, pct: int) -> np.ndarray:
    """Which points can reach pct per cent with q. The sum of smaller coordinates is the size less
    the sum of the amounts by which one point exceeds the other; so written, capped counts do no harm."""
    over = np.maximum(q - v, 0).sum(1)
    under = np.maximum(v - q, 0).sum(1)
    bound = np.minimum(n - over, sizes - under)
    return (100 + pct) * bound >= pct * (n + sizes)


class RTree:
    """Bulk-loaded R-tree over count vectors of one width; boxes keep the largest coordinates and
    the range of sizes. Loaded in the order of size, then of the heaviest coordinates."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        key = points[:, np.argsort(-points.var(0), kind="stable")[:4]] if len(points) > LEAF else points[:, :1]
        self.order = np.lexsort((*key.T[::-1], sizes // max(1, int(sizes.max(initial=1)) // 16)))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, low, high, step = self.points, self.sizes, self.sizes, LEAF
        while len(top) > 1:
            at = np.arange(0, len(top), step)
            top, low, high = np.maximum.reduceat(top, at, 0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high, step))
            step = FAN

    def search(self, q: np.ndarray, n: int, pct: int) -> np.ndarray:
        """Places (in the given order) of points that can reach pct per cent Jaccard with q."""

        def can(top, low, high):
            bound = np.minimum(n - np.maximum(q - top, 0).sum(1), high)
            # 100 * overlap >= pct * (n + m - overlap) for some m of the box
            return ((100 + pct) * bound >= pct * (n + low)) & (100 * np.minimum(n, high) >= pct * np.maximum(n, low))

        if not self.levels:
            at = np.arange(len(self.points))
        else:
            top, low, high, _ = self.levels[-1]
            at = np.flatnonzero(can(top, low, high))
            for level in range(len(self.levels) - 1, -1, -1):
                step = self.levels[level][3]
                count = len(self.points) if level == 0 else len(self.levels[level - 1][0])
                at = (at[:, None] * step + np.arange(step)).ravel()
                at = at[at < count]
                if level and len(at):
                    top, low, high, _ = self.levels[level - 1]
                    at = at[can(top[at], low[at], high[at])]
        at = at[can(self.points[at], self.sizes[at], self.sizes[at])] if len(at) else at
        return self.order[at]


def described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, d0, d1, point, set) of every row; d0 and d1 are a digest of the 64-bit set."""

    def run(batches):
        seen = _Hashes()
        for b in slices(batches):
            out = [[], [], [], [], []]
            for t in b.column(1).to_pylist():
                s = shingles(t, seen)
                d = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                for c, v in zip(out, (len(s), int(d[0]), int(d[1]), point(s, len(s)), pack(s))):
                    c.append(v)
            types = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(out, types)]], names=["id", "n", "d0", "d1", "point", "set"])

    picked = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), "id long, n long, d0 long, d1 long, point binary, set binary")


def frequency_classes(own: DataFrame) -> np.ndarray:
    """Class of each bucket of the sketch: 0, or its count where that stands out."""

    def run(batches):
        total = np.zeros((1 << BUCKETS, 1))
        for b in slices(batches):
            flat = [unpack(x) >> (48 - BUCKETS) for x in b.column("set").to_pylist()]
            if flat:
                total[:, 0] += np.bincount(np.concatenate(flat), minlength=1 << BUCKETS)
        yield emit(total)

    total = summed(own.select("set").mapInArrow(lean(run), PARTS), 1 << BUCKETS, 1)[:, 0]
    mean = total.mean()
    return np.where(total > mean + 6 * math.sqrt(mean) + 8, np.minimum(total, 2**31 - 1), 0).astype(np.int32)


def dealt(own: DataFrame, classes: np.ndarray, pct: int) -> DataFrame:
    """(token, id, salt, hot): the cells of every class, with the band of its size in the last bits of token;
    a hot token is one of a frequent bucket, dealt over a salt for each SALT_ROWS of its bucket."""
    held = own.sparkSession.sparkContext.broadcast(classes)  # fixed size: 8 MB

    def run(batches):
        cls = held.value
        for b in slices(batches):
            tokens, ids, often = [], [], []
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = unpack(x)
                n = len(s)
                p = n - -(-pct * n // 100) + 1
                c = cls[s >> (48 - BUCKETS)]
                at = slice(p) if not c.any() else np.lexsort((s, c))[:p]
                tokens.append(s[at] << BAND_BITS | min(int(math.log(n) / math.log(BAND)), (1 << BAND_BITS) - 1))
                often.append(c[at])
                ids.append(np.full(len(tokens[-1]), i, np.int64))
            if tokens:
                i, c = np.concatenate(ids), np.concatenate(often).astype(np.int64)
                salt = (i * 0x9E3779B1 >> 8) % (c // SALT_ROWS + 1)
                arrays = [pa.array(np.concatenate(tokens)), pa.array(i), pa.array(salt.astype(np.int32)), pa.array(c > 0)]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "id", "salt", "hot"])

    return own.select("id", "set").mapInArrow(lean(run), "token long, id long, salt int, hot boolean")


def shared(rows: DataFrame, pct: int) -> DataFrame:
    """(token, id, hot) of rows of dealt(): parts of cells whose sizes allow links, hot cells whole; a part has
    the first band in its token. What one id has to itself is left out, hot tokens aside. Rows are dealt and
    sorted, then streamed."""
    gap, last = math.ceil(math.log(100 / pct) / math.log(BAND)), (1 << BAND_BITS) - 1

    def run(batches):
        left = None
        for b in batches:
            t, i, h = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            name = np.where(h, t | last, t)
            if left is not None:
                t, i, h, name = (np.concatenate([x, y]) for x, y in zip(left[0], (t, i, h, name)))
            if not len(t):
                continue
            same = (t[1:] >> BAND_BITS == t[:-1] >> BAND_BITS) & (t[1:] - t[:-1] <= gap)
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | h
            # the last row waits for the next batch; one before it that it goes with is known to stay
            keep[0] |= bool(left is not None and left[1])
            start = np.concatenate([[True], ~same])
            name = np.where(h, name, name[np.flatnonzero(start)[np.cumsum(start) - 1]])
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in (name, i, h)], names=["token", "id", "hot"])
            left = (t[-1:], i[-1:], h[-1:], name[-1:]), keep[-1]
        if left is not None and left[1]:
            yield pa.RecordBatch.from_arrays([pa.array(left[0][k]) for k in (3, 1, 2)], names=["token", "id", "hot"])

    dealt_out = rows.repartition(F.shiftright("token", BAND_BITS), "salt").sortWithinPartitions("token", "id").select("token", "id", "hot")
    return dealt_out.mapInArrow(lean(run), "token long, id long, hot boolean")


def with_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows(token, hot, ...) joined with one row for each cell (token, ...). Hot cells, few, are
    broadcast, so that no hot token is gathered, unless there are more than BROADCAST_ROWS of them."""
    hot = rows.where("hot").select("token").distinct()
    hot = cut(cells.join(hot, "token", "left_semi"), "hot-cells")
    few = hot.count() <= BROADCAST_ROWS
    return rows.where("not hot").join(cells, "token").unionByName(rows.where("hot").join(F.broadcast(hot) if few else hot, "token"))


def _units(batches, key: tuple[str, ...], names: tuple[str, ...]):
    """(key, columns) of each run of rows with one key."""
    part, at = [], None
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in key)))
        for k, row in zip(keys, zip(*(b.column(c).to_pylist() for c in names))):
            if k != at:
                if part:
                    yield at, list(zip(*part))
                part, at = [], k
            part.append(row)
    if part:
        yield at, list(zip(*part))


def _points(packed) -> tuple[np.ndarray, np.ndarray]:
    """Points of one width, and the coarse ones of the tree."""
    g = 2 * min(map(len, packed))
    fine = np.array([fold(counts(p), g) for p in packed])
    return fine, fine.reshape(len(fine), -1, COARSE).sum(1, dtype=np.int32)


class Representatives:
    """Points that cannot reach each other: an R-tree of the older ones, built anew each time their
    number doubles, and a leaf of the younger ones."""

    def __init__(self, coarse: np.ndarray, sizes: np.ndarray, pct: int):
        self.coarse, self.sizes, self.pct = coarse, sizes, pct
        self.at, self.tree, self.treed = np.empty(0, np.int64), None, 0

    def reached(self, q: int) -> np.ndarray:
        """Those that the tree's bounds leave for q."""
        young = self.at[self.treed :]
        young = young[reaches(self.coarse[young], self.sizes[young], self.coarse[q], int(self.sizes[q]), self.pct)] if len(young) else young
        if self.tree is None:
            return young
        return np.concatenate([self.at[self.tree.search(self.coarse[q], int(self.sizes[q]), self.pct)], young])

    def add(self, q: int) -> None:
        self.at = np.append(self.at, q)
        if len(self.at) - self.treed > max(2 * LEAF, self.treed):
            self.treed = len(self.at)
            self.tree = RTree(self.coarse[self.at], self.sizes[self.at])


def absorbed(rows: DataFrame, pct: int) -> DataFrame:
    """(token, hot, id, rep) of rows (token, hot, block, many, id, n, point): the pairs of the first
    search and, of cells of many blocks, each representative with itself."""

    def run(batches):
        for (token, hot, _), (many, ids, n, packed) in _units(batches, ("token", "hot", "block"), ("many", "id", "n", "point")):
            ids, n = np.array(ids), np.array(n)
            fine, coarse = _points(packed)
            reps, out = Representatives(coarse, n, pct), []
            for q in np.argsort(ids, kind="stable"):
                at = reps.reached(q)
                if len(at):
                    both = np.minimum(n[q] - np.maximum(fine[q] - fine[at], 0).sum(1), n[at] - np.maximum(fine[at] - fine[q], 0).sum(1))
                    both = both / (n[at] + n[q])
                    k = int(np.argmax(both))
                    if (100 + pct) * both[k] >= pct - 1e-9:
                        out.append((int(ids[q]), int(ids[at[k]])))
                        continue
                reps.add(q)
            if many[0]:
                out += [(int(ids[q]), int(ids[q])) for q in reps.at]
            if out:
                arrays = [pa.array([token] * len(out), pa.int64()), pa.array([hot] * len(out)), *(pa.array(c, pa.int64()) for c in zip(*out))]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "hot", "id", "rep"])

    rows = rows.select("token", "hot", "block", "many", "id", "n", "point").repartition("token", "block").sortWithinPartitions("token", "block", "id")
    return rows.mapInArrow(lean(run), "token long, hot boolean, id long, rep long")


def cell_search(rows: DataFrame, pct: int) -> DataFrame:
    """(a, b) of rows (token, block, turn, id, n, point, comp, asks, held): members that ask are searched in
    the tree of the members that are held, pairs of one component left out."""

    def run(batches):
        for _, (ids, n, packed, comp, asks, held) in _units(batches, ("token", "block", "turn"), ("id", "n", "point", "comp", "asks", "held")):
            ids, n, comp, asks = np.array(ids), np.array(n), np.array(comp), np.array(asks)
            fine, coarse = _points(packed)
            own, out = np.flatnonzero(held), set()
            tree = RTree(coarse[own], n[own])
            for q in np.flatnonzero(asks):
                at = own[tree.search(coarse[q], int(n[q]), pct)]
                at = at[comp[at] != comp[q]]
                at = at[reaches(fine[at], n[at], fine[q], int(n[q]), pct)] if len(at) else at
                out.update((min(int(ids[q]), int(ids[x])), max(int(ids[q]), int(ids[x]))) for x in at)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*sorted(out)) if out else ([], []))], names=["a", "b"])

    rows = rows.repartition("token", "block", "turn").sortWithinPartitions("token", "block", "turn", "id")
    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def verified(pairs: DataFrame, own: DataFrame, pct: int) -> DataFrame:
    """(a, b, overlap) of the pairs whose sets reach pct per cent."""

    def run(batches):
        for b in slices(batches):
            out = [[], [], []]
            for i, j, x, y in zip(*(b.column(c).to_pylist() for c in ("a", "b", "x", "y"))):
                x, y = unpack(x), unpack(y)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                o = int((y[at] == x).sum())
                if 100 * o >= pct * (len(x) + len(y) - o):
                    for c, v in zip(out, (i, j, o)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "overlap"])

    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "involved")
    sets = only(own.select("id", "set"), ids, "left_semi", "id")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long, overlap long")


def _block(id_col: str, c):
    """Block of a member of a cell of c members, and whether there are others."""
    blocks = F.ceil(c / CELL_BLOCK).cast("int")
    return F.pmod(F.xxhash64(id_col), blocks).cast("int").alias("block"), (blocks > 1).alias("many")


def links(own: DataFrame, pct: int = 80) -> DataFrame:
    """(a, b, overlap): verified links that connect the same classes as all links do.
    own: (id, n, point, set), one row for each class."""
    cells = cut(shared(dealt(own, frequency_classes(own), pct), pct), "cells")
    about = cells.groupBy("token").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x2")).where("c > 1")
    kept = cut(about.groupBy("c", "low", "x", "x2").agg(F.min("token").alias("token")).select("token", "c"), "kept")
    members = cut(with_cells(cells, kept), "members")  # (token, id, hot, c)
    points = cut(only(own.select("id", "n", "point"), cut(members.select("id").distinct(), "listed"), "left_semi", "id"), "points")
    level, pairs, first = members, None, None
    while True:
        out = cut(absorbed(level.select("token", "hot", "id", *_block("id", F.col("c"))).join(points, "id"), pct), "absorbed")
        first = out if first is None else first
        got = out.where("id <> rep").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"))
        pairs = got if pairs is None else pairs.union(got)
        again = out.where("id = rep").select("token", "hot", "id")
        fewer = again.groupBy("token").agg(F.count("*").alias("d"))
        fewer = cut(with_cells(level.select("token", "hot", "c").distinct(), fewer).where("2 * d <= c and d > 1").select("token", F.col("d").alias("c")), "fewer")
        if not fewer.limit(1).count():
            break
        level = cut(with_cells(again, fewer), "representatives")
    found = cut(verified(pairs.distinct(), own, pct), "tree-links")
    # what absorption may have hidden
    comp = cut(components(found), "comp")
    open_ = cut(first.select("token").distinct(), "open")
    named = members.join(open_, "token", "left_semi").join(comp, "id", "left").select("token", "hot", "c", "id", F.coalesce("comp", "id").alias("comp"))
    named = cut(named, "named")
    by = named.groupBy("token", "comp").agg(F.count("*").alias("n"))
    home = by.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("c")).select("token", F.col("m.comp").alias("home"), (F.col("c") - F.col("m.n")).alias("asking"))
    named = cut(with_cells(named, cut(home.where("asking > 0"), "home")).withColumn("asks", F.col("comp") != F.col("home")), "asked")
    block, many = _block("id", F.col("c"))
    turns = F.ceil(F.col("asking") / CELL_BLOCK).cast("int")
    named = named.select("*", block, many, F.ceil(F.col("c") / CELL_BLOCK).cast("int").alias("blocks"), turns.alias("turns"))
    one = named.where("blocks = 1 and turns = 1").select("token", "block", F.lit(0).alias("turn"), "id", "comp", "asks", F.lit(True).alias("held"))
    more = named.where("blocks > 1 or turns > 1")
    held = more.select("token", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "id", "comp", F.lit(False).alias("asks"), F.lit(True).alias("held"))
    asks = more.where("asks").select("token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64(F.lit(3), "id"), "turns").cast("int").alias("turn"), "id", "comp", F.lit(True).alias("asks"), F.lit(False).alias("held"))
    second = cut(cell_search(one.union(held).union(asks).join(points, "id"), pct), "second-pairs")
    return found.union(cut(verified(second, own, pct), "second-links"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = 80) -> DataFrame:
    """(id, n_shingles, class_id, component_id) of every row."""
    small_batches(docs.sparkSession)
    sets = cut(described(docs, id_col, text_col), "sets")
    narrow = sets.select("id", "n", "d0", "d1")
    full = narrow.where("id is not null and n > 0")
    reps = cut(full.groupBy("d0", "d1").agg(F.min("id").alias("rep")), "classes")
    named = cut(full.join(reps, ["d0", "d1"]).select("id", "n", "rep"), "named")
    copies = cut(named.where("id <> rep").select("id").distinct(), "copies")
    own = only(sets.where("id is not null and n > 0").select("id", "n", "point", "set"), copies, "left_anti", "id")
    comp = cut(components(links(own, pct)), "components")
    out = named.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("component_id"))
    rest = narrow.where("id is null or n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return out.union(rest).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pct: int = 80) -> DataFrame:
    """docs with one document of each component, that of the smallest id; docs' own columns.
    Rows that repeat an id stay together."""
    gone = cut(join(docs, id_col, text_col, pct).where(col(id_col) != F.col("component_id")).select(col(id_col).alias("gone")).distinct(), "near-copies")
    return without(docs, gone, col(id_col).cast("long"))
