"""Byte-level BPE encoding and decoding (operator 1).

Every match of the split pattern is one piece. Over the byte positions of a piece stands a
segment tree whose leaf i holds (rank of the pair that starts at i, i); inner nodes hold the
smaller child, so the root names the leftmost pair of the lowest rank. A merge touches three
leaves (the merged pair's own, the one it swallows, its left neighbour's), each updated along
one path to the root: O(log n) a merge, O(n log n) a piece, also for pieces of megabytes.

Pieces of one size class stand side by side in numpy arrays, a forest of trees that merges in
step; few or very long pieces use the same tree in plain lists. A worker keeps the pieces it has
met (bounded by CACHE_PIECES); nothing but the vocabulary is shared.

Cases: null text counts as empty: no ids, and both digests are of the empty string. Lone
surrogates cannot be in a Spark string. Repeated rows and null ids each give a row of their own.
Further columns of the input are not read, so their names cannot clash. An empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, lean, slices, small_batches

CACHE_CHARS = 64  # longer pieces are not kept
CACHE_PIECES = 150_000
CHUNK_CHARS = 2_000_000
NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class Bpe:
    """Encoder and decoder of one vocabulary and one split pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.split = regex.compile(pattern).findall
        # in a text of ASCII characters alone these classes are the same, and quicker
        plain = pattern.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.split_ascii = self.split if r"\p" in plain else re.compile(plain, re.ASCII).findall
        self.names = [str(i) for i in range(len(tokens))]
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.width = np.int64(len(tokens) + 1)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * int(self.width) + right] = rank
        self.pairs = pairs
        bits = max(12, (len(pairs) * 4).bit_length())
        self.slots, self.shift = np.full(1 << bits, -1, np.int64), np.uint64(64 - bits)
        self.found = np.zeros(1 << bits, np.int64)
        keys, ranks = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # open addressing, all keys at once
            free = self.slots[at[left]] < 0
            self.slots[at[left[free]]] = keys[left[free]]
            self.found[at[left[free]]] = ranks[left[free]]
            wrong = self.slots[at[left]] != keys[left]
            # a slot that two keys asked for holds the later one's key and rank; the other goes on
            left = left[wrong]
            at[left] = (at[left] + 1) & (len(self.slots) - 1)
        self.cache: dict[str, tuple[int, ...]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; -1 where it merges to nothing."""
        keys = left * self.width + right
        at, out, todo = self._slot(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(todo):
            held = self.slots[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.found[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)
        return out

    def _forest(self, pieces: list[bytes], size: int) -> list[list[int]]:
        """Trees of `size` leaves for pieces of at most `size` bytes."""
        m, log = len(pieces), size.bit_length() - 1
        length = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
        ids = np.full((m, size + 1), -1, np.int64)
        ids[:, :size] = self.byte_id[raw]
        spot = np.arange(size + 1)
        nxt = np.where(spot[None, :] + 1 < length[:, None], spot[None, :] + 1, size)
        prv = np.tile(spot - 1, (m, 1))
        tree = np.full((m, 2 * size), NONE, np.int32)
        r = self._ranks(ids[:, : size - 1].ravel(), ids[:, 1:size].ravel()).reshape(m, size - 1)
        ok = (r >= 0) & (spot[None, 1:size] < length[:, None])
        tree[:, size : 2 * size - 1] = np.where(ok, (r << log) | spot[None, : size - 1], NONE)
        for level in range(log - 1, -1, -1):
            lo = 1 << level
            kids = tree[:, 2 * lo : 4 * lo]
            tree[:, lo : 2 * lo] = np.minimum(kids[:, ::2], kids[:, 1::2])
        # flat views: row r of tree starts at r * 2 * size, of the others at r * (size + 1)
        t, x, nx, pv = tree.ravel(), ids.ravel(), nxt.ravel(), prv.ravel()
        act = np.arange(m)
        while True:
            top = t.take(act * (2 * size) + 1)
            live = top < NONE
            if not live.all():
                act, top = act[live], top[live]
            if not len(act):
                break
            base, row, top = act * (2 * size), act * (size + 1), top.astype(np.int64)
            i, new = top & (size - 1), top >> log
            j = nx.take(row + i)
            k, p = nx.take(row + j), pv.take(row + i)
            x[row + i], x[row + j], nx[row + i] = new, -1, k
            pv[row + k] = i  # k == size: a spare place that is never read
            r = self._ranks(np.concatenate((new, x.take(row + p))), np.concatenate((x.take(row + k), new)))
            here, before = r[: len(act)], r[len(act) :]
            t[base + size + j] = NONE
            t[base + size + i] = np.where((here >= 0) & (k < size), (here << log) | i, NONE)
            has = p >= 0
            q = np.where(has, p, i)
            t[base + size + q] = np.where(has, np.where(before >= 0, (before << log) | q, NONE), t.take(base + size + q))
            base3 = np.concatenate((base, base, base))
            node = np.concatenate((i, j, q)) + size
            for _ in range(log):
                node >>= 1
                kid = base3 + 2 * node
                t[base3 + node] = np.minimum(t.take(kid), t.take(kid + 1))
        keep = (ids[:, :size] >= 0) & (spot[None, :size] < length[:, None])
        flat = list(map(self.ints.__getitem__, ids[:, :size][keep].tolist()))
        ends = np.cumsum(keep.sum(1)).tolist()
        return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends)]

    def _tree(self, piece: bytes) -> list[int]:
        """The same for one piece, in plain lists."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        get, none, w = self.pairs.get, (1 << 60, 0), int(self.width)
        ids = [int(x) for x in self.byte_id[np.frombuffer(piece, np.uint8)]]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)

        def leaf(i: int):
            k = nxt[i]
            r = get(ids[i] * w + ids[k]) if k < n else None
            return none if r is None else (r, i)

        for i in range(n):
            tree[size + i] = leaf(i)
        for x in range(size - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])
        while tree[1] is not none and tree[1][0] < 1 << 60:
            rank, i = tree[1]
            j = nxt[i]
            k, p = nxt[j], prv[i]
            ids[i], ids[j], nxt[i] = rank, -1, k
            if k < n:
                prv[k] = i
            tree[size + j], tree[size + i] = none, leaf(i)
            spots = (i, j)
            if p >= 0:
                tree[size + p], spots = leaf(p), (i, j, p)
            for s in spots:
                x = (size + s) >> 1
                while x:
                    tree[x] = min(tree[2 * x], tree[2 * x + 1])
                    x >>= 1
        return [x for x in ids if x >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        out: list[tuple[int, ...]] = [()] * len(pieces)
        classes: dict[int, list[int]] = {}
        for at, p in enumerate(pieces):
            if (r := self.rank.get(p)) is not None:
                out[at] = (r,)
            elif p:
                classes.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(at)
        names = self.ints
        for size, members in classes.items():
            if len(members) < 24 or size > 2048:
                for at in members:
                    out[at] = tuple([names[x] for x in self._tree(pieces[at])])
                continue
            step = max(24, (1 << 18) // size)
            for s in range(0, len(members), step):
                part = members[s : s + step]
                for at, got in zip(part, self._forest([pieces[x] for x in part], size)):
                    out[at] = tuple(got)
        return out

    @property
    def ints(self) -> list[int]:
        """One object for each id, so that cached pieces share them."""
        if not hasattr(self, "_ints"):
            self._ints = list(range(len(self.tokens)))
        return self._ints

    def encode_batch(self, texts: list[str]):
        """The ids of each text, in order."""
        split = [self.split_ascii(t) if t.isascii() else self.split(t) for t in texts]
        get = self.cache.get
        found = [list(map(get, pieces)) for pieces in split]
        if lacking := [at for at, x in enumerate(found) if None in x]:
            new = list({p for at in lacking for p, x in zip(split[at], found[at]) if x is None})
            if len(self.cache) + len(new) > CACHE_PIECES:
                self.cache = {}
            got = dict(zip(new, self.encode_pieces([p.encode() for p in new])))
            for at in lacking:
                found[at] = [got[p] if x is None else x for p, x in zip(split[at], found[at])]
            self.cache.update((p, x) for p, x in got.items() if len(p) <= CACHE_CHARS)
        for x in found:
            yield list(chain.from_iterable(x))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_made: dict[tuple, Bpe] = KEPT.setdefault("bpe", {})


def _coder(tokens: list[bytes], pattern: str) -> Bpe:
    """One coder in each worker, kept between tasks until another operator has one there."""
    key = (len(tokens), hashlib.sha256(b"\n".join(tokens)).digest(), pattern)
    if key not in _made:
        _made.clear()
        _made[key] = Bpe(tokens, pattern)
    return _made[key]


def _chunks(texts: list[str]):
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= CHUNK_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every text by the ranks of a .tiktoken file."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))  # fixed size: the vocabulary
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = _coder(held.value, pattern)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = [x for part in _chunks(texts) for x in coder.encode_batch(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(lean(run, "bpe"), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): the bytes behind the ids; null ids count as none, an id without a token raises."""
    held = coded.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = coded.schema[id_col].dataType.simpleString()

    def run(batches):
        get = held.value.__getitem__
        for b in batches:
            got = [b"".join(map(get, x or ())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], names=["id", "bytes"])

    out = coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return out.mapInArrow(lean(run, "bpe"), f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so that the ids
    of the corpus never leave the worker."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        coder, sha = _coder(held.value, pattern), hashlib.sha256
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            count, ids_hex, text_hex = [], [], []
            for part in _chunks(texts):
                for ids in coder.encode_batch(part):
                    count.append(len(ids))
                    ids_hex.append(sha(" ".join(map(coder.names.__getitem__, ids)).encode()).hexdigest())
                    text_hex.append(sha(coder.decode(ids)).hexdigest())
            arrays = [b.column(0), pa.array(count, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return out.mapInArrow(lean(run, "bpe"), schema).withColumnRenamed("id", id_col)
