"""Benchmark decontamination by latent semantic retrieval (operator 9).

1. One pass turns every document into the 32-bit hashes of its words (split at ASCII white space,
   outer ASCII marks stripped, lower case) and counts, for every word, the documents that have it:
   exact counts of each task, summed by parts of the hash range.
2. The vocabulary of the latent space: the items' words and the CORPUS_WORDS words in most
   documents. A word weighs log(common / df), at least 0; common is the share `share` of the
   documents, COMMON at least, so words of more documents than that weigh nothing in the space
   and, in the containment test, a tenth of their usual log(N / df).
3. A distributed randomised SVD of the TF-IDF matrix A of all PASSAGE-word passages of the corpus: one
   pass sums A'(A W) for a seeded Gaussian W, from which the Nystrom form gives the leading
   right singular vectors (Halko, Martinsson and Tropp, 2011; Tropp et al., 2017). The items take
   no part in the fit. LATENT dimensions, far fewer than words, stay, so that words of like company fall together.
4. Retrieval: windows at every STRIDE words, of 1 / `close` of the item's length and
   a stride, so that a paraphrase with as many more words fits in one, by two routes. Latent: cosine of at
   least `near` between window and item in the space of 3, which also meets an item whose heavy
   words were swapped for others of the same company. Containment: the window holds the share
   `held` of the item's TF-IDF weight, so that a copy of an item whose words the corpus does not
   know, or in a window of another subject, is not lost; a bound from each word's largest share in
   any item skips windows that cannot reach it. `cosine` is that of the route that met the window.
5. Verification: longest common subsequence of item and window. At least `sure` of the item's
   words: contaminated. At least `close`: contaminated if `answer_share` of the item's last
   ANSWER words are there too, so a paraphrase must also give the answer away.

Three passes over the corpus (words, space, search) however many items there are; whole texts, all
documents and all items take part. A passage that a third of the documents share meets no shuffle.
The items, their words and their places in the space are held by the driver and every task. Two
words of one 32-bit hash count as one.

Cases: null or empty texts and items hold no words and are never contaminated. Texts and items may be
of any length, and so may words. Repeated rows and null
ids give a row each. Documents are told apart by 128 bits of id and text; only the named columns
are read, so names and types of others cannot clash. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PARTS, col, cut, drop, emit, lean, row_key, slices, small_batches, summed, without
from .quality import STRIP

PASSAGE, STRIDE, EXTRA, ANSWER = 64, 16, 16, 5
LATENT, CORPUS_WORDS, COMMON = 64, 8192, 4
BLOCK, BUCKETS = 1 << 20, 256  # bytes of text hashed at once; parts of the hash range
PIECE = 1 << 18  # words of a document that are looked at together; a multiple of PASSAGE


SPACE, CORE = np.zeros(256, bool), np.ones(256, bool)
SPACE[list(b" \t\n\x0b\x0c\r")] = True
CORE[list(b" \t\n\x0b\x0c\r" + STRIP.encode())] = False
P = 0x9E3779B97F4A7C15
INVERSE = pow(P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.uint32)


def _long_word(word: bytes) -> int:
    """The sum that `hashes` takes, in blocks, for words of any length."""
    word = word.strip(STRIP.encode())
    total, scale = np.zeros(1, np.uint64), 1
    for at in range(0, len(word), BLOCK):
        part = np.frombuffer(word[at : at + BLOCK], np.uint8).astype(np.uint64) + np.uint64(1)
        total += (part * _steps(len(part))[0]).sum(dtype=np.uint64, keepdims=True) * np.uint64(scale)
        scale = scale * pow(P, len(part), 1 << 64) % (1 << 64)
    return int(_mixed(total)[0])


def _steps(n: int) -> np.ndarray:
    """Powers of P and of its inverse mod 2**64."""
    if not _powers or _powers[0].shape[1] < n:
        got = np.ones((2, max(n, 1 << 20)), np.uint64)
        got[0, 1:], got[1, 1:] = P, INVERSE
        _powers[:] = [np.cumprod(got, axis=1, dtype=np.uint64)]
    return _powers[0][:, :n]


def hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes and starts of the words of lower-case UTF-8 (split at ASCII white space, outer ASCII
    marks left out; a word of marks alone hashes to 0). A word's hash is the mixed sum of byte * P**place,
    taken from one running sum over the text."""
    raw = np.frombuffer(data, np.uint8)
    space = SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint32), start
    if len(raw) > BLOCK:
        return np.array([_long_word(data[a:b]) for a, b in zip(start, end)], np.uint32), start
    core = CORE[raw]
    before = np.concatenate([[0], np.cumsum(core, dtype=np.int32)])
    places = np.append(np.flatnonzero(core), len(raw))
    some = before[end] > before[start]
    first, last = places[before[start]], places[np.maximum(before[end], 1) - 1] + 1
    up, down = _steps(len(raw) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
    at = np.where(some, first, 0)
    return _mixed(np.where(some, (run[np.where(some, last, 0)] - run[at]) * down[at], np.uint64(0))), start


def word_hashes(text: str | None) -> np.ndarray:
    """Of a whole text, however long, in parts that end at white space."""
    data, out, at = (text or "").lower().encode(), [], 0
    while at < len(data):
        end = at + BLOCK - 1
        if end < len(data):
            part = data[at:end]
            cut_at = max(part.rfind(x) for x in (b" ", b"\n", b"\t", b"\r"))
            if cut_at < 0:  # a word of more than BLOCK bytes
                found = [x for x in (data.find(x, end) for x in (b" ", b"\n", b"\t", b"\r")) if x >= 0]
                end = min(found, default=len(data))
            else:
                end = at + cut_at + 1
        out.append(hashes(data[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class _Counts:
    """Documents by word hash, exact: sorted hashes and their counts."""

    def __init__(self):
        self.word, self.n, self.new, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), [], 0

    def add(self, ids: np.ndarray, doc: np.ndarray) -> None:
        pairs = doc.astype(np.uint64) << np.uint64(32) | ids
        pairs.sort()
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        self.new.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        self.size += len(pairs)
        if self.size > 1 << 20:
            self.settle()

    def settle(self) -> None:
        self.merge(np.concatenate([np.empty(0, np.uint32), *self.new]))
        self.new, self.size = [], 0

    def merge(self, word: np.ndarray, n: np.ndarray | None = None) -> None:
        word = np.concatenate([self.word, word])
        n = np.concatenate([self.n, np.ones(len(word) - len(self.word), np.int64) if n is None else n])
        o = np.argsort(word, kind="stable")
        word, n = word[o], n[o]
        at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.empty(0, np.int64)
        self.word, self.n = word[at], np.add.reduceat(n, at) if len(at) else n


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := masks.get(y, 0):
            u = v & m
            v = (v + u) | (v - u)
            v &= full
    return len(a) - v.bit_count()


def tokenised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, ids, bucket, words, n): a row with the word hashes of every document, and rows with a
    bucket of the hash range that hold hashes and the number of a task's documents with each."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "row", "ids", "bucket", "words", "n"]

    def run(batches):
        seen, id_type = _Counts(), None

        def counts():
            seen.settle()
            edge = np.searchsorted(seen.word, (np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(24)))
            full = [k for k in range(BUCKETS) if edge[k + 1] > edge[k]]
            none = [pa.nulls(len(full), t) for t in (id_type, pa.binary(), pa.binary())]
            words = [seen.word[edge[k] : edge[k + 1]].tobytes() for k in full]
            n = [seen.n[edge[k] : edge[k + 1]].astype(np.uint32).tobytes() for k in full]
            return pa.RecordBatch.from_arrays([*none, pa.array(full, pa.int32()), pa.array(words, pa.binary()), pa.array(n, pa.binary())], names=names)

        for b in slices(batches):
            out, id_type = [None] * b.num_rows, b.schema.field(0).type
            texts = [(t or "").lower().encode() for t in b.column(2).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at + 1, len(texts[at])
                while end < len(texts) and size + len(texts[end]) < BLOCK // 2:
                    size += len(texts[end]) + 1
                    end += 1
                if end == at + 1:
                    ids = word_hashes(texts[at].decode())
                    doc = np.zeros(len(ids), np.int64)
                else:
                    ids, start = hashes(b"\n".join(texts[at:end]))
                    ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
                    doc = np.searchsorted(ends, start, "right")
                seen.add(ids, doc)
                for k, part in enumerate(np.split(ids, np.searchsorted(doc, np.arange(1, end - at)))):
                    out[at + k] = part.tobytes()
                at = end
            none = [pa.nulls(b.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), *none], names=names)
            if len(seen.word) > 1 << 21:
                yield counts()
                seen = _Counts()
        if id_type is not None:
            yield counts()

    picked = docs.select(col(id_col).alias("id"), row_key(col(id_col), col(text_col)).alias("row"), col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(run), f"id {kind}, row binary, ids binary, bucket int, words binary, n binary")


def document_counts(both: DataFrame, own: np.ndarray, most: float) -> DataFrame:
    """(word, n, own): the documents of the words `own`, and of the CORPUS_WORDS words of each bucket in
    most documents, in at most `most` and in two at least. A task holds the hashes of a bucket, 2**24 at most."""

    def run(batches):
        found: dict[int, _Counts] = {}

        def out(seen):
            mine = np.isin(seen.word, own)
            rest = np.flatnonzero(~mine & (seen.n <= most) & (seen.n > 1))
            rest = rest[np.lexsort((seen.word[rest], -seen.n[rest]))[:CORPUS_WORDS]]
            at = np.concatenate([np.flatnonzero(mine), rest])
            arrays = [pa.array(seen.word[at].astype(np.int64)), pa.array(seen.n[at]), pa.array(np.isin(seen.word[at], own))]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "n", "own"])

        for b in batches:
            for k, w, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k not in found:
                    yield from map(out, found.values())  # rows come bucket by bucket
                    found = {k: _Counts()}
                found[k].merge(np.frombuffer(w, np.uint32), np.frombuffer(n, np.uint32).astype(np.int64))
        yield from map(out, found.values())

    rows = both.where("bucket is not null").select("bucket", "words", "n")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), "word long, n long, own boolean")


class Vocabulary:
    """Word hashes in order, with the weights of 2: `rare` of the latent space, `full` of the containment
    test; place len(hashes) stands for all other words."""

    def __init__(self, df: dict[int, int], docs: int, share: float):
        self.hashes = np.array(sorted(df), np.uint32)
        n = np.array([df[int(h)] for h in self.hashes], float)
        rare = np.maximum(0.0, np.log(max(share * (docs + 1), COMMON) / (n + 1)))
        full = np.maximum(rare, 0.1 * np.log((docs + 1) / (n + 1)) + 0.01)
        self.rare, self.full = np.append(rare, 0.0), np.append(full, full.max(initial=1.0))
        self.known = np.zeros(1 << 16, bool)
        self.known[self.hashes >> 16] = True

    def places(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), len(self.hashes), np.int32)
        if len(self.hashes):
            at = np.flatnonzero(self.known[ids >> 16])
            got = np.minimum(np.searchsorted(self.hashes, ids[at]), len(self.hashes) - 1)
            ok = self.hashes[got] == ids[at]
            out[at[ok]] = got[ok]
        return out


def vocabulary(both: DataFrame, items: list[np.ndarray], share: float) -> Vocabulary:
    docs = both.where("bucket is null").count()
    own = np.unique(np.concatenate(items))
    counts = cut(document_counts(both, own, max(share * docs, COMMON)), "word-counts")
    df = dict.fromkeys(own.tolist(), 0) | {r[0]: r[1] for r in counts.where("own").collect()}  # words of the benchmark, which the driver holds
    df |= {r[0]: r[1] for r in counts.where("not own").orderBy(F.desc("n"), "word").limit(CORPUS_WORDS).collect()}
    drop(counts)
    return Vocabulary(df, docs, share)


def _pieces(batch, overlap: int = 0, least: int = 200_000):
    """(documents, offsets, word hashes, ends): documents of a batch laid end to end, some thousand
    words at a time; long ones in pieces of PIECE words and `overlap` more."""
    docs, offsets, part, n = [], [], [], 0

    def out():
        return np.array(docs), np.array(offsets), np.concatenate(part), np.cumsum([len(p) for p in part])

    for k, x in enumerate(batch.column("ids").to_pylist()):
        ids = np.frombuffer(x, np.uint32)
        for at in range(0, len(ids), PIECE):
            docs.append(k)
            offsets.append(at)
            part.append(ids[at : at + PIECE + overlap])
            n += len(part[-1])
            if n >= least:
                yield out()
                docs, offsets, part, n = [], [], [], 0
    if n:
        yield out()


def _spans(ends: np.ndarray, step: int):
    """Starts of the stretches of `step` words in documents laid end to end, and for each the number of
    the first stretch of the next document, and its document."""
    starts = np.concatenate([[0], ends[:-1]])
    many = -(-(ends - starts) // step)
    first = np.cumsum(many) - many
    of = np.repeat(np.arange(len(ends)), many)
    return starts[of] + (np.arange(len(of)) - first[of]) * step, (first + many)[of], of


def _grouped(m: np.ndarray, rows: np.ndarray, key: np.ndarray):
    """Keys in order and for each the sum of its m[rows]; key is sorted. The r-th rows of all
    groups are added at once, large groups one by one."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(at, len(key)))
    out = np.empty((len(at), m.shape[1]), m.dtype)
    for i in np.flatnonzero(n > PASSAGE):
        out[i] = m[rows[at[i] : at[i] + n[i]]].sum(0)
    o = np.flatnonzero(n <= PASSAGE)
    if len(o):
        o = o[np.argsort(-n[o], kind="stable")]
        first, less = at[o], -n[o]
        z = m[rows[first]]
        for r in range(1, int(n[o[0]])):
            k = np.searchsorted(less, -r, "left")
            z[:k] += m[rows[first[:k] + r]]
        out[o] = z
    return key[at], out


def latent_space(coded: DataFrame, voc: Vocabulary, rank: int = LATENT, seed: int = 1) -> np.ndarray:
    """words x rank right singular vectors of the TF-IDF passages of the corpus."""
    size = len(voc.hashes)
    width = min(size, rank + EXTRA)
    wide = np.random.default_rng(seed).standard_normal((size, width))

    def run(batches):
        y = np.zeros((size, width))
        weighs = voc.rare[:-1] > 0
        m = (voc.rare[:-1, None] * wide).astype(np.float32)
        for b in batches:
            for _, _, ids, ends in _pieces(b):
                at, _, _ = _spans(ends, PASSAGE)
                place = voc.places(ids)
                keep = np.flatnonzero(np.append(weighs, False)[place])
                if not len(keep):
                    continue
                place = place[keep]
                passage = np.searchsorted(at, keep, "right")
                _, z = _grouped(m, place, passage)
                own = np.cumsum(np.concatenate([[0], passage[1:] != passage[:-1]]))
                o = np.argsort(place, kind="stable")
                k, s = _grouped(z, own[o], place[o])
                y[k] += s
        yield emit(voc.rare[:-1, None] * y)

    if not width:
        return np.zeros((size, 0))
    y = summed(coded.select("ids").mapInArrow(lean(run), PARTS), size, width)
    scale = np.linalg.norm(y)
    if scale < 1e-9:
        return np.zeros((size, 0))
    nu = 1e-10 * scale
    y = y + nu * wide
    core = wide.T @ y
    lam, u = np.linalg.eigh((core + core.T) / 2)
    ok = lam > 1e-12 * lam.max()
    left, s, _ = np.linalg.svd(y @ (u[:, ok] / np.sqrt(lam[ok])), full_matrices=False)
    return left[:, s * s > 2 * nu][:, :rank]


class Index:
    """The items for the search: word lists, windows, TF-IDF postings and places in the latent space."""

    def __init__(self, items: list[tuple], words: list[np.ndarray], voc: Vocabulary, v: np.ndarray, rule: dict):
        self.names, self.words, self.voc, self.rule = [x[0] for x in items], words, voc, rule
        self.space = np.append((voc.rare[:-1, None] * v), np.zeros((1, v.shape[1])), axis=0).astype(np.float32)
        places = [voc.places(x) for x in words]
        centre = np.array([self.space[p].sum(0) for p in places]).reshape(len(words), -1)
        far = np.linalg.norm(centre, axis=1)
        self.centre = (centre / np.where(far > 1e-6, far, np.inf)[:, None]).astype(np.float32)  # no latent place: 0
        pairs = [np.unique(p, return_counts=True) for p in places]
        self.norm = np.array([np.sqrt(((n * voc.full[p]) ** 2).sum()) for p, n in pairs])
        item = np.repeat(np.arange(len(words)), [len(p) for p, _ in pairs])
        place = np.concatenate([p for p, _ in pairs])
        share = np.concatenate([n * voc.full[p] ** 2 / max(x, 1e-12) for (p, n), x in zip(pairs, self.norm)])  # of a word in the dot product
        o = np.argsort(place, kind="stable")
        self.post_item, self.post_share = item[o], share[o]
        self.post = np.searchsorted(place[o], np.arange(len(voc.hashes) + 2))
        sizes = {}
        for i, x in enumerate(words):
            sizes.setdefault(int(-(-(len(x) / rule["close"] + STRIDE - 1) // (2 * STRIDE)) * 2), []).append(i)  # room for the words of a paraphrase
        self.plans = [(blocks, np.array(sel)) for blocks, sel in sorted(sizes.items())]
        self.plan_of = np.empty(len(words), np.int64)
        self.bounds = []
        for k, (_, sel) in enumerate(self.plans):
            self.plan_of[sel] = k
            mine = np.isin(item, sel)
            bound = np.zeros(len(voc.hashes) + 1)
            np.maximum.at(bound, place[mine], share[mine])
            self.bounds.append(bound)
        self.overlap = max((b for b, _ in self.plans), default=0) * STRIDE
        self.members: dict[int, np.ndarray] = {}

    def member(self, i: int) -> np.ndarray:
        """Which places of the vocabulary item i has."""
        if i not in self.members:
            if len(self.members) * len(self.space) > 1 << 25:
                self.members.clear()
            self.members[i] = np.zeros(len(self.space), bool)
            self.members[i][self.voc.places(self.words[i])] = True
        return self.members[i]

    def contained(self, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Items of plan k that share words with a window, and the dot products."""
        n = self.post[place + 1] - self.post[place]
        at = np.repeat(self.post[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, back = np.unique(self.post_item[at], return_inverse=True)
        score = np.bincount(back, self.post_share[at])
        ok = self.plan_of[item] == k
        return item[ok], score[ok]

    def pairs(self, place, cuts, to):
        """(plan, window starts, items, cosines) of the windows that either route meets."""
        voc, held, near = self.voc, self.rule["held"], self.rule["near"]
        total = lambda x: np.concatenate([[0.0], np.cumsum(np.add.reduceat(x, cuts))])
        square = total(voc.full[place] ** 2)
        z = np.zeros((len(cuts), self.space.shape[1]))
        keep = np.flatnonzero(voc.rare[place] > 0)
        if len(keep):
            stretch, s = _grouped(self.space, place[keep], np.searchsorted(cuts, keep, "right") - 1)
            z[stretch] = s
        z = np.concatenate([np.zeros((1, z.shape[1])), np.cumsum(z, axis=0)])
        for k, ((blocks, sel), bound) in enumerate(zip(self.plans, self.bounds)):
            last = np.minimum(np.arange(len(cuts)) + blocks, to)
            norms = np.sqrt(np.maximum(square[last] - square[:-1], 1e-12))
            most = total(bound[place])
            # a word can add no more than its largest share: windows below the threshold drop out
            for x in np.flatnonzero(most[last] - most[:-1] >= held * self.norm[sel].min() - 1e-9):
                end = cuts[last[x]] if last[x] < len(cuts) else len(place)
                item, score = self.contained(place[cuts[x] : end], k)
                ok = score >= held * self.norm[item] - 1e-6
                if ok.any():
                    yield k, np.full(int(ok.sum()), x), item[ok], score[ok] / norms[x]
            for at in range(0, len(cuts), 8192):
                p = (z[last[at : at + 8192]] - z[at : min(at + 8192, len(cuts))]).astype(np.float32)
                far = np.sqrt(np.einsum("ij,ij->i", p, p))
                limit = near * np.where(far > 1e-6, far, np.inf)
                for first in range(0, len(sel), 1024):
                    some = sel[first : first + 1024]
                    dot = p @ self.centre[some].T
                    x, j = np.nonzero(dot >= limit[:, None])
                    if len(x):
                        yield k, at + x, some[j], dot[x, j] / far[x]

    def hits(self, docs, offsets, ids, ends):
        """{(document, item): (cosine, share of the subsequence, first word)} at the best window."""
        close, sure, answer = self.rule["close"], self.rule["sure"], self.rule["answer_share"]
        cuts, to, of = _spans(ends, STRIDE)
        edge, place, best = np.append(cuts, len(ids)), self.voc.places(ids), {}
        for k, xs, items, scores in self.pairs(place, cuts, to):
            blocks = self.plans[k][0]
            last = np.minimum(xs + blocks, to[xs])
            end = edge[last]
            o = np.argsort(items, kind="stable")
            for group in np.split(o, np.flatnonzero(np.diff(items[o])) + 1):
                i = int(items[group[0]])
                word = self.words[i]
                own = self.member(i)
                if len(group) > 64:  # words of the item in each window: no common subsequence is longer
                    run = np.concatenate([[0], np.cumsum(own[place])])
                    group = group[run[end[group]] - run[cuts[xs[group]]] >= close * len(word)]
                for g in group:
                    x = xs[g]
                    key = int(docs[of[x]]), i
                    if key in best and best[key][1] >= 1:
                        continue
                    part = ids[cuts[x] : end[g]][own[place[cuts[x] : end[g]]]]
                    if len(part) < close * len(word):
                        continue
                    n = lcs(word.tolist(), part.tolist())
                    if n < close * len(word) or key in best and best[key][1] >= n / len(word):
                        continue
                    there = np.isin(word[-ANSWER:], part).mean()
                    if n >= sure * len(word) or there >= answer:
                        best[key] = float(scores[g]), n / len(word), int(offsets[of[x]] + cuts[x] - (ends[of[x] - 1] if of[x] else 0))
        return best


def search(coded: DataFrame, index: Index, kind: str, item_kind: str) -> DataFrame:
    def run(batches):
        for b in batches:
            found: dict = {}
            for piece in _pieces(b, index.overlap):
                for key, got in index.hits(*piece).items():
                    if key not in found or got[1:] > (found[key][1], -found[key][2]):
                        found[key] = got
            keys = sorted(found)
            at = pa.array([k for k, _ in keys], pa.int64())
            item = pa.array([index.names[i] for _, i in keys], pa.string() if item_kind == "string" else pa.int64())
            cols = list(zip(*(found[k] for k in keys))) or [[], [], []]
            out = [b.column(0).take(at), b.column(1).take(at), item, *(pa.array(list(c), t) for c, t in zip(cols, (pa.float64(), pa.float64(), pa.int64())))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "row", "item", "cosine", "lcs_share", "start_word"])

    return coded.select("id", "row", "ids").mapInArrow(lean(run), f"id {kind}, row binary, item {item_kind}, cosine double, lcs_share double, start_word long")


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
         held: float = 0.5, near: float = 0.5, close: float = 0.6, sure: float = 0.8, answer_share: float = 0.6, share: float = 0.03) -> DataFrame:
    """(id, row, item_id, cosine, lcs_share, start_word): each document and item of it, at its best window."""
    spark = docs.sparkSession
    small_batches(spark)
    rule = {"held": held, "near": near, "sure": sure, "close": close, "answer_share": answer_share}
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_kind = item_kind if item_kind in ("string", "bigint") else "bigint" if item_kind in ("int", "smallint", "tinyint") else "string"
    items, words = [], []
    rows = benchmark.select(col(item_col).cast(item_kind).alias("i"), col(item_text).cast("string").alias("t")).where("t is not null").orderBy("i", "t")
    for r in rows.toLocalIterator():
        got = word_hashes(r[1])
        if (got > 0).any():
            items.append((r[0], None))
            words.append(got[got > 0])
    if not items:
        out = spark.createDataFrame([], f"id {kind}, row binary, item {item_kind}, cosine double, lcs_share double, start_word long")
    else:
        both = cut(tokenised(docs, id_col, text_col), "word-ids")
        coded = both.where("bucket is null")
        voc = vocabulary(both, words, share)
        out = search(coded, Index(items, words, voc, latent_space(coded, voc), rule), kind, item_kind)
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that hold no item, with docs' own columns."""
    gone = cut(find(docs, benchmark, id_col, text_col, **kw).select(F.col("row").alias("gone")).distinct(), "contaminated")
    return without(docs, gone, row_key(col(id_col), col(text_col)))
