"""HTML main-text extraction by a recurrent block labeller (operator 2).

A page becomes the sequence of its leaf blocks: runs of text between block boundaries, each with
the path of open elements. A bidirectional LSTM in numpy reads for each block the sum of
embeddings of its tag path (tags, class and id words, hashed), its hashed word counts and its
shape (length, link share, punctuation, place), and classifies every block with the context of
the whole page in both directions. Blocks labelled main are joined by two line breaks.

The weights (labeller.npz) were fitted by train_labeller.py on generated pages alone; the tests
measure held-out accuracy. Pages go through in order-free groups of equal lengths; a page of any length is
one sequence, never cut.

Cases: null or empty html gives empty text; so does a page without blocks. Text outside any element
is a block like others. Unclosed elements end with their parent; comments, scripts, styles and titles
are never text. Very long, deep or broken pages take time and memory linear in their length. Null ids and repeated rows give a row each. Only the named columns are read.
"""

from __future__ import annotations

import html as _html
import io
import pkgutil
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, slices, small_batches

PATHS, WORDS, SHAPE, INNER, HIDDEN = 256, 64, 10, 24, 16
STEPS = 4096  # blocks whose features are held at once
NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
VALUE = re.compile(r""">|=\s*["']""")
RAW = frozenset("script style noscript template svg iframe object title textarea select".split())
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}


def bucket(word: str, n: int) -> int:
    return zlib.crc32(word.encode()) % n


def _tokens(tag: str, attrs: str) -> list[str]:
    out = [tag]
    if "=" in attrs:
        for m in NAME.finditer(attrs):
            out += ["." + p.lower() for p in PART.findall(m[1] or m[2] or m[3] or "")]
    return out


LONG_REFERENCE = re.compile(r"&#[0-9]{20,};?")


def unescape(text: str) -> str:
    """Character references decoded; numeric ones beyond any code point, however long, give U+FFFD."""
    return _html.unescape(LONG_REFERENCE.sub("\ufffd", text) if "&#" in text else text)


class Element:
    """An open element: its parent and the tokens that it adds to the path; the sum of the embeddings
    of the path's tokens is kept once for each element."""

    __slots__ = ("tag", "parent", "new", "sum")

    def __init__(self, tag: str, parent: Element | None, new: tuple[str, ...]):
        self.tag, self.parent, self.new, self.sum = tag, parent, new, None


def path(e: Element | None) -> set[str]:
    out: set[str] = set()
    while e is not None:
        out.update(e.new)
        e = e.parent
    return out


class _Stack:
    """Open elements, with the places of each tag, of elements that are not inline, and of those that are
    neither inline nor p: every step is O(1) but for the elements that it closes."""

    def __init__(self):
        self.items: list[tuple[Element, tuple[str, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.block: list[int] = []
        self.solid: list[int] = []
        self.seen: dict[str, int] = {}
        self.top: Element | None = None
        self.links = 0

    def push(self, tag: str, tokens: list[str]) -> None:
        place = len(self.items)
        new = []
        for t in tokens:
            n = self.seen.get(t, 0)
            self.seen[t] = n + 1
            if not n:
                new.append(t)
        self.top = Element(tag, self.top, tuple(new))
        self.items.append((self.top, tuple(tokens)))
        self.at.setdefault(tag, []).append(place)
        self.links += tag == "a"
        if tag not in INLINE:
            self.block.append(place)
            if tag != "p":
                self.solid.append(place)

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, place: int) -> None:
        """Ends the element at the place and all that it holds."""
        while len(self.items) > place:
            e, tokens = self.items.pop()
            n = len(self.items)
            for t in tokens:
                if self.seen[t] == 1:
                    del self.seen[t]
                else:
                    self.seen[t] -= 1
            self.at[e.tag].pop()
            self.links -= e.tag == "a"
            for places in (self.block, self.solid):
                if places and places[-1] == n:
                    places.pop()
            self.top = e.parent


def _tag_end(page: str, at: int, no_quote: set[str]) -> int:
    """The place of the > that ends a tag, quoted values left out, or -1. A quote that never ends is none."""
    while m := VALUE.search(page, at):
        q = page[m.end() - 1]
        if q == ">":
            return m.start()
        at = m.end()
        if q not in no_quote:
            end = page.find(q, at)
            if end < 0:
                no_quote.add(q)
            else:
                at = end + 1
    return -1


def blocks(page: str | None) -> list[tuple[Element | None, str, int]]:
    """(innermost open element, text, characters in links) of the leaf blocks in page order, in time and
    memory linear in the page, whatever its depth and however broken its tags are. A tag or comment without an end
    takes the rest of the page, as in browsers."""
    out: list = []
    stack = _Stack()
    text: list[str] = []
    no_quote: set[str] = set()
    linked = at = 0
    page = page or ""

    def flush():
        nonlocal linked
        if text:
            t = " ".join(unescape("".join(text)).split())
            if t:
                out.append((stack.top, t, min(len(t), linked)))
            text.clear()
        linked = 0

    while at < len(page):
        i = page.find("<", at)
        m = None
        while i >= 0 and not (m := TAG.match(page, i)) and page[i + 1 : i + 2] not in ("!", "?", "/"):
            i = page.find("<", i + 1)
        end = i if i >= 0 else len(page)
        if end > at:
            text.append(page[at:end])
            if stack.links:
                linked += end - at
        if i < 0:
            break
        if m is None:
            comment = page.startswith("<!--", i)
            end = page.find("-->" if comment else ">", i + (4 if comment else 2))
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        end = _tag_end(page, m.end(), no_quote)
        if end < 0:
            break
        at, tag, closing, attrs = end + 1, m[1].lower(), page[i + 1] == "/", page[m.end() : end]
        if tag in RAW:
            if not closing and not (tag == "svg" and attrs.endswith("/")):
                done = RAW_END[tag].search(page, at)
                at = done.end() if done else len(page)
                text.append(" ")
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag in ("a", "button", "label"):
                if not closing:
                    stack.push(tag, [] if tag == "a" else [tag])
                elif (place := stack.last((tag,))) > (stack.block[-1] if stack.block else -1):
                    stack.close(place)
            continue
        flush()
        if closing:
            if (place := stack.last((tag,))) >= 0:
                stack.close(place)
            continue
        if tag == "head":
            continue
        place = stack.last(CLOSES.get(tag, ("p",)))
        if place > (stack.last(SCOPE[tag]) if tag in SCOPE else stack.solid[-1] if stack.solid else -1):
            stack.close(place)
        if tag not in VOID:
            stack.push(tag, _tokens(tag, attrs))
    flush()
    return out


class _Buckets(dict):
    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        self[word] = v = zlib.crc32(word) % WORDS
        return v


class Labeller:
    """Forward pass; `w` holds the arrays named below."""

    NAMES = ("path", "word", "shape", "bias", "f_x", "f_h", "f_b", "b_x", "b_h", "b_b", "out", "out_b")

    def __init__(self, w: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in w.items()}
        self.token: dict[str, np.ndarray] = {}
        self.word_ids = _Buckets()

    @classmethod
    def load(cls) -> Labeller:
        with np.load(io.BytesIO(pkgutil.get_data(__package__, "labeller.npz"))) as z:
            return cls({k: z[k] for k in cls.NAMES})

    def features(self, leaves: list, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log word counts and shapes of the blocks first..last of a page."""
        total = len(leaves)
        leaves = leaves[first:last]
        n = len(leaves)
        get = self.word_ids.__getitem__
        words = [t.encode().lower().split() for _, t, _ in leaves]
        count = np.fromiter(map(len, words), np.int64, n)
        flat = np.fromiter((get(x) for ws in words for x in ws), np.int64, int(count.sum()))
        hashed = np.bincount(np.repeat(np.arange(n), count) * WORDS + flat, minlength=n * WORDS).reshape(n, WORDS)
        size = np.array([len(t) for _, t, _ in leaves])
        link = np.array([x for _, _, x in leaves]) / size
        ends = np.array([t[-1] in ".!?…。:;" for _, t, _ in leaves])
        marks = np.array([sum(map(t.count, ".,;!?")) for _, t, _ in leaves]) / np.maximum(count, 1)
        rank = np.arange(first, first + n) / max(1, total - 1)
        shape = np.stack([np.log1p(size) / 6, np.log1p(count) / 4, link, ends, np.minimum(marks, 1), rank, 1 - rank, np.full(n, np.log1p(total) / 4), count < 6, (link > 0.5)], 1)
        return np.log1p(np.minimum(hashed, 3)), shape

    def path_sum(self, e: Element | None) -> np.ndarray:
        """Sum of the embeddings of the tokens of an element's path."""
        todo = []
        while e is not None and e.sum is None:
            todo.append(e)
            e = e.parent
        v = np.zeros(INNER, np.float32) if e is None else e.sum
        for e in reversed(todo):
            for t in e.new:
                if (x := self.token.get(t)) is None:
                    if len(self.token) > 50_000:
                        self.token.clear()
                    self.token[t] = x = self.w["path"][bucket(t, PATHS)]
                v = v + x
            e.sum = v
        return v

    def embed(self, leaves: list) -> np.ndarray:
        out = np.empty((len(leaves), INNER), np.float32)
        for at in range(0, len(leaves), STEPS):
            words, shape = self.features(leaves, at, at + STEPS)
            got = np.array([self.path_sum(e) for e, _, _ in leaves[at : at + STEPS]], np.float32)
            out[at : at + STEPS] = np.tanh(got + words.astype(np.float32) @ self.w["word"] + shape.astype(np.float32) @ self.w["shape"] + self.w["bias"])
        return out

    def run(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities of (pages, steps, INNER): both directions step by step, side by side; the one that
        reads backwards starts at the end of each page."""
        n, steps, _ = x.shape
        w, at = self.w, np.arange(n)[:, None]
        wx, wh, b = (np.stack([w[f"f_{k}"], w[f"b_{k}"]]) for k in ("x", "h", "b"))
        wide = np.repeat(np.array([1, 1, 1, 2], np.float32), HIDDEN)  # tanh(z) = 2 / (1 + exp(-2 z)) - 1
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        out = np.zeros((n, steps), np.float32)
        weight = w["out"].reshape(2, HIDDEN, 1)
        for first in range(0, steps, STEPS):
            t = np.arange(first, min(steps, first + STEPS))
            back = np.maximum(length[:, None] - 1 - t, 0)
            pre = np.stack([x[:, t] @ wx[0] + b[0], x[at, back] @ wx[1] + b[1]])
            got = np.empty((2, n, len(t), HIDDEN), np.float32)
            for k in range(len(t)):
                s = 1 / (1 + np.exp(-(pre[:, :, k] + h @ wh) * wide))
                c = s[..., HIDDEN : 2 * HIDDEN] * c + s[..., :HIDDEN] * (2 * s[..., 3 * HIDDEN :] - 1)
                h = s[..., 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
                got[:, :, k] = h
            out[:, t] += (got[0] @ weight[0])[..., 0]
            on = t < length[:, None]  # beyond a page's end nothing counts
            page, k = np.nonzero(on)
            out[page, back[page, k]] += (got[1] @ weight[1])[page, k, 0]
        return 1 / (1 + np.exp(-(out + w["out_b"])))

    def scores(self, pages: list[list]) -> list[np.ndarray]:
        """Probability of main text for every block of every page."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        s = 0
        while s < len(order):
            e = s + 1
            while e < len(order) and (e + 1 - s) * len(pages[order[e]]) <= 20_000:
                e += 1
            part = order[s:e]
            length = np.array([len(pages[i]) for i in part])
            x = np.zeros((len(part), length[-1], INNER), np.float32)
            for k, i in enumerate(part):
                x[k, : len(pages[i])] = self.embed(pages[i])
            p = self.run(x, length)
            for k, i in enumerate(part):
                out[i] = p[k, : len(pages[i])]
            s = e
        return out


_labeller: list[Labeller] = []


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text, n_chars, n_blocks, n_main) of every page."""
    small_batches(pages.sparkSession)
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, *keep)}

    def run(batches):
        if not _labeller:
            _labeller.append(Labeller.load())
        model = _labeller[0]
        for b in slices(batches):
            leaves = [blocks(h) for h in b.column(b.num_columns - 1).to_pylist()]
            scores = model.scores(leaves)
            texts = ["\n\n".join(t for (_, t, _), p in zip(ls, ps) if p >= 0.5) for ls, ps in zip(leaves, scores)]
            arrays = [*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            arrays += [pa.array([len(x) for x in leaves], pa.int64()), pa.array([int((x >= 0.5).sum()) for x in scores], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"c{i}" for i in range(b.num_columns - 1)), "text", "n_chars", "n_blocks", "n_main"])

    picked = pages.select(*[col(c).alias(f"c{i}") for i, c in enumerate(kinds)], col(html_col).cast("string").alias("html"))
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds.values())) + ", text string, n_chars long, n_blocks long, n_main long"
    return picked.mapInArrow(run, schema).withColumnsRenamed({f"c{i}": c for i, c in enumerate(kinds)})
