"""Quality classifier with hierarchical empirical Bayes (operator 10).

1. Fit: from at most SAMPLE_ROWS labelled rows (the smallest hashes of their ids, so the same rows
   at any partitioning) two logistic models are fitted on the driver: "poor" (quality = 0) and
   "toxic" (toxic = 1). Features: the presence of the WORDS words that tell the classes apart best,
   chosen by a grouped count over the sample, and indicators of shape (repeats, symbols, capitals).
   The bound is the documented parameter; all else covers every row.
2. Evidence: every document, whole text, gets both probabilities under the global prior.
3. Sites: sums of the evidence for each host and each path of a host, by grouped aggregation
   (partial sums first, so a host with a third of all rows is no hot spot). The mean of a host is
   shrunk toward the global mean, that of a path toward its host's; the weight of a prior, in
   documents, is estimated from the spread of the site means (method of moments).
4. Decision: logit(document) + logit(path posterior) - logit(global mean), for each model; a
   document is kept unless one of the two exceeds the threshold.

Cases: null or empty text is a document without words, judged by its shape alone; null host or
path is a site of its own; null labels are not used; repeated rows get a result each; without
labels, or with one class only, that model gives probability 0 and nothing is rejected by it.
Rows are told apart by 128 bits of the named columns, so rows that agree in these share a decision.
Other columns are not read; their names and types cannot clash. Empty table: empty result. Texts of
any length are read whole; ties in the choice of words go to the smaller word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, lean, row_key, slices, small_batches, without

SAMPLE_ROWS, WORDS, THRESHOLD = 8000, 1000, 0.5
CACHE_WORDS = 250_000
MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
EDGES = {  # shape: thresholds of the indicators
    "repeat": (0.03, 0.06, 0.15, 0.4), "top": (0.15, 0.25, 0.4), "symbols": (0.03, 0.06, 0.1, 0.2),
    "capitals": (0.05, 0.1, 0.3), "pipes": (0.05, 0.2), "spread": (0.3, 0.5, 0.7), "digits": (0.05, 0.2),
    "length": (6.0, 7.0, 9.0), "short": (0.3,),
}


class _Ids(dict):
    """word -> number, in order of meeting; hit[number] is the word's feature or -1."""

    def __init__(self, feature):
        self.feature, self.hit = feature, np.empty(1 << 12, np.int64)

    def __missing__(self, word):
        n = len(self)
        if n == len(self.hit):
            self.hit = np.concatenate([self.hit, np.empty(n, np.int64)])
        self.hit[n] = self.feature(word)
        self[word] = n
        return n


class Features:
    """Shape indicators and vocabulary hits of a text; lists of feature numbers."""

    def __init__(self, vocabulary: list[str]):
        self.vocabulary = {w: i for i, w in enumerate(vocabulary)}
        self.names = [f"{k}>{e}" for k, v in EDGES.items() for e in v]
        self.size = len(self.names) + len(vocabulary)
        self.ids = _Ids(self._feature)

    def _feature(self, word: bytes) -> int:
        at = self.vocabulary.get(word.decode("utf-8", "ignore").strip(STRIP).lower(), -1)
        return at + len(self.names) if at >= 0 else -1

    def of(self, text: str) -> np.ndarray:
        raw = text.encode()
        words = raw.split()
        if len(self.ids) > CACHE_WORDS:
            self.ids = _Ids(self._feature)
        n = len(words)
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, n)
        byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        size = max(1, len(raw))
        uniq, counts = np.unique(ids, return_counts=True)
        shape = {
            "repeat": float((ids[1:] == ids[:-1]).sum()) / max(1, n) if n > 8 else 0.0,
            "top": float(counts.max(initial=0)) / max(1, n) if n > 8 else 0.0,
            "symbols": float(byte[list(MARKS)].sum()) / size if n > 2 else 0.0,
            "capitals": float(byte[65:91].sum()) / size if n > 2 else 0.0,
            "pipes": float(byte[124]) / max(1, n),
            "spread": 1 - len(uniq) / max(1.0, n**0.93) if n > 8 else 0.0,
            "digits": float(byte[48:58].sum()) / size,
            "length": size / max(1, n),
            "short": 1.0 / (1 + n / 3),
        }
        out, at = [], 0
        for k, edges in EDGES.items():
            out += [at + i for i, e in enumerate(edges) if shape[k] > e]
            at += len(edges)
        got = self.ids.hit[uniq]
        return np.concatenate([np.array(out, np.int64), np.unique(got[got >= 0])])


STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, size: int, l2: float = 0.3, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2 logistic regression on binary features, by Adam with a falling rate; deterministic."""
    if not len(y) or y.min() == y.max():
        return np.zeros(size), -math.inf
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    w, b = np.zeros(size), math.log(y.mean() / (1 - y.mean()))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[flat], len(rows)) + b, -30, 30)))
        g = np.append(np.bincount(flat, (p - y)[at], size) + l2 * w, (p - y).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, words: int = WORDS) -> dict:
    """{vocabulary, poor: (weights, bias), toxic: (weights, bias)} from a bounded sample of labelled rows."""
    picked = (
        labels.select(col(id_col).alias("id"), F.col("quality").alias("q"), F.col("toxic").alias("t"))
        .where("id is not null and q is not null and t is not null")
        .orderBy(F.xxhash64("id"), "id", "q", "t")
        .limit(sample_rows)
    )
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    rows = cut(rows.select("text", "q", "t"), "labelled")
    word = F.explode(F.array_distinct(F.transform(F.split("text", r"\s+"), lambda x: F.lower(F.btrim(x, F.lit(STRIP)))))).alias("word")
    counted = rows.select("q", "t", word).where("word <> ''").groupBy("word")
    counted = counted.agg(F.count("*").alias("n"), F.sum(1 - F.col("q")).alias("poor"), F.sum("t").alias("bad")).where("n >= 4")
    all_n, all_poor, all_bad = rows.agg(F.count("*"), F.sum(1 - F.col("q")), F.sum("t")).first()
    vocabulary: list[str] = []
    for kind, total in (("poor", all_poor), ("bad", all_bad)):
        if total:
            share = total / all_n  # signed root of the chi-square of word and class
            lift = (F.col(kind) - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-9))
            vocabulary += [r.word for r in counted.orderBy(F.desc(F.round(lift, 6)), "word").limit(words // 2).select("word").collect()]
    vocabulary = list(dict.fromkeys(vocabulary))

    def features(batches):
        f = Features(vocabulary)
        for b in batches:
            got = [f.of(t).tolist() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int64())), b.column(1).cast(pa.int64()), b.column(2).cast(pa.int64())], names=["x", "q", "t"])

    got = rows.mapInArrow(lean(features), "x array<long>, q long, t long").toArrow()  # sample_rows rows at most
    x = [np.array(r, np.int64) for r in got["x"].to_pylist()]
    q, t = got["q"].to_numpy().astype(float), got["t"].to_numpy().astype(float)
    size = Features(vocabulary).size
    return {"vocabulary": vocabulary, "poor": fit_logistic(x, 1 - q, size), "toxic": fit_logistic(x, t, size)}


def evidence(docs: DataFrame, model: dict, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    """(id, host, path, row, poor, toxic) of every row; row is a hash of the named columns."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        f = Features(model["vocabulary"])
        both = [model["poor"], model["toxic"]]
        for b in slices(batches):
            out = [[], []]
            for t in b.column(4).to_pylist():
                x = f.of(t or "")
                for k, (w, bias) in enumerate(both):
                    out[k].append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[x].sum()) + bias)))) if bias > -math.inf else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out[0], pa.float64()), pa.array(out[1], pa.float64())], names=["id", "host", "path", "row", "poor", "toxic"])

    picked = docs.select(
        col(id_col).alias("id"), col(host_col).cast("string").alias("host"), col(path_col).cast("string").alias("path"),
        own_key(id_col, text_col, host_col, path_col).alias("row"), col(text_col).cast("string").alias("text"),
    )
    return picked.mapInArrow(lean(run), f"id {kind}, host string, path string, row binary, poor double, toxic double")


def own_key(*names: str):
    return row_key(*[col(c) for c in names])


def _strength(groups: DataFrame, value: str, mean, n: str = "n"):
    """Prior weight in documents: within-site variance over between-site variance, by moments."""
    k, total, sq, spread, within = groups.agg(
        F.count("*"), F.sum(n), F.sum(F.col(n) * F.col(n).cast("double")),
        F.sum(F.col(n) * F.pow(F.col(value) / F.col(n) - mean, 2)), F.sum(F.col(value + "_sq") - F.col(value) * F.col(value) / F.col(n)),
    ).first()
    if not k or k < 2 or total <= k:
        return 10.0
    inside = max(1e-9, float(within) / (total - k))
    between = (float(spread) - (k - 1) * inside) / (total - float(sq) / total)
    return min(1e6, max(1.0, inside / between if between > 1e-12 else 1e6))


def sites(ev: DataFrame) -> DataFrame:
    """(host, path, n, host_poor, path_poor, host_toxic, path_toxic, all_poor, all_toxic): posteriors."""
    sums = [f for c in ("poor", "toxic") for f in (F.sum(c).alias(c), F.sum(F.col(c) * F.col(c)).alias(c + "_sq"))]
    paths = cut(ev.groupBy("host", "path").agg(F.count("*").alias("n"), *sums), "paths")
    again = [F.sum(c).alias(c) for c in ("poor", "poor_sq", "toxic", "toxic_sq")]
    hosts = cut(paths.groupBy("host").agg(F.sum("n").alias("n"), *again), "hosts")
    total = hosts.agg(F.sum("n"), F.sum("poor"), F.sum("toxic")).first()
    n, mean = total[0] or 1, {"poor": (total[1] or 0) / (total[0] or 1), "toxic": (total[2] or 0) / (total[0] or 1)}
    h = hosts.select(F.col("host").alias("h"), *[((F.col(c) + mean[c] * s) / (F.col("n") + s)).alias("host_" + c) for c in mean for s in [_strength(hosts, c, mean[c])]])
    out = paths.join(h, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    for c in mean:
        s = _strength(paths, c, mean[c])
        out = out.withColumn("path_" + c, (F.col(c) + F.col("host_" + c) * s) / (F.col("n") + s)).withColumn("all_" + c, F.lit(float(mean[c])))
    return cut(out.select("host", "path", "n", *[a + c for c in mean for a in ("host_", "path_", "all_")]), "sites")


def _logit(c):
    p = F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p) - F.log(1 - p)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", threshold: float = THRESHOLD, model: dict | None = None) -> DataFrame:
    """(id, row, poor, toxic, host_*, path_*, p_poor, p_toxic, keep) of every row."""
    small_batches(docs.sparkSession)
    model = model or fit(docs, labels, id_col, text_col)
    ev = cut(evidence(docs, model, id_col, text_col, host_col, path_col), "evidence")
    site = sites(ev).withColumnsRenamed({"host": "h", "path": "p"})
    out = ev.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    for c in ("poor", "toxic"):
        z = _logit(F.col(c)) + _logit(F.col("path_" + c)) - _logit(F.col("all_" + c))
        out = out.withColumn("p_" + c, F.when(F.col(c) == 0, 0.0).otherwise(1 / (1 + F.exp(-z))))
    out = out.withColumn("keep", (F.col("p_poor") <= threshold) & (F.col("p_toxic") <= threshold))
    return out.drop("h", "p").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", **kw) -> DataFrame:
    """The rows of docs that the classifier keeps, with docs' own columns."""
    out = classify(docs, labels, id_col, text_col, host_col, path_col, **kw)
    gone = cut(out.where(~F.col("keep")).select(F.col("row").alias("gone")).distinct(), "rejected")
    return without(docs, gone, own_key(id_col, text_col, host_col, path_col))
