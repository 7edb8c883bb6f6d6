"""Brute force, round trips, held-out accuracy and edge cases of the llm operators."""

import hashlib
import html as html_lib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bpe, chats, decontaminate, html, jaccard, lines, neighbours, quality, secrets, train_labeller, warc
from weftgraph.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s%d" % (k % 3), len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))], DOC)


def words(r, n, vocabulary=2000):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


# -- 1: BPE --------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokens():
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    import tiktoken

    ranks = {t: i for i, t in enumerate(bpe.load_ranks(path)) if t}
    return path, public.PATTERN, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", None, "Hello world's 12 ...", "a" * 6000, " " * 700 + "x\n\n\t y", "é\x85ü ß中文字🙂🙂", "\x1c \x1d a", "<|endoftext|>", "ab" * 3000, "it's I'LL we'd", "same", "same"]


def test_bpe_equals_the_library_and_decodes(spark, tokens):
    path, pattern, ref = tokens
    rows = bpe.round_trip(docs(spark, TEXTS, [5, 6, 7, 8, None, 9, 10, 11, 12, 13, 14, 14]).withColumnRenamed("n_chars", "n_tokens"), path, pattern).collect()
    want = []
    for i, t in zip([5, 6, 7, 8, None, 9, 10, 11, 12, 13, 14, 14], TEXTS):
        ids = ref.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    coded = bpe.encode(docs(spark, TEXTS), path, pattern)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(coded, path).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert bpe.round_trip(docs(spark, []), path, pattern).count() == 0


def test_both_trees_agree(tokens):
    path, pattern, ref = tokens
    r = random.Random(1)
    coder = bpe.Bpe(bpe.load_ranks(path), pattern)
    pieces = ["".join(r.choice("theringaéß ") for _ in range(r.randint(2, 60))).encode() for _ in range(400)]
    for p, ids in zip(pieces, coder.encode_pieces(pieces)):
        assert list(ids) == coder._tree(p) == ref._encode_single_piece(p)


# -- 2: HTML -------------------------------------------------------------------------------

def test_labeller_held_out():
    blocks_right, pages_right = train_labeller.accuracy(html.Labeller.load().w, train_labeller.labelled(12345, 300))
    assert blocks_right > 0.99 and pages_right > 0.9


def test_html_blocks():
    page = "<body><nav><ul><li><a href=x>Home<li><a>About</a></ul></nav><!-- <p>no</p> --><script>var a='<p>';</script><p>One &amp; <b>two<br>three<p>Four&nbsp;five</body>"
    got = html.blocks(page)
    assert [t for _, t, _ in got] == ["Home", "About", "One & two three", "Four five"]
    assert got[0][2] == 4 and got[2][2] == 0 and "nav" in html.path(got[0][0])
    assert html.blocks(None) == [] and html.blocks("") == [] and html.blocks("<p></p>") == []
    assert [t for _, t, _ in html.blocks("bare text")] == ["bare text"]


def test_blocks_of_drawn_pages():
    """Pages drawn as trees, with the path and text of every block known."""
    r = random.Random(31)
    deep, inline = ["div", "section", "article", "ul", "figure", "blockquote", "main"], ["b", "a", "span", "em"]

    def draw(path, depth):
        out, want = "", []
        for _ in range(r.randint(1, 3)):
            if depth and r.random() < 0.6:
                tag = r.choice(deep)
                name = r.choice(["", "menu", "mainText", "ad-box"])
                inner, got = draw(path | {tag} | {"." + p.lower() for p in re.findall("[A-Z]?[a-z]+", name)}, depth - 1)
                out += f'<{tag}{r.choice([" class=", " id="])}"{name}" title="a > b">{inner}</{tag}>'
                want += got
            else:
                words_ = [f"w{r.randrange(99)}" for _ in range(r.randint(1, 5))]
                tag = r.choice(inline)
                out += "<hr>" + r.choice([" ", "<!-- <p>no</p> -->"]) + f"<{tag}>{words_[0]}</{tag}> " + r.choice(["\n", " &nbsp;", "<br>"]).join(words_[1:]) + "<script>if (a<b) '</p>'</script><hr>"
                want.append((path, " ".join(words_)))
        return out, want

    for _ in range(200):
        page, want = draw(set(), 5)
        assert [(html.path(e), t) for e, t, _ in html.blocks(page)] == want


def test_broken_pages_are_linear():
    import time

    t = time.time()
    model, n = html.Labeller.load(), 20_000
    for page, many in (("<p " * 10 * n, 0), ("<div>x" * n, n), ("<ul><li><ul>" * n + "<li>y" * n, n), ('<p a="x' * 10 * n, 0), ("<a><button>z" * n + "</label>" * n, 1),
                       ("<!-- " * 10 * n, 0), ("&#" + "9" * n + ";" + "&" * n, 1), ("<p \"'>q" * n, n), ("<svg/><title>no<p></title>x" + "<" * n, 1)):
        got = html.blocks(page)
        assert len(got) == many and [len(s) for s in model.scores([got, []])] == [many, 0]
    assert time.time() - t < 60


def test_html_extraction(spark):
    body = [f"This is paragraph number {i}, which says a thing or two, and then it ends." for i in range(6)]
    article = "<h1>A title of it</h1>" + "".join(f"<p>{html_lib.escape(b)}</p>" for b in body)
    page = f'<html><head><title>T</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><div class="ad">Buy now.</div><article>{article}</article><div class="comments"><div class="comment"><p>I do not agree with this at all.</p></div></div><footer>&copy; Me</footer></body></html>'
    t = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(t).collect()}
    assert got[1].text == "\n\n".join(["A title of it", *body]) and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and html.extract(t).count() == 4 and html.extract(t.limit(0)).count() == 0


# -- 3: lines ------------------------------------------------------------------------------

def brute_lines(rows, least=40, many=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    found: dict = {}
    for i, ls in split:
        for k in {key(x) for x in ls if len(key(x)) >= least}:
            n, last = found.get(k, (0, None))
            found[k] = (n + 1, i if last is None else last if i is None else max(last, i))
    drop = lambda i, x: key(x) in found and found[key(x)][0] >= many and i != found[key(x)][1]
    return sorted(((i, len(ls), sum(drop(i, x) for x in ls), "\n".join(x for x in ls if not drop(i, x))) for i, ls in split), key=repr)


@pytest.mark.parametrize("batches", [1, 4])
def test_lines_equal_brute_force(spark, batches):
    r = random.Random(2)
    pool = [("%s " % x) * 12 for x in words(r, 12)] + ["short", "", "É" * 39, "É" * 40, "x" * 5000]
    rows = [(r.randrange(40), "\n".join(r.choice((p, "  " + p.upper() + "\t")) for p in r.choices(pool, k=r.randint(0, 9)))) for _ in range(60)]
    rows += [(None, pool[0]), (7, None), (7, ""), (41, pool[1] + "\n" + pool[1])]
    df = docs(spark, [t for _, t in rows], [i for i, _ in rows]).withColumnRenamed("lang", "kept").withColumnRenamed("source", "h1")
    got = [(x.doc.doc_id, x.n_lines, x.n_dropped, x.kept) for x in lines.dedup_lines(df, batches=batches, fanout=2).collect()]
    assert sorted(got, key=repr) == brute_lines(rows)


def test_lines_of_string_ids(spark):
    r = random.Random(41)
    pool = [("%s " % x) * 12 for x in words(r, 6)]
    rows = [(f"d{r.randrange(30)}", "\n".join(r.choices(pool, k=r.randint(0, 5)))) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("a`b", F.create_map(F.lit(1), F.lit(2)))
    got = [(x.doc.doc_id, x.n_lines, x.n_dropped, x.kept) for x in lines.dedup_lines(df).collect()]
    assert sorted(got, key=repr) == brute_lines(rows)


def test_named_columns_only(spark):
    """Columns of any type and name beside the named ones, in the operators that tell rows apart."""
    rows = [(i, "password=abcdef12 and more words here", "en", f"s{i % 3}") for i in range(12)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("a`b", F.create_map(F.lit(1), F.lit(2))).withColumn("found", F.struct(F.lit(1).alias("row")))
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    assert secrets.digest(secrets.find(df)).where("n_assign = 1").count() == 12
    assert quality.classify(df, lab).count() == 13 and quality.keep_good(df, lab).columns == df.columns
    bench = spark.createDataFrame([(1, "password=abcdef12 and more words here")], "item_id long, text string")
    assert decontaminate.find(df, bench).count() == 12 and decontaminate.drop_contaminated(df, bench).count() == 1


def test_lines_incremental(spark):
    store = lines.RunStore(spark, 2)
    a, b = "a" * 50, "b" * 50
    first = lines.drop_seen(docs(spark, [a, b + "\nkeep"]), store).collect()
    assert {x.kept for x in first} == {a, b + "\nkeep"}
    second = lines.drop_seen(docs(spark, [a + "\nnew", "c" * 50], [None, 9]), store).collect()
    assert {x.kept for x in second} == {"new", "c" * 50}
    assert {x.kept for x in lines.drop_seen(docs(spark, ["c" * 50 + "\n" + b]), store).collect()} == {""}
    assert lines.dedup_lines(docs(spark, [])).count() == 0


# -- 4: Jaccard ----------------------------------------------------------------------------

def brute_components(rows, pct=80):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= pct * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=repr)


def near(r, base, edits):
    w = list(base)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return w


def test_jaccard_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_BLOCK", 8)  # blocks of a cell also at this size
    r = random.Random(3)
    rows, passage = [], words(r, 60)
    for g in range(8):
        base = words(r, r.choice((7, 30, 120, 300)))
        rows += [near(r, base, r.randrange(0, max(2, len(base) // 16))) for _ in range(r.choice((1, 2, 12, 30)))]
    rows += [words(r, 40) + passage + words(r, 40) for _ in range(30)]
    rows += [words(r, 9000), ["a", "B"], ["A", "b"], ["a"], ["a", "b", "c", "d", "e"]]
    texts = [" ".join(w) for w in rows] + ["", None, " \t\n ", "  one\ttwo\x0bthree\rfour five  ", "ONE two three four FIVE"]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    df = docs(spark, texts + ["null id"], ids + [None]).withColumnRenamed("lang", "n").withColumnRenamed("source", "set")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(df).collect()), key=repr)
    assert got == brute_components(list(zip(ids + [None], texts + ["null id"])))
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len({c if c is not None else ("x", i) for i, _, c in got})
    assert jaccard.join(docs(spark, [])).count() == 0


def test_tree_bound_loses_nothing():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        k = r.integers(0, 90)
        s[:k] = r.integers(0, 2**63, k).astype(np.uint64)
        sets.append(np.unique(s[: r.integers(250, 400)]))
    pts = np.array([jaccard.counts(jaccard.point(s, len(s))).astype(np.int32) for s in sets])
    n = np.array([len(s) for s in sets])
    coarse = pts.reshape(len(pts), -1, jaccard.COARSE).sum(1)
    tree = jaccard.RTree(coarse, n)
    for i, s in enumerate(sets):
        at = set(tree.search(coarse[i], len(s), 80).tolist())
        fine = jaccard.reaches(pts, n, pts[i], len(s), 80)
        for j, t in enumerate(sets):
            if 100 * len(np.intersect1d(s, t)) >= 80 * len(np.union1d(s, t)):
                assert j in at and fine[j]


def test_components(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(100, 101), (101, 101), (None, 3), (200, 100)], "a long, b long")
    got = {x.id: x.comp for x in components(e).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}
    assert components(e.limit(0)).count() == 0


# -- 5: WARC -------------------------------------------------------------------------------

def test_warc(spark):
    page = "<html lang=en><head><title>A\n b</title><style>p{}</style></head><body><p>x &amp; <b>y</b></p><!-- z --><a href=/q>link</a><script>1</script></body></html>"
    t = spark.createDataFrame([(1, "http://a/", page, 5), (2, None, None, 5), (None, "u", "", 5), (1, "http://a/", page, 5)], "page_id long, url string, html string, header int")
    src = {r.key: r for r in warc.responses(t).collect()}
    out = warc.derive(warc.responses(t)).withColumn("record", warc.record_bytes()).collect()
    assert len(out) == 8 and warc.derive(warc.responses(t.limit(0))).count() == 0
    for x in out:
        assert x.refers_to == src[x.key].record_id and x.record_id != x.refers_to
        assert x.block_digest == "sha256:" + hashlib.sha256(x.block.encode()).hexdigest() and x.content_length == len(x.block.encode())
        assert x.payload_digest == "sha256:" + hashlib.sha256(src[x.key].payload.encode()).hexdigest()
        head, rest = x.record.split("\r\n\r\n", 1)
        named = dict(h.split(": ", 1) for h in head.split("\r\n")[1:])
        assert named["WARC-Refers-To"] == x.refers_to and int(named["Content-Length"]) == x.content_length and rest == x.block + "\r\n\r\n"
    one = {x.warc_type: x for x in out if x.key == 1}
    assert one["conversion"].block == "x & y\nlink" and one["metadata"].block.startswith("title: A b\r\nlanguage: en\r\noutlinks: 1\r\nsource-content-type: text/html")


# -- 6: secrets ----------------------------------------------------------------------------

def brute_secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (name, p, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, name, m.end()) for m in re.finditer(p, t) if len(m[0]) >= least]
    return sorted(out)


def test_secrets_equal_brute_force(spark):
    r = random.Random(5)
    bits = ["password=abc", "Token : 'abcdef12'", "secret:token:abcdefgh", "api_key=" + "f" * 30, "AKIA" + "Q" * 16, "AKIAAKIA" + "Z" * 12, "AKIA123", "0123456789abcdef01234567", "é🙂", "\x01", "APIKEY=\"x.y-z=/+\"", "x" * 300, "\n"]
    texts = ["".join(r.choice(bits) + r.choice(("", " ", "\n")) for _ in range(r.randint(0, 12))) for _ in range(80)] + ["", None, "z" * 100_000 + bits[7]]
    live, shared = "Ab1" + "Xy9_" * 8, "Cd2" + "Qw8-" * 8
    texts += [f"key {live} here", *[f"sample {shared}"] * 6]
    df = docs(spark, texts).withColumnRenamed("lang", "hash")
    got = {x.doc_id: x for x in secrets.digest(secrets.find(df, repo=F.col("source"))).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute_secrets(t)
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(x[2] == k for x in want) for k in ("assign", "access", "hex"))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest() and all(x in got[i].spans.split(",") for x in text.split(",") if x)
    assert got[83].spans == f"owned:4:{4 + len(live)}" and got[84].spans == ""  # one owner; three owners
    assert secrets.find(docs(spark, [])).count() == 0


def test_secret_repeats_and_nulls(spark):
    df = spark.createDataFrame([(None, "token=abcdefgh", None, None, 1)] * 2 + [(1, "token=abcdefgh", "en", "o", 1)], DOC)
    got = secrets.find(df).collect()
    assert len(got) == 3 and all(len(x.found) == 1 and x.found[0].n_owners == 2 for x in got)


# -- 7: neighbours -------------------------------------------------------------------------

def test_neighbours(spark):
    g = np.random.default_rng(6)
    x = g.standard_normal((1500, 24)) + 3 * g.standard_normal((12, 24))[g.integers(0, 12, 1500)]
    x[300:700] = x[300]  # a vector that many rows share
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5100, [0.0] * 24, 0), (5200, [float("nan")] * 24, 0), (5300, [1.0], 0), (5400, [None] * 24, 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    out = neighbours.search(df.drop("score"), df.where("vec_id % 100 = 0"))
    got: dict = {}
    for q, rank, i, s in sorted(map(tuple, out.collect())):
        got.setdefault(q, []).append((i, s))
    y, hit = x.astype(float), 0
    assert sorted(got) == list(range(0, 1500, 100))
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        o = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        hit += len({i for i, _ in found} & set(o))
        assert len(found) == 10 and all(abs(d[i] - s) < 1e-9 for i, s in found) and found == sorted(found, key=lambda p: (p[1], p[0]))
    assert hit / (10 * len(got)) >= 0.9
    assert [i for i, _ in got[300]][:10] == list(range(301, 311)) and [i for i, _ in got[400]][:10] == list(range(300, 310))


def test_neighbours_without_structure_in_blocks(spark, monkeypatch):
    """Vectors alike in all directions, lists of many blocks, many turns of queries, vectors of two lengths."""
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    x = np.random.default_rng(16).standard_normal((600, 32))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(1000 + i, v[:3].tolist(), "x") for i, v in enumerate(x[:40])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, list string")
    got = sorted(map(tuple, neighbours.search(df, df.where("vec_id % 20 = 0"), k=5).collect()))
    hit = 0
    for ids, y in ((range(600), x), (range(1000, 1040), x[:40, :3])):
        for q in range(ids[0], ids[-1] + 1, 20):
            d = np.sqrt(((y - y[q - ids[0]]) ** 2).sum(1))
            o = [ids[0] + i for i in np.argsort(d, kind="stable") if ids[0] + i != q][:5]
            hit += len({r[2] for r in got if r[0] == q} & set(o))
    assert len(got) == 32 * 5 and hit / len(got) >= 0.9


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.search(df, df.where("vec_id = 0")).collect()))
    assert [(r[1], r[2]) for r in got] == [(1, 2), (2, 1)]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


# -- 8: chats ------------------------------------------------------------------------------

def test_chats(spark):
    a, b, c = ("user", "hi"), ("assistant", "hello"), ("user", "more")
    convs = {1: [a], 2: [a, b], 3: [a, b, c], 4: [a, c], 5: [a, b, c], 6: [("system", "hi"), b], 7: [(None, None)], 8: [a, b]}
    rows = [(k, 10 * t, r, x, "z") for k, ts in convs.items() for t, (r, x) in enumerate(ts)] + [(3, 0, "user", "hi", "z"), (None, 0, "user", "hi", "z"), (9, None, "user", "hi", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string")
    got = {x.conv_id: x for x in chats.collapse(df).collect()}
    assert set(got) == {3, 4, 6, 7}
    assert got[3].n_turns == 3 and got[3].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[7].chat == "<|im_start|>user\n<|im_end|>\n" and chats.collapse(df.limit(0)).count() == 0


# -- 9: decontamination --------------------------------------------------------------------

def test_lcs():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(7)
    for _ in range(200):
        a, b = [r.randrange(6) for _ in range(r.randrange(90))], [r.randrange(6) for _ in range(r.randrange(90))]
        assert decontaminate.lcs(a, b) == slow(a, b)


def test_decontamination(spark):
    r = random.Random(8)
    items = [(i, " ".join(words(r, r.randint(15, 55), 3000)) + ".") for i in range(30)] + [(40, None), (41, ""), (42, "w1")]
    clean = [" ".join(words(r, r.randint(0, 400), 3000)) for _ in range(60)]
    texts, truth = list(clean) + [None, ""], set()
    for i, t in items[:30]:
        w = t.split()
        if i % 3 == 0:  # whole, in other case and marks
            w = [x.upper() + "!!" for x in w]
        elif i % 3 == 1:  # a paraphrase: one word in eight another, the end kept
            w = [x if k % 8 or k > len(w) - 6 else "other" for k, x in enumerate(w)]
        else:  # half of it only
            w = w[: len(w) // 2 - 1]
        texts.append(" ".join(words(r, r.randint(0, 300), 3000) + w + words(r, r.randint(0, 300), 3000)))
        if i % 3 < 2:
            truth.add((len(texts) - 1, i))
    texts.append(" ".join(words(r, 15000, 3000)) + " " + items[0][1])
    truth.add((len(texts) - 1, 0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, texts).withColumnRenamed("source", "row")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find(df, bench).collect() if x.item_id != 42}
    assert got == truth
    assert {x for x in truth} == {(x.doc_id, x.item_id) for x in decontaminate.find(df, bench.where("item_id < 42")).collect()}
    kept = decontaminate.drop_contaminated(df, bench.where("item_id < 42"))
    assert kept.columns == df.columns and kept.count() == len(texts) - len({d for d, _ in truth})
    assert decontaminate.find(df, bench.limit(0)).count() == 0 and decontaminate.find(df.limit(0), bench).count() == 0


def test_latent_space_is_that_of_the_passages(spark):
    """Against a dense SVD: the space holds nearly as much of the TF-IDF passages as the best one of its rank."""
    r = random.Random(9)
    subjects = [[f"s{k}x{i}" for i in range(12)] for k in range(20)]
    texts = [" ".join(r.choice(subjects[n % 20]) if r.random() < 0.9 else r.choice(subjects[r.randrange(20)]) for _ in range(200)) for n in range(80)]
    df = docs(spark, texts)
    coded = decontaminate.tokenised(df, "doc_id", "text").cache()
    h = {w: int(decontaminate.word_hashes(w)[0]) for s in subjects for w in s}
    df_of = {x.word: x.n for x in decontaminate.document_counts(coded, np.array(list(h.values())), 99).collect()}
    assert df_of == {h[w]: sum(w in set(t.split()) for t in texts) for w in h}
    voc = decontaminate.Vocabulary(df_of, 80, 0.5)
    v = decontaminate.latent_space(coded.where("bucket is null"), voc, rank=20)
    assert v.shape == (240, 20) and np.allclose(v.T @ v, np.eye(20), atol=1e-6)
    a = []
    for t in texts:
        ids = voc.places(np.array([h[w] for w in t.split()], np.uint32))
        a += [np.bincount(ids[i : i + 64], minlength=240) * voc.rare[:-1] for i in range(0, 200, 64)]
    a = np.array(a)
    best = (np.linalg.svd(a, compute_uv=False)[:20] ** 2).sum()
    assert np.linalg.norm(a @ v) ** 2 > 0.9 * best


def test_word_hashes():
    r = random.Random(23)
    base = ["a", "B.", "(é)", "--", "x" * 70, "Ñandú", "don't", "'q'", "", "\n", "\x1c", "-a-b-", "🙂"]
    text = " ".join(r.choice(base) for _ in range(4000))
    split = [w.decode().strip(quality.STRIP).lower() for w in text.encode().split()]
    got = decontaminate.word_hashes(text)
    assert len(got) == len(split) and len({*zip(got.tolist(), split)}) == len(set(split)) == len(set(got.tolist()))
    old, decontaminate.BLOCK = decontaminate.BLOCK, 64  # parts, and words longer than a part
    try:
        assert decontaminate.word_hashes(text).tolist() == got.tolist()
    finally:
        decontaminate.BLOCK = old
    assert len(decontaminate.word_hashes(None)) == len(decontaminate.word_hashes(" \t ")) == 0


def brute_found(texts, items, sure=0.8):
    """Documents that hold at least `sure` of an item's words in a row of windows, by plain search."""
    words_of = lambda t: [w.strip(quality.STRIP).lower() for w in (t or "").split()]
    out = set()
    for d, t in enumerate(texts):
        doc = words_of(t)
        for i, x in items:
            item = [w for w in words_of(x) if w]
            size = 2 * len(item) + 16
            if item and any(decontaminate.lcs(item, doc[at : at + size]) >= sure * len(item) for at in range(0, max(1, len(doc)), 8)):
                out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark):
    r = random.Random(21)
    items = [(i, " ".join(words(r, r.randint(6, 30), 600))) for i in range(12)]
    texts = []
    for n in range(60):
        w = words(r, r.randint(0, 90), 600)
        item = items[n % 12][1].split()
        if n % 2:
            w = w + [x if r.random() > 0.08 else "changed" for x in item] + words(r, r.randint(0, 40), 600)
        texts.append(" ".join(w))
    got = {(x.doc_id, x.item_id) for x in decontaminate.find(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), answer_share=1.1).collect()}
    want = brute_found(texts, items)
    assert len(want) > 20 and got == want


def test_decontamination_of_long_items(spark):
    """An item of 40,000 words, one of 70,000 distinct ones, and words of any length."""
    r = random.Random(22)
    long, many, huge = words(r, 40_000, 5000), [f"m{k}" for k in range(70_000)], ["x" * 100_000, "short", "words", "y" * 70]
    texts = [" ".join(words(r, 300) + long), " ".join(many), " ".join(words(r, 50)), " ".join(words(r, 20) + huge + words(r, 20)), " ".join(many[:40_000])]
    df = docs(spark, texts).withColumn("a`b", F.create_map(F.lit("k"), F.lit(1))).withColumnRenamed("lang", "row")
    bench = spark.createDataFrame([("a", " ".join(long)), ("b", " ".join(many)), ("c", " ".join(huge))], "item_id string, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find(df, bench).collect()} == {(0, "a"), (1, "b"), (3, "c")}
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {x.doc_id for x in kept.select("doc_id").collect()} == {2, 4}


# -- 10: quality ---------------------------------------------------------------------------

def test_quality(spark):
    r = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        w = words(r, r.randint(30, 120), 400)
        kind = i % 4
        if kind == 1:
            w = [x + "%%%" for x in w]
        if kind == 2:
            for _ in range(4):
                w[r.randrange(len(w))] = r.choice(("vile", "nasty", "rotten"))
        rows.append((i, " ".join(w), "en" if i % 2 else "fr", "big" if i % 3 else "s%d" % (i % 7), 1))
        labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [(900, None, None, None, 0), (901, "", "en", "big", 0), (3, rows[3][1], "en", "big", 0)]
    df = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame([x for x in labels if x[0] % 2 == 0 or x[0] < 200] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, lab).collect()
    assert len(got) == len(rows)
    held = [(x.doc_id % 4, x.keep) for x in got if x.doc_id is not None and x.doc_id < 400 and x.doc_id % 2 and x.doc_id >= 200]
    assert np.mean([k == (c in (0, 3)) for c, k in held]) > 0.97
    assert all(x.keep for x in got if x.doc_id % 4 in (0, 3) and x.doc_id < 400)
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(x.keep for x in got)
    assert quality.classify(df.limit(0), lab).count() == 0
    none = quality.classify(df, lab.limit(0))
    assert none.where("not keep").count() == 0 and none.count() == len(rows)


def test_sites_shrink(spark):
    ev = [(i, "a", "x", 0, 0.9, 0.0) for i in range(2)] + [(i, "b", "x", 0, 0.05 + 0.1 * (i % 2), 0.0) for i in range(500)] + [(i, "c", "x", 0, 0.75 + 0.1 * (i % 2), 0.0) for i in range(300)] + [(7, None, None, 0, 0.3, 0.0)]
    s = {x.host: x for x in quality.sites(spark.createDataFrame(ev, "id long, host string, path string, row int, poor double, toxic double")).collect()}
    m = s["a"].all_poor
    assert m < s["a"].host_poor < 0.9 and abs(s["b"].host_poor - 0.1) < 0.02 and abs(s["c"].host_poor - 0.8) < 0.02 and None in s


# -- pipeline ------------------------------------------------------------------------------

def test_pipeline(spark, tokens):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{d}/documents.parquet")
    names = docs_.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs_
        docs_ = corpus_pipeline.cut(stage(spark, docs_, d), name)
        if name != "tokens":
            assert docs_.columns == names and docs_.count() <= before.count()
        if name == "line_dedup":
            assert sorted(zip(*docs_.select("doc_id", "text").toPandas().values.T), key=repr) == sorted(((i, k) for i, _, _, k in brute_lines([tuple(x) for x in before.select("doc_id", "text").collect()])), key=repr)
        if name == "near_copies":
            want = {c for _, _, c in brute_components([tuple(x) for x in before.select("doc_id", "text").collect()])}
            assert {x.doc_id for x in docs_.select("doc_id").collect()} == want
        if name == "benchmark":
            items = [" ".join(t.split()) for t in pd.read_parquet(f"{d}/benchmark.parquet").text]
            texts = [" ".join((x.text or "").split()) for x in docs_.select("text").collect()]
            assert not any(i in t for i in items for t in texts)
    ref = tokens[2]
    want = {x.doc_id: len(ref.encode_ordinary(x.text)) for x in before.collect()}
    assert {x.doc_id: x.n_tokens for x in docs_.collect()} == want
