"""Cases that the llm operators used to leave out."""

import html as html_lib
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, lines, warc


def conversions(spark, pages):
    t = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("http://a/"))
    return {x.key: x.block for x in warc.derive(warc.responses(t)).where("warc_type = 'conversion'").collect()}


def test_warc_decodes_every_reference(spark):
    pages = [
        "<p>&copy; 2024 &middot; caf&eacute; &mdash; it&#8217;s &#x2014; &#X41;&amp;lt; a&#160;b&nbsp;c&#9;d &notareference; AT&T &#0; &copy</p>",
        "<html><head><script>x</script><title>leaked</title><style>p{}</style><meta></HEAD><body>kept</body></html>",
        '<head><script>"</head> leaked </style>"</script><title>leaked</title></head><p>kept</p>',
        "<html><head><title>leaked</title><body>kept<header>and this</header>",
        "".join(f"<p>{r}</p>" for r in ("&NotEqualTilde;", "&hearts;", "&Aacute;", "&#128578;")),
        None,
    ]
    got = conversions(spark, pages)
    assert got[0] == "© 2024 · café — it’s — A&lt; a b c d ¬areference; AT&T � ©"
    assert got[1] == "kept" and got[2] == "kept" and got[3] == "kept\nand this"
    assert got[4] == "\n".join(html_lib.unescape(r) for r in ("&NotEqualTilde;", "&hearts;", "&Aacute;", "&#128578;")) and got[5] == ""


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_swapped_heavy_words_are_retrieved(spark):
    """Items of common words and heavy ones of a subject; the paraphrase has other heavy words of the subject."""
    r = random.Random(12)
    common = [f"c{i}" for i in range(40)]
    subjects = [[f"s{k}x{i}" for i in range(24)] for k in range(60)]
    texts = [" ".join(r.choice(subjects[n % 60]) if r.random() < 0.5 else r.choice(common) for _ in range(120)) for n in range(480)]
    items, truth = [], set()
    for k in range(0, 60, 6):
        w = [r.choice(common) for _ in range(30)]
        heavy = sorted(r.sample(range(25), 10))  # the last words, the answer, stay
        old, new = w[:], w[:]
        for at, (a, b) in zip(heavy, zip(subjects[k][:10], subjects[k][12:22])):
            old[at], new[at] = a, b
        items.append((k, " ".join(old)))
        texts.append(" ".join(new))
        truth.add((len(texts) - 1, k))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda **kw: {(x.doc_id, x.item_id) for x in decontaminate.find(docs, bench, **kw).collect()}
    assert not truth & find(near=2.0)  # containment alone
    assert truth <= find()


def test_warc_keeps_source_headers_and_links(spark):
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nLast-Modified: Mon, 01 Jan 2024 00:00:00 GMT\r\nX-Long: a\r\n  b\r\nServer: x\r\n\r\n"
    page = """<a href="/q?a=1&amp;b=2">1</a><A class=x HREF='b\n/c'>2</A><a data-href=no href=/d>3</a><a name=z>4</a>"""
    t = spark.createDataFrame([(1, "<urn:uuid:1>", "http://a/", warc.DATE, http, page)], "key long, record_id string, uri string, date string, http string, payload string")
    block = warc.derive(t).where("warc_type = 'metadata'").first().block.split("\r\n")
    assert block[5:] == [
        "source-http-status: HTTP/1.1 200 OK", "source-http-header: Content-Type: text/html; charset=iso-8859-1",
        "source-http-header: Last-Modified: Mon, 01 Jan 2024 00:00:00 GMT", "source-http-header: X-Long: a b", "source-http-header: Server: x",
        "outlink: /q?a=1&b=2", "outlink: b/c", "outlink: /d", "",
    ]


@pytest.mark.parametrize("n", [17, 49])
def test_inserted_words_stay_in_the_window(spark, n):
    """Items just above a multiple of 32 words less 15; ten words come in, at any place in a stride."""
    r = random.Random(n)
    word = lambda k: [f"w{r.randrange(3000)}" for _ in range(k)]
    item = [f"i{k}" for k in range(n)]
    texts = [" ".join(word(100)) for _ in range(40)]
    for at in range(16):
        other = r.sample(range(n - 5), round(0.28 * n))  # others in their place; the answer stays
        w = ["other" if k in other else x for k, x in enumerate(item)]
        w = w[: n // 3] + word(5) + w[n // 3 : n - 6] + word(5) + w[n - 6 :]
        texts.append(" ".join(word(32 + at) + w + word(40)))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOC)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.find(docs, bench).collect()} == set(range(40, 56))
