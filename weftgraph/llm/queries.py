"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chats, decontaminate, html, jaccard, lines, neighbours, quality, secrets, warc
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT r, doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.last AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS component_id FROM r GROUP BY id) m ON m.id = d.doc_id
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = F.concat_ws("/", "source", "lang")
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents"), repo=repo, owner=F.col("source")))


OP6_SQL = r"""
WITH kinds(ord, kind, pat, least) AS (VALUES
 (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
 (1, 'access', 'AKIA[A-Z0-9]+', 20), (2, 'hex', '[0-9a-f]+', 24), (3, 'owned', '[A-Za-z0-9+/_=-]{24,}', 24)),
d AS (SELECT row_number() OVER () AS r, doc_id, source AS owner, concat_ws('/', source, lang) AS repo,
      replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
p AS (SELECT r, owner, repo, ord, kind, pat, least,
      string_split(regexp_replace(t, pat, chr(1) || '\0' || chr(1), 'g'), chr(1)) AS ps FROM d, kinds WHERE regexp_matches(t, pat)),
x AS (SELECT r, owner, repo, ord, kind, pat, least, unnest(ps) AS m, generate_subscripts(ps, 1) AS i FROM p),
c AS (SELECT *, sum(length(m)) OVER (PARTITION BY r, ord ORDER BY i) AS e,
      CASE WHEN ord = 0 THEN regexp_extract(m, pat, 2) ELSE m END AS v FROM x),
f AS (SELECT r, owner, repo, ord, kind, v, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM c WHERE i % 2 = 0 AND length(v) >= least
      AND (ord < 3 OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')))),
o AS (SELECT v, count(DISTINCT coalesce(owner, '')) AS n, count(DISTINCT coalesce(repo, '')) AS repos FROM f GROUP BY v),
g AS (SELECT f.*, o.n, o.repos FROM f JOIN o USING (v)),
k AS (SELECT * FROM g WHERE ord < 3 OR (n = 1 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.r = g.r AND b.ord < 3 AND b.s < g.e AND g.s < b.e))),
a AS (SELECT r, count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE ord < 3) AS base,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans,
      count(*) FILTER (WHERE n = 1) AS n_live, count(*) FILTER (WHERE n = 1 AND repos > 1) AS n_reused, count(*) FILTER (WHERE n >= 3) AS n_copied FROM k GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_reused, 0) AS n_reused, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN a USING (r)
"""


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    record = F.sha2(warc.record_bytes(), 256).alias("record_sha256")
    return out.select(F.col("key").alias("page_id"), "warc_type", "record_id", "refers_to", "uri", "content_length", "block_digest", "payload_digest", record)


def _uuid_sql(h: str) -> str:
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _op5_sql() -> str:
    named = "t3"
    for name, to in warc.NAMED:
        named = f"replace({named}, '{name}', '{to.replace(chr(39), chr(39) * 2)}')"
    head = " || ".join(
        f"'{name}: ' || {col} || nl" for name, col in (
            ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "uri"),
            ("WARC-Refers-To-Date", f"'{warc.DATE}'"), ("WARC-Target-URI", "uri"), ("WARC-Date", f"'{warc.DATE}'"), ("WARC-Block-Digest", "block_digest"),
            ("WARC-Source-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    )
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS h, chr(13) || chr(10) AS nl FROM pages),
q AS (SELECT *, {_uuid_sql("md5('response' || chr(10) || uri || chr(10) || sha256(h))")} AS refers_to, 'sha256:' || sha256(h) AS payload_digest,
  regexp_replace(h, '(?is)<!--.*?-->|<(script|style|head)\\b[^>]*>.*?</(script|style|head)\\s*>', ' ', 'g') AS t1 FROM p),
r AS (SELECT *, regexp_replace(t1, '[ \\t\\r\\n\\f\\x0B]+', ' ', 'g') AS t2 FROM q),
s AS (SELECT *, regexp_replace(regexp_replace(t2, '(?i)<(/?(p|div|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|aside|form|blockquote|pre|body)|br)\\b[^>]*>', chr(10), 'g'),
  '<[A-Za-z/!?][^>]*>', '', 'g') AS t3 FROM r),
u AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({named}, ' *\\n *', chr(10), 'g'), ' +', ' ', 'g'), '\\n+', chr(10), 'g'), ' ' || chr(10)) AS txt FROM s),
v AS (SELECT page_id, uri, nl, refers_to, payload_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
  'title: ' || regexp_replace(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title', 1), '[ \\t\\r\\n]+', ' ', 'g') || nl ||
  'language: ' || regexp_extract(h, '(?i)<html[^>]*\\blang=["'']?([A-Za-z-]+)', 1) || nl ||
  'outlinks: ' || len(regexp_extract_all(h, '(?i)<a\\s[^>]*href=')) || nl || 'source-content-type: text/html' || nl ||
  'source-length: ' || strlen(h) || nl AS block FROM u
  UNION ALL SELECT page_id, uri, nl, refers_to, payload_digest, 'conversion', 'text/plain; charset=utf-8', txt FROM u),
w AS (SELECT *, 'sha256:' || sha256(block) AS block_digest, CAST(strlen(block) AS BIGINT) AS content_length FROM v),
x AS (SELECT *, {_uuid_sql("md5(warc_type || chr(10) || refers_to || chr(10) || block_digest)")} AS record_id FROM w)
SELECT page_id, warc_type, record_id, refers_to, uri, content_length, block_digest, payload_digest,
  sha256('WARC/1.1' || nl || {head} || nl || block || nl || nl) AS record_sha256 FROM x
""".replace("\\\\", "\\")


def op8_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chats.collapse(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "n_turns", F.length("chat").cast("long").alias("n_chars"), F.sha2("chat", 256).alias("chat_sha256"))


OP8_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM t),
p AS (SELECT conv_id, pos, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS sofar FROM o),
w AS (SELECT conv_id, max(pos) AS n FROM o GROUP BY conv_id),
e AS (SELECT p.conv_id, n, sofar FROM p JOIN w ON p.conv_id = w.conv_id AND pos = n),
k AS (SELECT min(conv_id) AS conv_id, n, sofar FROM e GROUP BY n, sofar),
x AS (SELECT DISTINCT pos AS n, sofar FROM p JOIN w USING (conv_id) WHERE pos < w.n),
m AS (SELECT k.conv_id FROM k LEFT JOIN x ON k.n = x.n AND k.sofar = x.sofar WHERE x.n IS NULL),
c AS (SELECT conv_id, count(*) AS n_turns,
      string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat FROM o JOIN m USING (conv_id) GROUP BY conv_id)
SELECT conv_id, n_turns, CAST(length(chat) AS BIGINT) AS n_chars, sha256(chat) AS chat_sha256 FROM c
"""


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("lcs_share", 4).alias("lcs_share"), "start_word")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rounded = [F.round(c, 6).alias(c) for c in ("poor", "toxic", "host_poor", "path_poor", "host_toxic", "path_toxic", "p_poor", "p_toxic")]
    return out.select("doc_id", F.col("host").alias("source"), F.col("path").alias("lang"), *rounded, "keep")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"op1_bpe": op1_bpe, "op2_html": op2_html, "op3_line_dedup": op3_line_dedup, "op4_jaccard_join": op4_jaccard_join, "op5_warc": op5_warc, "op6_secrets": op6_secrets, "op7_neighbours": op7_neighbours, "op8_chats": op8_chats, "op9_decontamination": op9_decontamination, "op10_quality": op10_quality, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op5_warc": _op5_sql(), "op6_secrets": OP6_SQL, "op8_chats": OP8_SQL}
