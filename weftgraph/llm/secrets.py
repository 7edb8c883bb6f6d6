"""Secret scans with corpus-wide ownership (operator 6); DataFrame functions only.

Base spans come from three patterns (assign, access, hex), leftmost and non-overlapping for each
kind; matches that fail the length rule are dropped after they were consumed. A fourth pattern,
opaque, proposes long mixed strings. Every candidate value is hashed and aggregated over the whole
corpus by distinct owners and repositories: a value of at least `copied` owners is a widely
copied example (`copied`), one of fewer but several is `few`; one of a single owner looks live, as `live` where
a single repository has it and as `reused` where several of that owner's do. Opaque strings of a single
owner, clear of base spans, are added to the spans as kind `owned`; base spans always stay.

Offsets: each match is set between marks and the text split at them; a running sum of the part
lengths, one window a document, gives code point offsets in time linear in the parts. Two more windows,
the largest end of base spans that start no later and the least start of those no earlier, tell in
linear time whether an owned span is clear of them. Texts are
read once; only lengths and hashes of the parts leave the scan. Values are pre-aggregated by
(hash, repository, owner) before distinct counts, so a value in a third of all rows is no hot spot.

Cases: null or empty text has no spans. U+0001 in a text counts as U+0002, which no pattern
matches. Null repository or owner counts as one unnamed one. Full repeats of a row get the
same result each, and count once in the ownership. Only the named columns are read. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, row_key

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {  # fixed values: kind, pattern, least length of the value
    "assign": (ASSIGN, 6),
    "access": (r"AKIA[A-Z0-9]+", 20),
    "hex": (r"[0-9a-f]+", 24),
    "owned": (r"[A-Za-z0-9+/_=-]{24,}", 24),
}
# The same matches for the scan: runs too short to pass are not marked one by one.
QUICK = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
ORDER = {k: i for i, k in enumerate(KINDS)}
MARK = "\x01"


def _parts(text, kind: str):
    pattern, least = KINDS[kind]
    pattern = QUICK.get(kind, pattern)

    def part(p, i):
        value = F.regexp_extract(p, pattern, 2) if kind == "assign" else p
        ok = (i % 2 == 1) & (F.length(value) >= least)
        if kind == "owned":
            ok = ok & p.rlike("[0-9]") & p.rlike("[a-z]") & p.rlike("[A-Z]")
        return F.struct(F.length(p).alias("len"), ok.alias("ok"), F.when(ok, F.sha2(value, 256)).alias("hash"))

    marked = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    return F.when(text.rlike(pattern), F.struct(F.lit(ORDER[kind]).alias("kind"), F.transform(marked, part).alias("parts")))


def scan(docs: DataFrame, id_col: str, text_col: str, repo, owner) -> DataFrame:
    """(id, row, repo, owner, found) of every row: part lengths and hashes by kind, no text."""
    plain = F.coalesce(col(text_col).cast("string"), F.lit(""))
    text = F.when(F.contains(plain, F.lit(MARK)), F.translate(plain, MARK, "\x02")).otherwise(plain)
    row = row_key(col(id_col), col(text_col), repo, owner)
    base = docs.select(col(id_col).alias("id"), row.alias("row"), repo.alias("repo"), owner.alias("owner"), text.alias("text"))
    return base.select("id", "row", "repo", "owner", F.array_compact(F.array(*[_parts(F.col("text"), k) for k in KINDS])).alias("found"))


def candidates(scanned: DataFrame) -> DataFrame:
    """(row, repo, owner, kind, hash, start, end) of every match that passes."""
    one = scanned.where(F.size("found") > 0).groupBy("row").agg(F.first("repo").alias("repo"), F.first("owner").alias("owner"), F.first("found").alias("found"))
    flat = one.select("row", "repo", "owner", F.explode("found").alias("f"))
    flat = flat.select("row", "repo", "owner", "f.kind", F.posexplode("f.parts").alias("pos", "p"))
    end = F.sum("p.len").over(Window.partitionBy("row", "kind").orderBy("pos"))
    flat = flat.withColumn("end", end).where("p.ok")
    return flat.select("row", "repo", "owner", "kind", "p.hash", (F.col("end") - F.col("p.len")).alias("start"), "end")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_copies, n_repos, n_owners) of every candidate value."""
    by = found.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    named = [F.coalesce(c, F.lit("")) for c in ("repo", "owner")]
    return by.groupBy("hash").agg(F.sum("n").alias("n_copies"), F.count_distinct(named[0]).alias("n_repos"), F.count_distinct(named[1]).alias("n_owners"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo=None, owner=None, copied: int = 3) -> DataFrame:
    """(id, found) of every row; found: array of (start, ord, end, hash, n_copies, n_repos, n_owners)
    by start, then kind; base spans and owned spans."""
    repo = F.col("source") if repo is None else repo
    owner = F.col("source") if owner is None else owner
    scanned = cut(scan(docs, id_col, text_col, repo, owner), "scan")
    found = cut(candidates(scanned), "candidates")
    stats = cut(ownership(found), "ownership")
    own = F.when(F.col("n_repos") == 1, "live").otherwise("reused")
    full = found.join(stats, "hash").withColumn("status", F.when(F.col("n_owners") == 1, own).when(F.col("n_owners") >= copied, "copied").otherwise("few"))
    full = full.withColumn("base", F.col("kind") < 3)
    up = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.withColumn("before", F.max(F.when(F.col("base"), F.col("end"))).over(up)).withColumn("after", F.min(F.when(F.col("base"), F.col("start"))).over(down))
    clear = (F.coalesce("before", "start") <= F.col("start")) & (F.coalesce("after", "end") >= F.col("end"))
    span = F.struct("start", F.col("kind").alias("ord"), "end", "hash", "n_copies", "n_repos", "n_owners", "status")
    rows = full.where(F.col("base") | ((F.col("n_owners") == 1) & clear)).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("found"))
    out = scanned.select("id", "row").join(rows, "row", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("found", F.expr("cast(array() as array<struct<start:bigint,ord:int,end:bigint,hash:string,n_copies:bigint,n_repos:bigint,n_owners:bigint,status:string>>)")).alias("found"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and joined spans of each row of find()."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s.ord), s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda f: F.size(F.filter("found", f)).cast("long")
    of = lambda k: count(lambda s: s.ord == k)
    return found.select(
        id_col, *[of(k).alias(f"n_{name}") for k, name in enumerate(("assign", "access", "hex"))],
        F.sha2(text(F.filter("found", lambda s: s.ord < 3)), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
        count(lambda s: s.n_owners == 1).alias("n_live"), count(lambda s: s.status == "reused").alias("n_reused"), count(lambda s: s.status == "copied").alias("n_copied"),
    )
