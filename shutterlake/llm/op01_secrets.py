"""Secret scans with corpus-wide ownership, in DataFrame operations only.

Every text is scanned for assignments, access keys, long hex runs and, as
candidates, other long mixed tokens. Offsets come from the lengths of the
pieces between matches. The value of each match is hashed, and the hashes are
counted over distinct repositories and owners of the whole corpus: a value
that several owners hold, or one owner in more than MOST_REPOS repositories, is
a copied example; another that looks random is live-looking. Live-looking candidate tokens that
overlap no base match are the spans that the method adds (kind ``owner``).

The owner of a document is its source; its repository is source and language.

Defined cases: null text is empty; null source and language are owners and
repositories of their own; rows that repeat doc_id and text are scanned as one
and give equal results; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, materialize, salted_join, text_key, text_or_empty


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, group of the value; listed in the order of ties.
KINDS = (
    ("assign", ASSIGN, 2),
    ("access", "AKIA[A-Z0-9]{12,}", 0),
    ("hex", "[0-9a-f]{32,}", 0),
    ("owner", "[A-Za-z0-9+/_=-]{20,}", 0),
)
LEAST_VALUE = 8
#: A value looks random if it has letters, digits and so many different characters.
LEAST_VARIETY = 10
#: A credential of one owner may stand in so many of its repositories.
MOST_REPOS = 2


def _matches(text: Column) -> Column:
    """An array of (kind number, [(piece before, match, value)]) of the kinds that occur."""
    kinds = []
    for n, (_, pattern, group) in enumerate(KINDS):
        p = F.lit(pattern)
        parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
        kinds.append(F.when(text.rlike(pattern), F.struct(F.lit(n).alias("ord"), parts.alias("parts"))))
    return F.filter(F.array(*kinds), lambda x: x.isNotNull())


def secret_spans(docs: DataFrame) -> DataFrame:
    """_id, _tk, ord, start, end, vh, owner, repo: matches of all kinds in code points, failing ones dropped."""
    rows = docs.select(id_key().alias("_id"), text_key().alias("_tk"), F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("owner"), F.concat_ws("\x00", "source", F.coalesce(F.col("lang").cast("string"), F.lit("\x00"))).alias("repo"), text_or_empty().alias("text"))
    found = rows.select("_id", "_tk", "owner", "repo", F.explode(_matches(F.col("text"))).alias("m"))
    found = found.select("_id", "_tk", "owner", "repo", "m.ord", F.posexplode("m.parts").alias("nth", "p")).filter("p.hit is not null")
    value = F.col("p.value")
    found = found.select("_id", "_tk", "owner", "repo", "ord", "nth", F.length("p.gap").alias("gap"), F.length("p.hit").alias("size"), F.length(value).alias("n"), F.sha2(value.cast("binary"), 256).alias("vh"), _looks_random(value).alias("random"))
    found = materialize(found.distinct(), "secret-matches")
    nth = Window.partitionBy("_id", "_tk", "owner", "repo", "ord").orderBy("nth")
    start = F.sum("gap").over(nth) + F.coalesce(F.sum("size").over(nth.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.withColumn("start", start).withColumn("end", F.col("start") + F.col("size"))
    fails = (F.col("ord") == 0) & (F.col("n") < LEAST_VALUE) | (F.col("ord") == 3) & ~F.col("random")
    return found.filter(~fails).drop("nth", "gap", "size", "n")


def _looks_random(value: Column) -> Column:
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_VARIETY)


def ownership(spans: DataFrame) -> DataFrame:
    """vh, n_repos, n_owners: in how many distinct repositories and owners each value stands."""
    pairs = spans.groupBy("vh", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("vh", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("vh").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, n_repos: one row per row of ``docs``.

    n_repos is the largest number of repositories in which a value of the row stands.
    """
    spans = materialize(secret_spans(docs), "secret-spans")
    known = materialize(ownership(spans), "secret-owners")
    spans = salted_join(spans, known, ["vh"], ["_id", "_tk", "ord", "start"], spans.count())
    place = Window.partitionBy("_id", "_tk", "owner", "repo")
    base = F.col("ord") < 3
    before = F.max(F.when(base, F.col("end"))).over(place.orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(place.orderBy(F.col("start").desc(), F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.lit(2**62)) >= F.col("end"))
    live = F.col("random") & (F.col("n_owners") == 1) & (F.col("n_repos") <= MOST_REPOS)
    spans = spans.withColumns({"free": free, "live": live}).filter(base | (F.col("free") & F.col("live")))
    name = F.element_at(F.array(*[F.lit(k) for k, _, _ in KINDS]), F.col("ord") + 1)
    one = F.struct("start", "ord", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("s"), "live", "n_repos")
    doc = spans.groupBy("_id", "_tk", "owner", "repo").agg(F.sort_array(F.collect_list(one)).alias("all"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), id_key().alias("_id"), text_key().alias("_tk"), F.coalesce(F.col("source").cast("string"), F.lit("\x00")).alias("owner"), F.concat_ws("\x00", "source", F.coalesce(F.col("lang").cast("string"), F.lit("\x00"))).alias("repo"))
    out = slim.join(doc, ["_id", "_tk", "owner", "repo"], "left").withColumn("all", F.coalesce("all", F.array()))

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: s["s"]), ",")

    def count(test) -> Column:
        return F.size(F.filter("all", test)).cast("long")

    def of_kind(n: int):
        return lambda s: s["ord"] == n

    counts = [count(of_kind(n)).alias(f"n_{k}") for n, (k, _, _) in enumerate(KINDS[:3])]
    base_text = joined(F.filter("all", lambda s: s["ord"] < 3))
    return out.select("doc_id", *counts, F.sha2(base_text.cast("binary"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_copied"), F.coalesce(F.array_max(F.transform("all", lambda s: s["n_repos"])), F.lit(0)).cast("long").alias("n_repos"))


def _sql() -> str:
    arms = "\n  UNION ALL ".join(
        f"SELECT rid, {n} AS ord, STRING_SPLIT_REGEX(text, p) AS gaps, REGEXP_EXTRACT_ALL(text, p) AS hits, REGEXP_EXTRACT_ALL(text, p, {g}) AS vals "
        f"FROM d, (SELECT '{p.replace(chr(39), chr(39) * 2)}' AS p) WHERE REGEXP_MATCHES(text, p)"
        for n, (_, p, g) in enumerate(KINDS)
    )
    return rf"""
WITH d AS (
  SELECT ROW_NUMBER() OVER () AS rid, doc_id, COALESCE(text, '') AS text, COALESCE(source, CHR(1)) AS owner, COALESCE(source, '') || CHR(1) || COALESCE(lang, CHR(1)) AS repo FROM documents),
k AS ({arms}),
i AS (SELECT *, UNNEST(RANGE(1, LEN(hits) + 1)) AS i FROM k),
h AS (
  SELECT rid, ord, hits[i] AS hit, vals[i] AS val,
    (LIST_SUM(LIST_TRANSFORM(gaps[1:i], lambda x: LENGTH(x))) + COALESCE(LIST_SUM(LIST_TRANSFORM(hits[1:i - 1], lambda x: LENGTH(x))), 0))::BIGINT AS s FROM i),
r AS (
  SELECT *, s + LENGTH(hit) AS e,
    REGEXP_MATCHES(val, '[A-Za-z]') AND REGEXP_MATCHES(val, '[0-9]') AND LEN(LIST_DISTINCT(STRING_SPLIT(val, ''))) >= {LEAST_VARIETY} AS random FROM h),
f AS (SELECT r.*, owner, repo FROM r JOIN d USING (rid) WHERE NOT (ord = 0 AND LENGTH(val) < {LEAST_VALUE}) AND NOT (ord = 3 AND NOT random)),
o AS (SELECT val, COUNT(DISTINCT owner) AS n_owners, COUNT(DISTINCT owner || CHR(2) || repo) AS n_repos FROM f GROUP BY val),
g AS (
  SELECT f.*, n_repos, random AND n_owners = 1 AND n_repos <= {MOST_REPOS} AS live,
    (ord = 0)::INT + (ord = 1)::INT + (ord = 2)::INT AS base,
    ['assign', 'access', 'hex', 'owner'][ord + 1] || ':' || s || ':' || e AS txt FROM f JOIN o USING (val)),
a AS (
  SELECT * FROM g WHERE base = 1 OR (live AND NOT EXISTS (SELECT 1 FROM g b WHERE b.rid = g.rid AND b.base = 1 AND b.s < g.e AND b.e > g.s))),
j AS (
  SELECT rid, COUNT(*) FILTER (ord = 0) AS n0, COUNT(*) FILTER (ord = 1) AS n1, COUNT(*) FILTER (ord = 2) AS n2,
    STRING_AGG(txt, ',' ORDER BY s, ord) FILTER (base = 1) AS base_txt, STRING_AGG(txt, ',' ORDER BY s, ord) AS all_txt,
    COUNT(*) FILTER (live) AS n_live, COUNT(*) FILTER (NOT live) AS n_copied, MAX(n_repos) AS top FROM a GROUP BY rid)
SELECT doc_id, COALESCE(n0, 0)::BIGINT AS n_assign, COALESCE(n1, 0)::BIGINT AS n_access, COALESCE(n2, 0)::BIGINT AS n_hex,
  SHA256(COALESCE(base_txt, '')) AS base_sha256, COALESCE(all_txt, '') AS spans, COALESCE(n_live, 0)::BIGINT AS n_live, COALESCE(n_copied, 0)::BIGINT AS n_copied, COALESCE(top, 0)::BIGINT AS n_repos
FROM d LEFT JOIN j USING (rid)
"""


SQL = _sql()
