"""Registered queries of the ten operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, lm_score, neighbours, quality, runs, set_join, sharding, simhash, substring, token_count, url_filter
from .common import crc_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score.score_held_out(table(spark, sf_dir, "documents"), folds=7, held=2)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole")


def encoded(docs: DataFrame) -> DataFrame:
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(quality.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return quality.score(docs, model, ["doc_id"]).select(
        "row.doc_id", (crc_fold("row.doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_substrings(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      decontaminate.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.listed_urls(pages, table(spark, sf_dir, "labels")))


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def echoed(docs: DataFrame) -> DataFrame:
    """doc_id and text; the text of one document in ten repeats itself from some word on (a row without doc_id stays as it is)."""
    some = docs.select("doc_id", "text", F.expr("crc32(cast(cast(doc_id AS string) AS binary))").alias("h")) \
        .select("doc_id", "text", F.when(F.col("h") % 10 == 0, F.expr("h div 10")).alias("g")) \
        .withColumn("w", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))) \
        .withColumn("n", F.expr("nullif(size(w), 0)")) \
        .withColumn("a", F.expr("int(g % n)")) \
        .withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    again = F.expr("array_join(concat(slice(w, 1, a), slice(flatten(array_repeat(slice(w, a + 1, p), int((n - a + p - 1) div p))), 1, n - a)), ' ')")
    return some.select("doc_id", F.when(F.col("n").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def run_digests(docs: DataFrame) -> DataFrame:
    found = runs.find_runs(docs, carry=["doc_id"])
    longer = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", F.lit(None).cast(runs.RUN), longer).alias("best"),
                         F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(echoed(table(spark, sf_dir, "documents")))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query
def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join_alike(table(spark, sf_dir, "documents"))


UPPER, LOW = url_filter.UPPER, url_filter.LOW

ORACLES["op7_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, ws[s:s + 19] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, min({'d': doc_id, 's': s}) OVER (PARTITION BY k) AS m FROM win)
         WHERE m.d <> doc_id OR m.s <> s),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM late),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(e.word, ' ' ORDER BY e.i) AS t
         FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLES["op8_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS id, ws, least(10, len(ws)) AS n
      FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark)
      WHERE len(ws) > 0),
bw AS (SELECT DISTINCT id, ws[s:s + n - 1] AS k FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM b)),
dw AS (SELECT doc_id, s, n, ws[s:s + n - 1] AS k
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM b) WHERE len(ws) >= n)),
h AS (SELECT doc_id, s, n, id FROM dw JOIN bw USING (k)),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

_FITS = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'"
    for i, (h, p, _) in sorted(enumerate(url_filter.RULES), key=lambda r: -len(r[1][0] + r[1][1])))
_RULE = _FITS.format(*[h + p for h, p, _ in url_filter.RULES])
_VERDICT = _FITS.format(*[v for _, _, v in url_filter.RULES])

ORACLES["op9_url_filter"] = rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOW}') AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/+)$', '') AS canonical_url,
             try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) AS number FROM u),
l AS (SELECT DISTINCT canonical_url FROM c
      WHERE (contains(host, 'spam') OR number IN (SELECT doc_id FROM labels WHERE toxic = 1)) AND canonical_url <> '')
SELECT page_id, host, path, CASE {_RULE} END AS rule,
       coalesce(CASE {_VERDICT} END, CASE WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       c.canonical_url, l.canonical_url IS NOT NULL AS listed
FROM c LEFT JOIN l ON l.canonical_url = c.canonical_url
"""

ORACLES["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOW}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS t FROM d),
k AS (SELECT lang, t FROM w GROUP BY lang, t HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, t, count(*) AS n FROM w JOIN k USING (lang, t) GROUP BY lang, source, t),
gm AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) + coalesce(max(v.v), 0) AS m
       FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v ON v.lang = g.lang GROUP BY g.lang, g.source),
lm AS (SELECT lang, sum(c.n) + max(v.v) AS m FROM c JOIN v USING (lang) GROUP BY lang),
p AS (SELECT gm.lang, gm.source, k.t, coalesce(c.n, 0) AS n, CAST(1 + 1000000000 * (coalesce(c.n, 0) + 1) // gm.m AS BIGINT) AS p
      FROM gm JOIN k ON k.lang = gm.lang LEFT JOIN c ON c.lang = gm.lang AND c.source = gm.source AND c.t = k.t),
q AS (SELECT c.lang, c.t, CAST(1 + 1000000000 * (sum(c.n) + 1) // max(lm.m) AS BIGINT) AS q FROM c JOIN lm USING (lang) GROUP BY c.lang, c.t),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.t, CAST((p.p - q.q) * (p.p - q.q) // q.q AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.t = p.t WHERE n > 0 AND p.p > q.q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""
