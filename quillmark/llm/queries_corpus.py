"""Driver queries of the filter audit, the secret scan and the conversation trie."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, prefix_trie, secret_scan


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in all 120 orders, by language."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return filter_audit.audit(_table(spark, sf_dir, "documents"), labels, F.col("lang"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text: the fixed patterns, and random strings by characters a token."""
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return prefix_trie.nodes(_table(spark, sf_dir, "conversations"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

QUERIES = {"op11_filter_audit": op11_filter_audit, "op12_secret_scan": op12_secret_scan, "op13_conversation_trie": op13_conversation_trie}
ORACLES = {
    "op11_filter_audit": rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
failed AS (
  SELECT part, doc_id, len({_WORDS}) < 100 AS a, 100 * len(list_distinct({_WORDS})) < 80 * len({_WORDS}) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM docs),
labelled AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
mask AS (
  SELECT part, [a, b, c, d, e] AS f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM failed LEFT JOIN labelled USING (doc_id) GROUP BY ALL),
letter AS (SELECT * FROM (VALUES (1, 'A'), (2, 'B'), (3, 'C'), (4, 'D'), (5, 'E')) v(i, l)),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order, [v.i, w.i, x.i, y.i, z.i] AS o FROM letter v, letter w, letter x, letter y, letter z
  WHERE v.i NOT IN (w.i, x.i, y.i, z.i) AND w.i NOT IN (x.i, y.i, z.i) AND x.i NOT IN (y.i, z.i) AND y.i <> z.i),
cell AS (SELECT filter_order, o, step, o[step] AS own FROM orders, (SELECT unnest(range(1, 6)) AS step)),
judged AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[own] AS hit, len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 AS early,
    len(list_filter(f, lambda x: x)) AS fails FROM mask, cell),
per AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (WHERE NOT hit AND NOT early) AS kept, sum(n) FILTER (WHERE hit AND NOT early) AS removed,
    sum(n) FILTER (WHERE hit AND early) AS redundant, sum(n) FILTER (WHERE hit AND fails = 1) AS unique_fails,
    sum(good) FILTER (WHERE hit AND NOT early) AS good_lost, sum(toxic) FILTER (WHERE hit AND NOT early) AS toxic_lost FROM judged GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
  CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM per""",
    "op13_conversation_trie": """
WITH labelled AS (
  SELECT conv_id AS c, turn, length(coalesce(text, '')) AS chars, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, chars, l, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, l) AS pos FROM labelled),
ids AS (SELECT DISTINCT c FROM t),
heads AS (
  SELECT c, c - c % 100 AS b, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS UBIGINT))),
    lambda r, x: list_reduce([xor(r, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CAST(3988292384 AS UBIGINT) * (y & 1)))), CAST(4294967295 AS UBIGINT)) % 6 AS h FROM ids),
given AS (
  SELECT heads.c, pos, l, chars FROM heads JOIN t ON t.c = heads.b AND pos <= h UNION ALL SELECT t.c, pos, l, chars FROM t JOIN heads USING (c) WHERE pos > h),
path AS (
  SELECT c, depth, chars, string_agg(l, '') OVER (PARTITION BY c ORDER BY depth) AS k FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY pos) AS depth FROM given)
  UNION ALL SELECT c, 0, 0, '' FROM ids),
ending AS (SELECT *, max(depth) OVER (PARTITION BY c) AS whole FROM path),
node AS (
  SELECT depth, k, substr(k, 1, greatest(0, 32 * (depth - 1))) AS up, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE depth = whole), '')) AS ends_sha256 FROM ending GROUP BY depth, k),
family AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN (SELECT depth - 1 AS depth, up AS k, count(*) AS kids FROM node WHERE depth > 0 GROUP BY ALL) USING (depth, k)),
below AS (
  SELECT path.k, path.depth, count(*) FILTER (WHERE kids = 0) AS leaves, sum((n - 1) * f.chars) AS saved
  FROM family f JOIN path ON path.c = f.conv_id AND path.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM family f JOIN below b USING (k, depth) LEFT JOIN node p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.k = f.up""",
}
