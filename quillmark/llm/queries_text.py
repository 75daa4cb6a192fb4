"""Driver queries of the operators on texts and urls."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard, line_runs, packing, substring, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written as flat files in ascending doc_id order, and read back."""
    out = common.scratch(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    common.expire(spark, out)
    return token_files.read(spark, out)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of at most 2048 tokens as minimum bin slack finds."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of 0.85 or more of their 4-word shingles."""
    return jaccard.classes(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops every line whose key at least 10 documents hold."""
    out = line_runs.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every word under a 35-word window that starts anywhere else too."""
    out = substring.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=35)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_OP9 = r"""
WITH cut AS (SELECT doc_id, text, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM cut),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN hot.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM keyed LEFT JOIN hot ON keyed.k = hot.k GROUP BY doc_id, r
"""

QUERIES = {"op2_token_files": op2_token_files, "op4_substring_dedup": op4_substring_dedup, "op5_best_fit_packing": op5_best_fit_packing, "op6_ngram_jaccard": op6_ngram_jaccard, "op9_line_dedup": op9_line_dedup}
_OP4 = r"""
WITH split AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS w FROM split, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS i)),
rep AS (SELECT md5(w) AS m FROM win GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT r, i FROM win WHERE md5(w) IN (SELECT m FROM rep)),
gone AS (SELECT DISTINCT r, j FROM hit, LATERAL (SELECT unnest(range(i, i + 35)) AS j)),
word AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS j FROM split),
kept AS (
  SELECT word.r, count(gone.j) AS n_removed, coalesce(string_agg(CASE WHEN gone.j IS NULL THEN w END, ' ' ORDER BY word.j), '') AS t
  FROM word LEFT JOIN gone ON word.r = gone.r AND word.j = gone.j GROUP BY word.r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (r)
"""

_OP6 = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 3), ' ')) AS s
  FROM split, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1)) + 1)) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS r, doc_id AS d FROM documents UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.d = link.a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(d) FROM reach WHERE r = documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id)
"""

ORACLES = {"op6_ngram_jaccard": _OP6, "op4_substring_dedup": _OP4, "op9_line_dedup": _OP9}
