"""Driver queries of the vector searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosspoly, voronoi


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every vector whose id is divisible by 20."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return voronoi.search(table, F.col("id") % 20 == 0, k=20)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found, by cosine, of every vector whose id is divisible by 50."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return crosspoly.search(table, F.col("id") % 50 == 0, k=5)


_OP3 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

QUERIES = {"op3_topk_search": op3_topk_search, "op10_nearest_neighbours": op10_nearest_neighbours}
ORACLES = {"op3_topk_search": _OP3}
