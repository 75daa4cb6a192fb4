"""What the two vector searches share: clean vectors, local top-k with ties, and the final merge.

Which vectors take part: those with an id, of the table's most frequent length (of several, the
longest), without null, NaN or infinite components. Rows of one id count as one, the smallest vector.
An empty table gives no rows; only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scores closer than this to the k-th best are computed again, the same way for every row.
NEAR = 1e-9


def clean(table: DataFrame, id_col: str, vec_col: str, ok: Column | None = None) -> tuple[DataFrame, int]:
    """(id long, v array<double>, or array<float> where the table has that) of the vectors that take part, and their length (0 if there are none)."""
    kind = table.select(F.col(f"`{vec_col}`")).schema[0].dataType
    v = F.col(f"`{vec_col}`").cast("array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    if ok is not None:
        rows = rows.filter(ok)
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    # One row per vector length comes back: lengths, not vectors.
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not found:
        return rows.limit(0), 0
    return rows.filter(F.size("v") == found[0].d), found[0].d


def reachable(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be among the k best of any query: of equal vectors, which score equally, the k + 1 with the
    smallest ids (one of them may be the query's own). Spark limits each group before the shuffle."""
    by = Window.partitionBy("v").orderBy("id")
    return rows.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= k + 1).drop("n")


def matrix(column, dims: int) -> np.ndarray:
    """A column of equal-length arrays as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64, copy=False) if len(column) else np.empty((0, dims))


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int, exact=None) -> list[tuple[int, float]]:
    """The k best of one query, ties to the smaller id. ``exact(indices)`` may give the scores to rank by."""
    ok = ids != own
    scores, at = scores[ok], np.flatnonzero(ok)
    if len(at) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= kth - (NEAR if exact else 0)
        scores, at = scores[near], at[near]
    if exact:
        scores = exact(at)
    order = np.lexsort((ids[at], -scores))[:k]
    return list(zip(ids[at[order]].tolist(), scores[order].tolist()))


def merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query from partial results (query_id, vec_id, score), which may repeat."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
