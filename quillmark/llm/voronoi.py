"""Exact top-k inner products by a Voronoi kNN join.

Largest inner products become nearest neighbours when every data vector x gets one more component,
sqrt(M - |x|^2) with M the largest |x|^2, and every query a zero: then |q - x|^2 = |q|^2 + M - 2 q.x.
Pivots (k-means on a bounded sample) split that space into cells. Each query first meets the data of its own
cell, which gives the distance within which its k nearest lie at most. Summaries per cell - the data's
distances to the pivot, the queries' bounds, and how much farther the queries are from every other pivot than
from their own - then tell which cells a cell's queries need: those that neither the triangle inequality nor the
hyperplane between the two pivots rules out. Neighbouring cells of queries form groups of about ``BLOCK`` queries, data
goes to the groups that need its cell, and each (group, chunk of data) is solved by itself with exact
products. The k best of all remain.

Of equal vectors only the k + 1 smallest ids are candidates, since ties go to the smaller id. The driver
holds pivots, summaries per cell and pair of cells, and the sample: nothing that grows with the data but the
number of groups. Queries with fewer than k candidates get all of them. Where vectors are spread evenly in
many dimensions no bound rules out any cell; then every group meets all data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import vectors as V

#: Sampled rows for the pivots, pivots at most, queries in a group.
SAMPLE, PIVOTS, BLOCK = 2048, 256, 4096
SLACK = 1e-6


def _pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """k-means from evenly spaced sample rows; a few rounds."""
    p = sample[np.linspace(0, len(sample) - 1, min(most, len(sample))).astype(int)]
    p = np.unique(p, axis=0)
    for _ in range(8):
        near = _distances(sample, p).argmin(1)
        p = np.array([sample[near == i].mean(0) if (near == i).any() else p[i] for i in range(len(p))])
    return p


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T), 0))


def _lift(x: np.ndarray, top: float, data: bool) -> np.ndarray:
    extra = np.sqrt(np.maximum(top - (x * x).sum(1), 0)) if data else np.zeros(len(x))
    return np.hstack([x, extra[:, None]])


def _assign(rows: DataFrame, pivots: np.ndarray, top: float, dims: int) -> DataFrame:
    """Adds is_query's and the data's cell and distance: qcell, u, cell, r."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = V.matrix(b.column(1), dims)
            dd, dq = _distances(_lift(x, top, True), pivots), _distances(_lift(x, top, False), pivots)
            c, q = dd.argmin(1), dq.argmin(1)
            at = np.arange(len(x))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(q.astype(np.int32)), pa.array(dq[at, q]), pa.array(c.astype(np.int32)), pa.array(dd[at, c])], names=["id", "v", "is_query", "qcell", "u", "cell", "r"])

    return rows.mapInArrow(near, "id long, v array<double>, is_query boolean, qcell int, u double, cell int, r double")


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors: in doubles where those are exact, else in Python's integers, held to 64 bits."""
    most = (np.abs(q).max(initial=0)) * (np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2**53:
        return q @ x.T
    big = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in x], object).T
    return np.clip(big, -(2**63), 2**63 - 1)


class Units:
    """Who meets whom: each query cell's unit, each data cell's units, and how many chunks and blocks a unit has."""

    def __init__(self, of_query: dict[int, int], of_data: dict[int, list[int]], queries: dict[int, int], rows: dict[int, int], chunk: int):
        n = max(of_query.values(), default=-1) + 1
        asked, held = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for c, u in of_query.items():
            asked[u] += queries[c]
        for c, us in of_data.items():
            held[us] += rows[c]
        self.of_query, self.of_data = of_query, of_data
        self.chunks, self.blocks = np.maximum(1, -(-held // chunk)), np.maximum(1, -(-asked // BLOCK))

    def deal(self, batch: pa.RecordBatch, data: bool) -> pa.RecordBatch | None:
        """(unit, part, block, id, v): a row to every block, or a query to every part, of its units."""
        ids, cell = batch.column("id").to_numpy(), batch.column("cell").to_numpy()
        h = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        take, cols = [], []
        for c in np.unique(cell).tolist():
            i = np.flatnonzero(cell == c)
            for u in self.of_data.get(c, []) if data else [self.of_query[c]]:
                many, few = (self.blocks[u], self.chunks[u]) if data else (self.chunks[u], self.blocks[u])
                one, all_ = np.repeat(h[i] % few, many), np.tile(np.arange(many), len(i))
                take.append(np.repeat(i, many))
                cols.append(np.stack([np.full(len(one), u), *((one, all_) if data else (all_, one))]))
        if not take:
            return None
        at, x = pa.array(np.concatenate(take)), np.concatenate(cols, 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([*(pa.array(r) for r in x), batch.column("id").take(at), batch.column("v").take(at)], names=["unit", "part", "block", "id", "v"])


def needed(gap: np.ndarray, far: dict[int, float], bound: dict[int, float], low: dict[int, float], high: dict[int, float], beyond: np.ndarray) -> dict[int, list[int]]:
    """Per query cell, the other cells whose data its queries may need. ``far``: largest distance of a cell's query to
    its pivot; ``bound``: largest distance of a k-th neighbour so far; ``low``, ``high``: range of the data's distances to
    their pivot; ``beyond[q, c]``: least d(query, pivot c)^2 - d(query, own pivot)^2 over the queries of cell q."""
    out = {}
    for q, u in far.items():
        out[q] = []
        for c in low:
            ring = max(gap[q, c] - u - high[c], low[c] - gap[q, c] - u)
            plane = beyond[q, c] / (2 * gap[q, c]) if gap[q, c] > 0 else 0.0
            if c != q and max(ring, plane) <= bound[q] + SLACK:
                out[q].append(c)
    return out


def grouped(pivots: np.ndarray, queries: dict[int, int]) -> dict[int, int]:
    """Group of each query cell: walk from a cell to the nearest one left, and close a group at ``BLOCK`` queries."""
    left, out, group, size = set(queries), {}, 0, 0
    at = min(left)
    while left:
        at = min(left, key=lambda c: (((pivots[c] - pivots[at]) ** 2).sum(), c))
        left.remove(at)
        if size and size + queries[at] > BLOCK:
            group, size = group + 1, 0
        out[at], size = group, size + queries[at]
    return out


def search(table: DataFrame, query: Column, k: int, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (long): the k largest inner products of floor(scale * x) vectors.

    ``query`` is a condition on the column ``id`` that names the queries.
    """
    spark = table.sparkSession
    common.arrow_rows(spark, 4096)
    schema = "query_id long, vec_id long, score long"
    rows, dims = V.clean(table, id_col, vec_col)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"), query.alias("is_query"))
    rows = common.materialise(rows, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, top = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").collect()])
    pivots = _pivots(_lift(sample, top, True), int(min(PIVOTS, max(8, n**0.5))))
    rows = common.materialise(_assign(rows, pivots, top, dims), "assigned")
    queries = rows.filter("is_query").select("id", "v", F.col("qcell").alias("cell"), "u")
    data = common.materialise(V.reachable(rows.select("id", "v", "cell", "r"), k), "data")
    sizes = {r.cell: r for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}
    asked = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    held = {c: r.n for c, r in sizes.items()}
    chunk = int(min(max(n / 16, 1024), 65536))

    def solve(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if a.num_rows and b.num_rows:
            qid, q = a.column("id").to_numpy(), V.matrix(a.column("v"), dims)
            ids, x = b.column("id").to_numpy(), V.matrix(b.column("v"), dims)
            for i in range(0, len(q), 256):
                s = _products(q[i : i + 256], x)
                for own, row in zip(qid[i : i + 256].tolist(), s):
                    out += [(own, v, int(p)) for v, p in V.best(row, ids, own, k)]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.int64())})

    def meet(units: Units) -> DataFrame:
        plan = spark.sparkContext.broadcast(units)

        def dealt(side: DataFrame, is_data: bool) -> DataFrame:
            def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows and (out := plan.value.deal(b, is_data)) is not None:
                        yield out

            return side.select("id", "v", "cell").mapInArrow(work, "unit int, part int, block int, id long, v array<double>")

        keys = ["unit", "part", "block"]
        return dealt(queries, False).groupBy(keys).cogroup(dealt(data, True).groupBy(keys)).applyInArrow(solve, schema)

    # Each query with its own cell, if that has data.
    own = {c: i for i, c in enumerate(sorted(asked))}
    first = common.materialise(V.merge(meet(Units(own, {c: [u] for c, u in own.items() if c in held}, asked, held, chunk)), k), "first")
    kth = first.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    bounded = queries.join(kth, "id", "left").withColumn("bound", F.when(F.col("score").isNotNull(), F.sqrt(F.greatest(norm + F.lit(top) - 2 * F.col("score"), F.lit(0.0)))).otherwise(float("inf")))
    cells = bounded.groupBy("cell").agg(F.max("u").alias("far"), F.max("bound").alias("bound")).collect()

    def beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(1).to_numpy()
            d = _distances(_lift(V.matrix(b.column(0), dims), top, False), pivots) ** 2
            d -= d[np.arange(len(d)), cell][:, None]
            for c in np.unique(cell):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pivots), c, np.int32)), pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(d[cell == c].min(0))], names=["cell", "other", "least"])

    least = np.zeros((len(pivots), len(pivots)))
    for r in queries.select("v", "cell").mapInArrow(beyond, "cell int, other int, least double").groupBy("cell", "other").agg(F.min("least").alias("least")).collect():
        least[r.cell, r.other] = r.least
    low, high = ({c: r[x] for c, r in sizes.items()} for x in ("low", "high"))
    need = needed(_distances(pivots, pivots), {r.cell: r.far for r in cells}, {r.cell: r.bound for r in cells}, low, high, least)
    group = grouped(pivots, asked)
    to: dict[int, set[int]] = {}
    for q, cs in need.items():
        for c in cs:
            to.setdefault(c, set()).add(group[q])
    second = meet(Units(group, {c: sorted(g) for c, g in to.items()}, asked, held, chunk))
    return V.merge(first.select("query_id", "vec_id", "score").unionByName(second), k)
