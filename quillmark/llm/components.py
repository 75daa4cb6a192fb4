"""Connected components of an edge table, by large-star and small-star steps.

Every step rewrites each edge towards smaller ids; the result is a star per component. Tasks first
replace their own edges by a spanning star forest, so dense groups shrink before any shuffle. A hub's
edges are never gathered in one place: steps are joins and aggregations with map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the components of one task's edges; edges come in bounded chunks."""
    for chunk in _chunks(batches, 1 << 20):
        a, b = chunk
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        far = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["a", "b"])


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, n = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= rows:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest id reachable; nodes without edges are absent. ``edges``: a, b long."""
    now = common.materialise(edges.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long"), "stars", small=True)
    before = None
    while True:
        # a > b from here on: b is a's smaller neighbour.
        down = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        pairs = down.join(least, "a")
        linked = pairs.select("a", F.col("m").alias("b")).union(pairs.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        linked = common.materialise(linked.distinct(), "stars", small=True)
        # Point every node at its parent's parent.
        up = linked.groupBy("a").agg(F.min("b").alias("p"))
        jump = linked.join(up.select(F.col("a").alias("b"), F.col("p").alias("q")), "b", "left")
        new = common.materialise(jump.select("a", F.coalesce("q", "b").alias("b")).union(jump.filter("q is not null").select(F.col("b").alias("a"), F.col("q").alias("b"))).distinct(), "stars", small=True)
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        common.drop_scratch(now, linked)
        now = new
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before = state
