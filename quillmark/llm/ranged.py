"""Scans of a table in one total order, without gathering a key's rows in one task.

Rows are dealt by range of fixed-size keys and sorted inside each partition; a worker sees its partition in
order and knows nothing of the others. What goes on across a boundary (a run of equal keys that began in an
earlier partition) is told by one summary a partition, an ``edge``; ``carries()`` joins the edges, as many as
there are partitions, in order on the driver. So a key that holds a third of all rows lies in a third of the
partitions, if the range keys end with something that tells its rows apart.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: (key of the first run, key of the last run, whether they are one run, value of the last run)
Edge = tuple[object, object, bool, object]


def scan(ordered: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch | Edge]], schema: str, tag: str) -> tuple[DataFrame, list[tuple[int, Edge]]]:
    """(rows that ``work`` makes of the partitions of ``ordered``, with ``pid``; the edges by pid). ``work`` yields batches
    of the columns of ``schema`` and at the end its edge. The rows are written, so every later reader sees the same partitions."""
    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, kinds = TaskContext.get().partitionId(), None
        for out in work(batches):
            if isinstance(out, pa.RecordBatch):
                kinds = out.schema
                n = out.num_rows
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(n, pid, np.int32)), pa.nulls(n, pa.binary())], names=[*names, "pid", "edge"])
            else:
                nothing = [pa.nulls(1, f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array([pid], pa.int32()), pa.array([pickle.dumps(out)], pa.binary())], names=[*names, "pid", "edge"])

    held = common.materialise(ordered.mapInArrow(each, f"{schema}, pid int, edge binary"), tag)
    edges = [(r.pid, pickle.loads(r.edge)) for r in held.filter("edge is not null").select("pid", "edge").collect()]
    rows = held.filter("edge is null").drop("edge")
    rows._scratch = held._scratch
    return rows, sorted(edges, key=lambda e: e[0])


def carries(edges: list[tuple[int, Edge]], combine: Callable) -> dict[int, object]:
    """By pid, what the run that a partition begins with has gathered before it; nothing where it begins a new one."""
    out, key, value, begun = {}, None, None, False
    for pid, (first, last, one, own) in edges:
        goes_on = begun and key == first
        if goes_on:
            out[pid] = value
        value = combine(value, own) if goes_on and one else own
        key, begun = last, True
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A number that tells equal rows apart in a range key; the same whenever a task runs again."""
    return df.withColumn(name, F.monotonically_increasing_id())


def starts(same: np.ndarray) -> np.ndarray:
    """For each row, the index of its run's first row; ``same[i]``: row i continues the run of row i - 1."""
    at = np.arange(len(same))
    return np.maximum.accumulate(np.where(same, 0, at))
