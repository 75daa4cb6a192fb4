"""Best-fit packing by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens; only longer ones are cut. Packing looks at
lengths alone: the histogram of piece lengths has at most ``capacity`` entries, whatever the corpus,
so the plan is made on the driver. Each bin starts from the longest length left; a bitset subset-sum
over the lengths left (each as often as it is left) finds the fullest feasible filling, and the
combination is taken out as often as the counts allow. A piece finds its place from its rank within
its length: local rank in its task plus a prefix sum over the tasks.

Defined results: a null or empty text is one piece with the end id; repeated rows are documents of
their own; a very long text is cut into as many pieces as it fills; pieces of equal length take the places of that length
in the order of their ranks; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .wordcoder import coder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths that fill ``room`` as far as the available ones can: bitset subset-sum, longest first."""
    reach, steps, whole = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies at a time reach every number of copies
            take = min(chunk, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & whole
            left, chunk = left - take, chunk * 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen += [length] * take
            at -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, how many such bins), until no piece is left."""
    left, bins = {k: v for k, v in histogram.items() if v}, []
    while left:
        first = max(left)
        left[first] -= 1
        combo = [first, *fullest(left, capacity - first)]
        left[first] += 1
        uses = {x: combo.count(x) for x in combo}
        times = min(left[x] // n for x, n in uses.items())
        bins.append((tuple(sorted(combo, reverse=True)), times))
        for x, n in uses.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return bins


def slots(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: from which rank on, which first sequence, how many copies in a bin, their first offset."""
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for combo, times in bins:
        offset = 0
        for length in sorted(set(combo), reverse=True):
            n = combo.count(length)
            table.setdefault(length, []).append((ranks.get(length, 0), sequence, n, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in table.items()}


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every document, each with its task and its rank among that task's pieces of its length."""
    common.arrow_rows(docs.sparkSession)
    tail = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "task", "rank"))])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, ranks, wide = coder(tokenizer), TaskContext.get().partitionId(), {}, 4 * capacity
        for b in common.slices(batches, 1, 2 << 20):
            rows, (ids, ends) = [], words.encode_column(b.column(1))
            for doc, since, to in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                x = ids[since:to].tobytes() + tail
                for k, at in enumerate(range(0, len(x), wide)):
                    part = x[at : at + wide]
                    n = len(part) // 4
                    rank = ranks.get(n, 0)
                    ranks[n] = rank + 1
                    rows.append((doc, k, at // 4, n, zlib.crc32(part), task, rank))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.max("rank").alias("top"))
    # At most ``capacity`` rows come to the driver.
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum(F.col("top") + 1).alias("n")).collect()}
    full_bins = histogram.pop(capacity, 0)
    bins = plan(histogram, capacity)
    first_full = sum(times for _, times in bins)
    held = spark.sparkContext.broadcast(slots(bins) | ({capacity: tuple(np.array([x]) for x in (0, first_full, 1, 0))} if full_bins else {}))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum(F.col("top") + 1).over(before), F.lit(0))).select("length", "task", "base")
    ranked = pieces.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = length == x
                since, first, copies, offset = held.value[int(x)]
                k = np.searchsorted(since, rank[at], side="right") - 1
                own = rank[at] - since[k]
                seq[at], off[at] = first[k] + own // copies[k], offset[k] + own % copies[k] * x
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*names[:5], "sequence_id", "offset"])

    return ranked.select(names).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut, write the pieces' spans to the shared folder, and place them."""
    return pack(common.materialise(cut(docs, tokenizer, end_id, capacity, id_col, text_col), "pieces"), capacity)
