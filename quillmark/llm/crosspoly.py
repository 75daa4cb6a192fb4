"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by fast pseudo-random rotations (three rounds of random signs and a Hadamard
transform); the signed axis nearest to the result is a hash. Two rotations make a table's code, one of
(2 * width) ** 2 buckets, and every vector has one code in each table. A query probes, in each table, the
codes whose two axes lie nearest to it in sum, and every row found there is ranked by its exact cosine on
the original vectors.

How many codes are probed follows from the table: of ``SAMPLE`` vectors the true neighbours are found by one pass over
all rows, and ``probes_for()`` takes the least number that would find the share ``TARGET`` of them. Only the sample
and its neighbours come to the driver, whatever the table's size, and a given ``probes`` skips the measurement.

Codes in order are packed into units of at most ``UNIT`` rows; a bucket of more is a unit of its own, dealt by
id into parts that a query visits all. So tasks stay bounded, a query goes once to each unit that it probes,
and nothing is dropped. Of equal vectors only the k + 1 smallest ids are indexed, since ties go to the smaller
id. Queries whose probes hold fewer than k other rows, though the table has more, then visit every unit of
one table; for them the result is exact.

Zero vectors take no part, besides what vectors.clean() says. Scores that tie within rounding are computed once more in
one fixed order of summation, so equal vectors have equal scores.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from . import vectors as V

TABLES, SEED = 8, 7
#: Vectors whose neighbours are measured, and the share of these that the probes must find.
SAMPLE, TARGET = 512, 0.95
#: Rows of a unit.
UNIT = 4096
LOG = logging.getLogger(__name__)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def turn(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, padded with zeros to a power of two; scaled first, so that squares stay finite."""
    x = x / np.abs(x).max(1, keepdims=True)
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    wide = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, wide - x.shape[1])))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one query and rows, each row summed in the same order."""
    a, b = np.abs(q).max(), np.abs(x).max(1)
    q, x = (q, x) if 1e-100 < a < 1e100 and ((b > 1e-100) & (b < 1e100)).all() else (q / a, x / b[:, None])
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


class Codes:
    """The codes of vectors in every table, and the units that hold them."""

    def __init__(self, dims: int, tables: int):
        self.wide = 1 << max(1, (dims - 1).bit_length())
        self.tables, self.axes = tables, 2 * self.wide
        self.signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, 2, 3, self.wide))

    def _axes(self, x: np.ndarray, t: int) -> list[np.ndarray]:
        return [np.concatenate([y, -y], 1) for y in (turn(x, s) for s in self.signs[t])]

    def of(self, x: np.ndarray, t: int) -> np.ndarray:
        a, b = (y.argmax(1) for y in self._axes(x, t))
        return a * self.axes + b

    def place(self, x: np.ndarray, t: int, codes: np.ndarray) -> np.ndarray:
        """For each row and its own code, how many codes are nearer to the row."""
        out = np.empty(len(x), np.int64)
        for r, (a, b, c) in enumerate(zip(*self._axes(x, t), codes.tolist())):
            b_sorted = np.sort(b)
            out[r] = (self.axes - np.searchsorted(b_sorted, a[c // self.axes] + b[c % self.axes] - a, side="right")).sum()
        return out

    def probed(self, x: np.ndarray, t: int, probes: int) -> np.ndarray:
        """The ``probes`` nearest codes of each row."""
        a, b = self._axes(x, t)
        # Pairs of the nearest axes hold the nearest codes: the m-th of either is in no code before the m-th.
        m = min(probes, self.axes)
        i, j = (np.argsort(-y, 1)[:, :m] for y in (a, b))
        rows = np.arange(len(x))[:, None]
        score = (a[rows, i][:, :, None] + b[rows, j][:, None]).reshape(len(x), -1)
        best = np.argpartition(-score, probes - 1, 1)[:, :probes] if probes < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(x), 1))
        return i[rows, best // m] * self.axes + j[rows, best % m]

    def units(self, counts: list) -> tuple[np.ndarray, list[np.ndarray]]:
        """(unit of each table's code, parts of each table's units) from the numbers of rows (tab, code, count)."""
        unit, parts = np.zeros((self.tables, self.axes**2), np.int32), []
        for t in range(self.tables):
            own = np.zeros(self.axes**2, np.int64)
            for r in counts:
                if r.tab == t:
                    own[r.code] = r.n
            k, size, rows = 0, 0, []
            for c, n in enumerate(own.tolist()):
                if size and size + n > UNIT:
                    rows.append(size)
                    k, size = k + 1, 0
                unit[t, c], size = k, size + n
            parts.append(-(-np.array([*rows, max(size, 1)]) // UNIT))
        return unit, parts


def neighbours(data: DataFrame, sample: list, dims: int, k: int) -> list:
    """(query: place in the sample, codes) of the k true neighbours of each sampled row (id, v), by one pass over ``data``
    (id, v, codes); every task sends on its best k of each."""
    own_ids, q = np.array([r.id for r in sample]), unit(np.array([r.v for r in sample], np.float64).reshape(-1, dims))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in sample]
        for b in batches:
            ids, codes = b.column(0).to_numpy(), b.column(2)
            scores = q @ unit(V.matrix(b.column(1), dims)).T
            for j, s in enumerate(scores):
                near = np.argpartition(-s, min(k, len(s) - 1))[: k + 1]
                more = [(-float(s[i]), int(ids[i]), codes[int(i)].as_py()) for i in near if ids[i] != own_ids[j]] if not len(held[j]) == k or s[near].max() >= -held[j][-1][0] else []
                if more:
                    held[j] = sorted(held[j] + more)[:k]
        out = [(j, -x[0], x[1], x[2]) for j, own in enumerate(held) for x in own]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int32()))], names=["q", "score", "id", "codes"])

    found = data.mapInArrow(work, "q int, score double, id long, codes array<int>")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("q", "codes").collect()


def probes_for(codes: Codes, sample: list, true: list, dims: int, target: float) -> int:
    """The least number of probes with which the tables together find the share ``target`` of the sample's neighbours."""
    if not true:
        return 1
    x = unit(np.array([sample[r.q].v for r in true], np.float64).reshape(-1, dims))
    own = np.array([r.codes for r in true])
    need = np.min([codes.place(x, t, own[:, t]) for t in range(codes.tables)], 0)
    return int(np.sort(need)[max(0, int(np.ceil(target * len(need))) - 1)]) + 1


def search(table: DataFrame, query: Column, k: int = 5, tables: int = TABLES, probes: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by cosine; ``query`` is a condition on ``id``.

    Every query has k rows, or all others where the table has fewer. ``probes``: codes that a query visits in each
    table; by default as many as a sample of the table needs for a recall of ``target``.
    """
    spark = table.sparkSession
    common.arrow_rows(spark, 4096)
    nonzero = F.exists("v", lambda x: x != 0)
    rows, dims = V.clean(table, id_col, vec_col, nonzero)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = common.materialise(rows.withColumn("is_query", query), "vectors")
    kind = dict(rows.dtypes)["v"]
    n = rows.count()
    codes = Codes(dims, tables)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(V.matrix(b.column(1), dims))
            each = np.stack([codes.of(x, t) for t in range(tables)], 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.FixedSizeListArray.from_arrays(pa.array(each.ravel()), tables).cast(pa.list_(pa.int32()))], names=["id", "v", "codes"])

    data = common.materialise(V.reachable(rows.select("id", "v"), k).mapInArrow(hashed, f"id long, v {kind}, codes array<int>"), "hashed")
    if probes is None:
        sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").collect()
        probes = probes_for(codes, sample, neighbours(data, sample, dims, k), dims, target)
        LOG.info("%d probes of %d codes a table for a recall of %s", probes, codes.axes**2, target)
    # At most tables * (2 * width) ** 2 counts come to the driver, whatever the table's size.
    counts = data.select(F.posexplode("codes").alias("tab", "code")).groupBy("tab", "code").agg(F.count(F.lit(1)).alias("n")).collect()
    held = spark.sparkContext.broadcast(codes.units(counts))
    dealt = f"tab int, unit int, part int, id long, v {kind}, code binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_of, parts = held.value
        for b in batches:
            h = (b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            each = b.column(2).flatten().to_numpy().reshape(-1, tables)
            for t in range(tables):
                u = unit_of[t][each[:, t]]
                code = each[:, t].astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(u), t, np.int32)),
                        pa.array(u),
                        pa.array((h % parts[t][u].astype(np.uint64)).astype(np.int32)),
                        b.column(0),
                        b.column(1),
                        pa.array([code[i : i + 4] for i in range(0, len(code), 4)], pa.binary()),
                    ],
                    names=["tab", "unit", "part", "id", "v", "code"],
                )

    def ask(every: bool):
        """Queries to the parts of the units that they probe, with the codes; or of table 0 to all of them, without."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unit_of, parts = held.value
            for whole in batches:
                for s in range(0, whole.num_rows, 256):
                    b = whole.slice(s, 256)
                    x = unit(V.matrix(b.column(1), dims))
                    for t in range(1 if every else tables):
                        at, units, sent = [], [], []
                        if every:
                            at, units = np.repeat(np.arange(len(x)), len(parts[t])).tolist(), list(range(len(parts[t]))) * len(x)
                            sent = [b""] * len(at)
                        else:
                            for i, own in enumerate(codes.probed(x, t, probes)):
                                own = np.sort(own)  # units ascend with codes
                                u = unit_of[t][own]
                                cut = np.flatnonzero(np.diff(u, prepend=-1))
                                at += [i] * len(cut)
                                units += u[cut].tolist()
                                sent += [o.astype("<i4").tobytes() for o in np.split(own, cut[1:])]
                        many = parts[t][np.array(units, np.int64)]
                        again = pa.array(np.repeat(np.arange(len(at)), many))
                        at = pa.array(np.repeat(np.array(at, np.int64), many))
                        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(np.repeat(np.array(units, np.int32), many)), pa.array(part.astype(np.int32)), b.column(0).take(at), b.column(1).take(at), pa.array(sent, pa.binary()).take(again)], names=["tab", "unit", "part", "id", "v", "code"])

        return work

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if a.num_rows and b.num_rows:
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), "<i4")
            order = np.argsort(code, kind="stable")
            code, ids, x = code[order], b.column("id").to_numpy()[order], V.matrix(b.column("v"), dims)[order]
            ux = unit(x)
            qid, q = a.column("id").to_numpy(), V.matrix(a.column("v"), dims)
            uq = unit(q)
            for j, own in enumerate(a.column("code").to_pylist()):
                if own:
                    want = np.frombuffer(own, "<i4")
                    first, last = np.searchsorted(code, want), np.searchsorted(code, want, side="right")
                    size = last - first
                    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
                else:
                    at = np.arange(len(code))
                if len(at):
                    out += [(int(qid[j]), v, p) for v, p in V.best(ux[at] @ uq[j], ids[at], int(qid[j]), k, lambda near: cosines(q[j], x[at[near]]))]  # noqa: B023
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    keys = ["tab", "unit", "part"]

    def met(asked: DataFrame, every: bool) -> DataFrame:
        found = asked.mapInArrow(ask(every), dealt).groupBy(keys).cogroup(data.mapInArrow(place, dealt).filter("tab = 0" if every else "true").groupBy(keys))
        return V.merge(found.applyInArrow(rank, "query_id long, vec_id long, score double"), k)

    asked = rows.filter("is_query").select("id", "v")
    found = common.materialise(met(asked, False), "found")
    enough = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") >= min(k, n - 1))
    short = common.materialise(asked.join(enough, "id", "left_anti"), "short", small=True)
    if short.isEmpty():
        return found
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(met(short, True))
