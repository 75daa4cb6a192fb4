"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import crosspoly, voronoi

SCHEMA = "vec_id long, embedding array<float>, unit int, score string"


def vectors(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dims))
    x = np.where(rng.random((n, 1)) < 0.5, centres[rng.integers(0, 4, n)] + 0.05 * rng.normal(size=(n, dims)), rng.normal(size=(n, dims)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n - copies :] = x[0]
    return x.astype(np.float32)


def rows(x):
    return [(i, [float(v) for v in r], 1, "x") for i, r in enumerate(x)]


def brute_inner(x, every, k):
    y = [[math.floor(64 * float(v)) for v in r] for r in x]
    out = []
    for q in range(0, len(y), every):
        s = sorted((-sum(a * b for a, b in zip(y[q], y[i])), i) for i in range(len(y)) if i != q)[:k]
        out += [(q, r, i, -p) for r, (p, i) in enumerate(s, 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "k", "copies"), [(400, 8, 20, 150), (300, 33, 5, 0), (4, 3, 20, 2)])
def test_voronoi_is_exact(spark, n, dims, k, copies):
    x = vectors(n, dims, n, copies)
    got = voronoi.search(spark.createDataFrame(rows(x), SCHEMA), F.col("id") % 10 == 0, k)
    assert sorted(map(tuple, got.collect())) == brute_inner(x, 10, k)


def test_voronoi_bounds_rule_out_far_cells(spark, monkeypatch):
    """Tight clusters far apart: most pairs of cells are ruled out, in many small groups, and the result is exact."""
    monkeypatch.setattr(voronoi, "BLOCK", 8)
    rng = np.random.default_rng(5)
    centres = 20 * rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 600)] + 0.2 * rng.normal(size=(600, 6))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    seen, plain = [], voronoi.needed
    monkeypatch.setattr(voronoi, "needed", lambda *a: seen.append((plain(*a), len(a[3]))) or seen[-1][0])
    got = voronoi.search(spark.createDataFrame(rows(x), SCHEMA), F.col("id") % 10 == 0, 5)
    assert sorted(map(tuple, got.collect())) == brute_inner(x, 10, 5)
    need, cells = seen[0]
    assert sum(map(len, need.values())) < 0.5 * len(need) * (cells - 1)


def test_voronoi_odd_rows(spark):
    x = vectors(30, 4, 1)
    odd = [(None, [1.0] * 4, 0, ""), (100, None, 0, ""), (110, [1.0, None, 0.0, 0.0], 0, ""), (120, [float("nan")] * 4, 0, ""), (130, [float("inf")] * 4, 0, ""), (140, [1.0] * 3, 0, ""), (150, [], 0, "")]
    got = voronoi.search(spark.createDataFrame(rows(x) + odd + rows(x)[:9], SCHEMA), F.col("id") % 10 == 0, 3)
    assert sorted(map(tuple, got.collect())) == brute_inner(x, 10, 3)
    assert voronoi.search(spark.createDataFrame(odd[1:5], SCHEMA), F.col("id") % 10 == 0, 3).count() == 0
    huge = [(0, [3e38, 1.0], 0, ""), (1, [2.0, 1e-3], 0, ""), (2, [1e9, -5.0], 0, "")]
    best = voronoi.search(spark.createDataFrame(huge, SCHEMA), F.col("id") == 1, 2).collect()
    assert [(r.vec_id, r.score) for r in sorted(best, key=lambda r: r["rank"])] == [(0, 2**63 - 1), (2, 128 * 64 * 10**9)]


def brute_cosine(x, every, k):
    y = x.astype(np.float64)
    out = {}
    for q in range(0, len(y), every):
        s = crosspoly.cosines(y[q], y)
        out[q] = sorted((-s[i], i) for i in range(len(y)) if i != q)[:k]
    return out


def test_cross_polytope_recall_ties_and_scores(spark):
    x = vectors(6000, 64, 3, copies=2000)
    want = brute_cosine(x, 50, 5)
    got = {}
    for r in crosspoly.search(spark.createDataFrame(rows(x), SCHEMA), F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    assert set(got) == set(want)
    hits = 0
    for q, w in want.items():
        own = sorted(got[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        assert [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        hits += len({i for _, i in w} & {i for _, _, i in own})
    assert hits >= 0.9 * 5 * len(want)
    assert [i for _, _, i in sorted(got[5000])] == [0, 4000, 4001, 4002, 4003]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_cross_polytope_recall_on_given_tables(spark, sf, caplog):
    """Every row as a query, with the parameters of the query."""
    caplog.set_level("INFO", "quillmark.llm.crosspoly")
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in crosspoly.search(table, F.lit(True)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i, s in enumerate(x @ x.T):
        s[i] = -2
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    print(sf, "recall", hits / (5 * len(ids)), caplog.messages)
    assert hits >= 0.9 * 5 * len(ids)


def test_measured_probes_are_the_places_of_true_codes():
    """The place of a code is how many codes are probed before it, but for one where sums of two axes round differently."""
    rng = np.random.default_rng(0)
    codes = crosspoly.Codes(8, 2)
    x = crosspoly.unit(rng.normal(size=(20, 8)))
    for t in (0, 1):
        for place in (0, 3, 40):
            last = [next(iter(set(a) - set(b))) for a, b in zip(codes.probed(x, t, place + 1).tolist(), codes.probed(x, t, place).tolist() if place else [[]] * 20)]
            assert np.abs(codes.place(x, t, np.array(last)) - place).max() <= 1


def test_cross_polytope_small_and_odd_tables(spark):
    x = vectors(30, 5, 2)
    odd = [(40, [0.0] * 5, 0, ""), (50, None, 0, ""), (60, [None] * 5, 0, ""), (70, [float("nan")] * 5, 0, "")]
    got = {}
    for r in crosspoly.search(spark.createDataFrame(rows(x) + odd, SCHEMA), F.col("id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_cosine(x, 10, 5)
    assert {q: [(i, -s) for s, i in w] for q, w in want.items()} == {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()}
    assert crosspoly.search(spark.createDataFrame(odd, SCHEMA), F.col("id") % 10 == 0).count() == 0
    few = crosspoly.search(spark.createDataFrame(rows(x)[:3], SCHEMA), F.col("id") == 0).collect()
    assert len(few) == 2


@pytest.mark.parametrize("n", [60, 241, 1000])
def test_cross_polytope_finds_k_for_every_query(spark, n, monkeypatch):
    """A tight cone and two rows opposite to it: their probes hold almost nothing."""
    monkeypatch.setattr(crosspoly, "UNIT", 16)
    rng = np.random.default_rng(1)
    axis = rng.normal(size=64)
    x = axis + 0.01 * rng.normal(size=(n, 64))
    x[[0, 7]] = -x[[0, 7]]
    x = x.astype(np.float32)
    got = {}
    for r in crosspoly.search(spark.createDataFrame(rows(x), SCHEMA), F.col("id").isin(0, 7, 10)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [r for r, _, _ in sorted(v)] for q, v in got.items()} == {q: [1, 2, 3, 4, 5] for q in (0, 7, 10)}
    want = brute_cosine(x, 1, 5)
    for q in (0, 7):
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in want[q]]
