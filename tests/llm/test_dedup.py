"""Substring dedup and the Jaccard join against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import blocks, jaccard, substring
from quillmark.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, block_id string, bits int"


def texts(seed, n=60, vocabulary=400):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}é"
    passage = [word() for _ in range(40)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            base = WORD.findall(rng.choice(out) or "")
            for _ in range(rng.randrange(4)):
                if base:
                    base[rng.randrange(len(base))] = word().upper()
            out.append(" ".join(base))
        else:
            own = [word() for _ in range(rng.choice([0, 1, 2, 3, 5, 30, 80, 200]))]
            if rng.random() < 0.3:
                own[len(own) // 2 : len(own) // 2] = passage
            out.append(rng.choice([" ", "\n", "\t \x0b"]).join(own))
    return out + [None, "", " \n ", "a\xa0b\x1cc d", "x " * 3000, "x " * 3001]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1) for i, t in enumerate(rows)], SCHEMA)


def brute_removed(rows, width):
    words = [WORD.findall(t or "") for t in rows]
    seen = {}
    for w in words:
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize(("seed", "width"), [(1, 7), (2, 35), (3, 1)])
def test_substring_dedup_is_exact(spark, seed, width):
    rows = texts(seed)
    out = substring.dedup(frame(spark, rows).repartition(5), width)
    assert out.columns == ["doc_id", "text", "block_id", "bits", "n_words", "removed", "kept"]
    got = {r.doc_id: (r.n_words, sum(x.end - x.begin for x in r.removed), r.kept) for r in out.collect()}
    assert [got[i] for i in range(len(rows))] == brute_removed(rows, width)
    for r in out.collect():
        assert all(a.end < b.begin for a, b in zip(r.removed, r.removed[1:]))


def test_two_levels_of_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", 4)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 1 << 14)
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 1 << 10)
    monkeypatch.setattr(blocks.pack_blocks, "__defaults__", (1 << 10,))
    rows = texts(5, 150)
    docs = frame(spark, rows).repartition(5)
    assert blocks.deal_of(docs).ranges > 4
    got = {r.doc_id: (r.n_words, sum(x.end - x.begin for x in r.removed), r.kept) for r in substring.dedup(docs, 9).collect()}
    assert [got[i] for i in range(len(rows))] == brute_removed(rows, 9)
    rows = texts(6, 100, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(frame(spark, rows).repartition(5), 4, 85, 100).collect()}
    assert [got[i] for i in range(len(rows))] == brute_classes(rows, 4, 85, 100)


def test_substring_dedup_of_an_empty_table(spark):
    assert substring.dedup(frame(spark, []).limit(0), 35).count() == 0


def brute_classes(rows, n, num, den):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("seed", "n", "num", "den", "tile"), [(1, 4, 85, 100, 1024), (2, 5, 80, 100, 3), (3, 2, 60, 100, 2)])
def test_jaccard_classes_are_exact(spark, monkeypatch, seed, n, num, den, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = texts(seed, 120, 60)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(frame(spark, rows).repartition(5), n, num, den).collect()}
    assert [got[i] for i in range(len(rows))] == brute_classes(rows, n, num, den)


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.classes(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (60, 100)])
def test_linked_pairs_share_a_part(num, den):
    rng = np.random.default_rng(num)
    bands = jaccard.Bands(num, den, 1 << 20)
    for size in [1, 2, 3, 5, 6, 9, 20, 57, 200, 1000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            union = a
            most = int(len(a) * (1 - num / den))
            drop = rng.integers(0, most + 1)
            b = rng.permutation(a)[drop:]
            while True:  # add as many others as a link allows
                more = np.append(b, rng.integers(0, 1 << 62, 1).astype(np.uint64))
                grown = len(np.union1d(a, more))
                if not jaccard.linked(len(np.intersect1d(a, more)), len(a), len(more), num, den):
                    break
                b, union = more, grown
            b = np.unique(b)
            if not jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b), num, den):
                continue
            keys, owner, need = jaccard.part_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
            # In some band that both have keys of, each shares as many as its partner must have in common with it.
            both = {(i, j): len(set(keys[owner == i].tolist()) & set(keys[owner == j].tolist())) for i in (0, 1) for j in (2, 3)}
            assert any(n and n >= max(need[i], need[j]) for (i, j), n in both.items())


@pytest.mark.parametrize("width", [1, 2, 5, 35, 50])
def test_rolling_is_the_polynomial_hash(width):
    h = np.random.default_rng(width).integers(0, 1 << 63, 120).astype(np.uint64)
    base = blocks.BASES[0]
    want = [sum(int(x) * pow(base, width - 1 - k) for k, x in enumerate(h[i : i + width])) % (1 << 64) for i in range(len(h) - width + 1)]
    assert blocks.rolling(h, width, base).tolist() == blocks.mix(np.array(want, np.uint64)).tolist()


def test_words_of_slices():
    """Columns that are slices of others, with characters of several bytes."""
    rows = ["é Ab", "c D", "", None, " Éa\tB ", "x\x1cy Ñ"] * 3
    for a in range(7):
        for lower in (False, True):
            named, counts = blocks.words(pa.array(rows).slice(a, 9), lower)
            want = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or "" for t in rows[a : a + 9]]
            assert counts.tolist() == [len(WORD.findall(t)) for t in want]
            assert named.to_pylist() == [w for t in want for w in WORD.findall(t)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    comp = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        comp[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for x in {v for e in edges for v in e}:
        assert got.get(x, x) == find(x)
