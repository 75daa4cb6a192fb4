"""Token files and packing against the plain tokenizers library."""

import zlib

import numpy as np
import pytest

import public_tokenizers
from quillmark.llm import common, line_runs, packing, token_files
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, World! it's don't",
    None,
    "",
    "  \n\t ",
    "Ünḯcode İstanbul ǅ ΑΣ été ẋ.",
    "a\x1cb \x1d c d e",
    "<|endoftext|> x<|startoftext|>y <|endof text|>",
    "1234 5,6;7 ... !!! ?! 'll 's",
    "the quick brown fox " * 3000,
    "the quick brown fox " * 3000,
    "漢字かな交じり文。 ½ ² ﬁ",
]
SCHEMA = "doc_id long, text string, length string, part string"


def frame(spark, texts):
    return spark.createDataFrame([(100 - i if i != 3 else None, t, "x", None) for i, t in enumerate(texts)], SCHEMA)


def ids(text, end):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [end]


def crc(x):
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


def test_files_hold_every_document_in_order(spark, tmp_path):
    out = str(tmp_path / "t")
    index = token_files.write(frame(spark, TEXTS), out, PATH, 2, part_bytes=1 << 18)
    assert len(index["parts"]) > 1
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, out).collect())
    rows = sorted(((100 - i if i != 3 else None, t) for i, t in enumerate(TEXTS)), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for d, t in rows:
        x = ids(t, 2)
        want.append((start, d, len(x), crc(x)))
        start += len(x)
    assert got == want and index["tokens"] == start


def test_files_of_an_empty_table(spark, tmp_path):
    index = token_files.write(frame(spark, []), str(tmp_path / "t"), PATH, 2)
    assert index["parts"] == [] and token_files.read(spark, str(tmp_path / "t")).count() == 0


def test_packing_places_every_piece_once_and_gapless(spark):
    rows = packing.pack_documents(frame(spark, TEXTS), PATH, 0, capacity=256).collect()
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in enumerate(TEXTS):
        x, own = ids(t, 0), sorted(by_doc[100 - i if i != 3 else None], key=lambda r: r.piece)
        assert [(r.start, r.length, r.ids_crc32) for r in own] == [(a, len(x[a : a + 256]), crc(x[a : a + 256])) for a in range(0, len(x), 256)]
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(frame(spark, []), PATH, 0).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fullest_is_the_best_subset(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(rng.integers(1, 4)) for x in rng.choice(np.arange(3, 40), 5, replace=False)}
    sums = {0}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n + 1)}
    for room in (7, 31, 60, 97):
        got = packing.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(x) <= counts[x] for x in got)


def test_plan_uses_every_piece():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(v) for k, v in zip(rng.choice(2047, 300, replace=False) + 1, rng.integers(1, 50, 300))}
    bins, used = packing.plan(histogram, 2048), {}
    for combo, times in bins:
        assert sum(combo) <= 2048
        for x in combo:
            used[x] = used.get(x, 0) + times
    total = sum(k * v for k, v in histogram.items())
    assert used == histogram and sum(t for _, t in bins) <= 1.03 * total / 2048 + 1


def test_line_dedup_cases(spark):
    shared = " \tSame LINE\r"
    texts = [f"own {i}\n{shared}\n{shared if i % 2 else ''}" for i in range(10)] + [None, "", "rare\nrare\nrare", "\n\n"]
    rows = spark.createDataFrame([(i, t, "k1", 1) for i, t in enumerate(texts)], "doc_id long, text string, k1 string, gone int")
    out = line_runs.dedup(rows.select("doc_id", "text"), batches=3, fanout=2)
    got = {r.doc_id: r.kept for r in out.collect()}
    for i in range(10):
        assert got[i] == (f"own {i}" if i % 2 else f"own {i}\n")
    assert [got[i] for i in range(10, 14)] == ["", "", "rare\nrare\nrare", "\n\n"]
    assert line_runs.dedup(rows.limit(0).select("doc_id", "text")).count() == 0
    assert line_runs.dedup(rows.withColumnRenamed("gone", "Kept")).columns == ["doc_id", "text", "k1", "Kept", "n_lines", "n_dropped", "kept_"]
    twice = rows.union(rows).select("doc_id", "text")
    assert line_runs.dedup(twice).count() == 2 * len(texts)


def test_runs_merge_before_the_last_batch_and_lie_still(spark):
    """Counts of all batches equal brute force at any fanout; runs are neither shuffled nor sorted to meet a batch."""
    rng = np.random.default_rng(5)
    docs = [(i, "\n".join(f"line {int(x)}" for x in rng.zipf(1.4, 12) if x < 500)) for i in range(300)]
    hashed = common.materialise(line_runs.hashed_lines(spark.createDataFrame(docs, "doc_id long, text string"), "text", 1, 6), "lines", by=("batch",))
    every = {}
    for _, t in docs:
        for x in set(t.split("\n")) - {""}:
            every[x] = every.get(x, 0) + 1
    hot = {x for x, n in every.items() if n >= 10}
    for fanout in (2, 9):
        runs = line_runs.LineRuns(spark, 10, fanout)
        for b in range(5):
            runs.add(line_runs.batch_keys(hashed, b))
        assert runs.merges >= 1 or fanout == 9
        assert all(run.groupBy("h1", "h2").count().filter("count > 1").isEmpty() for run in runs.runs())
        with line_runs._sorted_scans(spark):
            plan = runs.merged(line_runs.batch_keys(hashed, 5))
            text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("SortMergeJoin") == len(runs.runs()) >= 1
        # The batch alone is shuffled, once, and sorted.
        assert text.count("Sort [") == 1 and text.count("Exchange") == 1, text
        runs.add(line_runs.batch_keys(hashed, 5))
        names = spark.createDataFrame([(x,) for x in every], "key string")
        h = line_runs._hashes(line_runs.line_key(names.key), 1)
        found = runs.frequent()
        got = {r.key for r in names.select("key", h.h1.alias("h1"), h.h2.alias("h2")).join(found, ["h1", "h2"], "left_semi").collect()}
        assert got == hot and found.count() == len(hot) > 5
        runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quillmark_run_")]


def test_a_small_word_cache_gives_the_same_ids():
    from quillmark.llm.wordcoder import WordCoder

    small, whole = WordCoder(PATH, words=7), Tokenizer.from_file(PATH)
    for k in range(4):
        texts = [f"w{k}a common words, here x{i} y{i % 3}" for i in range(6)]
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_lines_of_one_very_long_document(spark):
    """A hundred thousand lines, every other one dropped: linear work."""
    lines = [f"own {i}" if i % 2 else f"common {i % 500}" for i in range(100_000)]
    rows = [(0, "\n".join(lines))] + [(k, "\n".join(f"common {i}" for i in range(0, 500, 2))) for k in range(1, 11)]
    got = {r.doc_id: r for r in line_runs.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0].n_lines, got[0].n_dropped) == (100_000, 50_000)
    assert got[0].kept == "\n".join(lines[1::2]) and got[3].kept == ""


def test_token_files_of_one_repeated_id(spark, tmp_path):
    """Rows of one id, or of none, are dealt over several parts."""
    rows = [(7, f"word{i} " * 30) for i in range(150)] + [(None, f"none{i}") for i in range(50)] + [(9, "same")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = token_files.write(docs, str(tmp_path / "ids"), PATH, end_id=2, part_bytes=1 << 17)
    assert len(index["parts"]) > 4 and sum(p["docs"] for p in index["parts"]) == 220
    got = token_files.read(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 50 + [7] * 150 + [9] * 20
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]


def test_another_tokenizer_is_not_split_into_words():
    from quillmark.llm.wordcoder import WordCoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, whole = WordCoder(path), Tokenizer.from_file(path)
    assert not own.splits
    texts = ["two  spaces, don't", "", "é\n\nx"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
