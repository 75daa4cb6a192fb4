"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

Every window of ``width`` consecutive words of one document gets a polynomial hash; blocks.repeated() tells which hashes
occur more than once in the corpus, in the same document or elsewhere. Overlapping repeated windows
merge into maximal intervals, and their words are removed. Windows are judged on the input.

Defined results: a null or empty text, or one shorter than a window, loses nothing; copies of a text of
at least ``width`` words lose all of it, every copy (repeated rows included); an empty table gives no
rows; other columns are carried along unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import blocks as B
from . import common


def _windows(table: pa.Table, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, where each text's words begin and the last end, and the first word of each window."""
    named, counts = B.words(table.column(text_col))
    begins = np.concatenate([[0], np.cumsum(counts)])
    ok = np.zeros(begins[-1] + 1, bool)
    for a, n in zip(begins[:-1][counts >= width], counts[counts >= width]):
        ok[a : a + n - width + 1] = True
    return B.word_hashes(named), begins, np.flatnonzero(ok)


def window_hashes(width: int, text_col: str) -> Callable:
    def hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        h, _, at = _windows(table, text_col, width)
        return tuple(B.rolling(h, width, base)[at] for base in B.BASES)

    return hashes


def covered(table: pa.Table, bits: list[dict] | None, width: int, text_col: str, buckets: int) -> list[np.ndarray]:
    """Of each text, which of its words a repeated window covers."""
    h, begins, at = _windows(table, text_col, width)
    starts, index, times = B.occurrences(tuple(B.rolling(h, width, base)[at] for base in B.BASES), buckets)
    repeat = (B.marks(bits, starts) | (times > 1))[index]
    edge = np.zeros(begins[-1] + 1, np.int64)
    hit = at[repeat]
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    cover = np.cumsum(edge)[:-1] > 0
    return np.split(cover, begins[1:-1])


def intervals(cover: np.ndarray) -> list[tuple[int, int]]:
    """Maximal [begin, end) runs of covered words."""
    e = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    return list(zip(e[::2].tolist(), e[1::2].tolist()))


def dedup(docs: DataFrame, width: int = 35, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus, as the last three, n_words, removed (array of maximal [begin, end) intervals) and
    kept (text); where ``docs`` has such a name, the new column's gets underscores behind it."""
    deal = B.deal_of(docs)
    inner = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = inner.columns[docs.columns.index(text_col)]
    packed = B.pack_blocks(inner, text)
    bits = B.repeated(packed, window_hashes(width, text), deal)
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*inner.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("removed", span), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, found in zip(b.column(0), b.column(1).to_pylist()):
                table = B.unpack(payload.as_buffer())
                covers = covered(table, found, width, text, deal.buckets)
                for i in range(0, len(covers), 512):
                    yield from _rows(table.slice(i, 512), text, covers[i : i + 512]).to_batches()

    out = packed.select("block_id", "payload").join(bits, "block_id", "left").select("payload", "bits").mapInArrow(cut, schema)
    return out.toDF(*docs.columns, *common.free(("n_words", "removed", "kept"), docs.columns))


def kept_text(text: bytes, cover: np.ndarray) -> bytes:
    """The words that stay, joined by one space."""
    words = text.split()
    return b" ".join(words if not cover.any() else [w for w, c in zip(words, cover.tolist()) if not c])


def _rows(table: pa.Table, text_col: str, covers: list[np.ndarray]) -> pa.Table:
    spans = [[{"begin": a, "end": b} for a, b in intervals(c)] for c in covers]
    kept = [kept_text(t, c) for t, c in zip(B.texts(table, text_col), covers)]
    table = table.append_column("n_words", pa.array([len(c) for c in covers], pa.int64()))
    table = table.append_column("removed", pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))))
    return table.append_column("kept", pa.array(kept, pa.binary()).cast(pa.string())).combine_chunks()
