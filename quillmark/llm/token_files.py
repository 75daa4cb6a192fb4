"""Token-ID / binary output: flat unsigned integer files plus 64-bit document offsets.

Layout of a folder: ``part-NNNNN.ids`` holds the token ids of one partition's documents back to back
(16 bits each if every id of the vocabulary fits, else 32; little-endian), ``part-NNNNN.offsets`` the
64-bit token offsets of its documents and of its end, ``part-NNNNN.docs`` their 64-bit doc ids with a
leading byte for each that tells a null id. ``index.json`` has each part's documents, tokens and base;
bases are prefix sums over the parts, so a document's global start is base + offset. Parts are ranges
of doc_id in ascending order, nulls first; rows of one id may span parts. Parts grow with the corpus where it
has more than ``MOST`` of them, so that the index stays small. Files of a local or mounted store are memory-mapped.

Defined results: a null or empty text is just the end id; rows of one doc_id stay separate documents,
ordered among themselves by a hash of the text; an empty table gives an index without parts; other columns of the input are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .wordcoder import coder

#: Parts, each a row of the index, and token ids read at a time where files can't be mapped.
MOST, WINDOW = 16_384, 1 << 22
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def _put(store: pafs.FileSystem, path: str, data) -> None:
    """Write under a name of its own, then rename: a task that runs twice leaves one whole file."""
    own = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(data)
    store.move(own, path)


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int, bits: int = 16, part_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode ``docs`` in ascending id order into the folder ``out`` and return the index (a row per part)."""
    spark, out = docs.sparkSession, _uri(out)
    common.arrow_rows(spark)
    parts = min(MOST, int(common.input_bytes(docs) // part_bytes) + 1)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # The hash and the tie part rows of one id, or even equal rows, where they are many.
    rows = rows.withColumns({"h": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, "doc_id", "h", "tie").sortWithinPartitions("doc_id", "h", "tie").select("doc_id", "text")
    dtype = {16: "<u2", 32: "<u4"}[bits]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = coder(tokenizer), TaskContext.get().partitionId()
        store, root = _store(out)
        store.create_dir(root, recursive=True)
        name, own = f"{root}/part-{part:05d}", uuid.uuid4().hex
        lengths, ids = [], []
        stream = None
        for b in common.slices(batches, 1, 2 << 20):
            if stream is None:
                stream = store.open_output_stream(f"{name}.ids.{own}")
            a, at = words.encode_column(b.column(1))
            a = np.insert(a, at[1:], end_id)
            if bits == 16 and a.max() > 0xFFFF:
                raise ValueError("an id needs more than 16 bits")
            stream.write(a.astype(dtype).tobytes())
            lengths.append(np.diff(at) + 1)
            ids.append(b.column(0))
        if stream is None:
            return
        stream.close()
        store.move(f"{name}.ids.{own}", f"{name}.ids")
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths), dtype="<i8")]).astype("<i8")
        _put(store, f"{name}.offsets", offsets.tobytes())
        known = pa.chunked_array(ids)
        null = np.asarray(known.is_null().to_numpy(), dtype="u1")
        _put(store, f"{name}.docs", null.tobytes() + known.fill_null(0).to_numpy().astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "docs": [len(offsets) - 1], "tokens": [int(offsets[-1])]}, schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    # One row per part comes to the driver, at most MOST.
    found = {r.part: r for r in rows.mapInArrow(encode, "part int, docs long, tokens long").collect()}
    base, index = 0, []
    for k in sorted(found):
        index.append({"part": k, "docs": found[k].docs, "tokens": found[k].tokens, "base": base})
        base += found[k].tokens
    store, root = _store(out)
    store.create_dir(root, recursive=True)
    whole = {"bits": bits, "end_id": end_id, "tokens": base, "parts": index}
    _put(store, f"{root}/index.json", json.dumps(whole).encode())
    return whole


def _map(store: pafs.FileSystem, path: str, dtype: str, since: int, to: int) -> np.ndarray:
    """Entries ``since`` to ``to`` of a file: mapped, or read where the store is remote."""
    size = np.dtype(dtype).itemsize
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r", offset=since * size, shape=(to - since,)) if to > since else np.empty(0, dtype)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_at((to - since) * size, since * size), dtype=dtype)


def read_part(folder: str, part: dict, bits: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, global start, ids) of one part's documents, in order."""
    store, root = _store(_uri(folder))
    name, n = f"{root}/part-{part['part']:05d}", part["docs"]
    offsets = _map(store, f"{name}.offsets", "<i8", 0, n + 1)
    null = _map(store, f"{name}.docs", "u1", 0, n)
    docs = np.frombuffer(_map(store, f"{name}.docs", "u1", n, 9 * n).tobytes(), "<i8")
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + WINDOW, side="right")) - 1)
        ids = _map(store, f"{name}.ids", {16: "<u2", 32: "<u4"}[bits], int(offsets[at]), int(offsets[to]))
        for i in range(at, to):
            yield None if null[i] else int(docs[i]), part["base"] + int(offsets[i]), ids[offsets[i] - offsets[at] : offsets[i + 1] - offsets[at]]
        at = to


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The files as rows: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32 bits)."""
    store, root = _store(_uri(folder))
    with store.open_input_file(f"{root}/index.json") as f:
        index = json.loads(f.readall())
    bits = index["bits"]
    parts = spark.createDataFrame([(json.dumps(p),) for p in index["parts"]], "part string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                found = ((d, s, len(a), zlib.crc32(a.astype("<u4").tobytes())) for d, s, a in read_part(folder, json.loads(p), bits))
                while rows := list(islice(found, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.repartition(max(1, len(index["parts"]))).mapInArrow(digest, READ)
