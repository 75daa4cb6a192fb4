"""What the operators share: scratch tables in the cluster's shared folder, sizes, row keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Regular expression of a word and of the blanks around it (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

#: A folder of our own, where the session names none.
_own: str | None = None
#: Lists that gather the scratch paths made while their with-block runs, innermost last.
_owners: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset, one
    of our own on a local master only."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="quillmark-shared-")
    return _own


def fresh() -> str:
    return uuid.uuid4().hex


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_root(spark)}/quillmark/{tag}-{fresh()}"
    for owner in _owners:
        owner.append(path)
    return path


@contextlib.contextmanager
def owned() -> Iterator[list[str]]:
    """The scratch paths that are made inside, for whoever knows when their readers are done."""
    paths: list[str] = []
    _owners.append(paths)
    try:
        yield paths
    finally:
        _owners.remove(paths)


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path in whatever store it lies."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def expire(spark: SparkSession, path: str) -> None:
    """Have a written scratch path deleted when the driver ends, if nobody does so before."""
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished work now; else they stay until the driver's next full collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, tag: str, small: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Write to the shared folder, in subfolders by the columns ``by``, and read back: cuts lineage, survives lost executors,
    evaluates once. The shuffle files behind it are deleted, unless the caller says that they are ``small``."""
    path = scratch(df.sparkSession, tag)
    df.write.partitionBy(*by).parquet(path)
    expire(df.sparkSession, path)
    if not small:
        free_shuffles(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    for t in tables:
        remove(t.sparkSession, t._scratch)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate: for a scan, the bytes of its files. Rows that came from the driver have
    none; they count as 1 MB."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 1 << 20


def power_of_two(x: float, least: int) -> int:
    return max(least, 1 << max(0, math.ceil(math.log2(max(x, 1)))))


def arrow_rows(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Bound the rows and bytes of an Arrow batch, so that batches of very long texts stay small. Spark reads
    these settings when a plan runs, after the caller has it, so they stay set for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def objects(a: pa.Array) -> list:
    """to_pylist() without a scalar object for each value."""
    return a.to_numpy(zero_copy_only=False).tolist()


def buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a large binary array."""
    if not len(a):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    ends = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, 8 * a.offset)
    return ends - ends[0], np.frombuffer(a.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


#: Bytes of text that a worker takes at a time.
SLICE = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``size`` bytes of text (a longer text is a batch alone)."""
    held, n = [], 0
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(cut, cut[at] + size - n, side="right")) - 1) if not held or cut[at + 1] - cut[at] + n <= size else at
            if to > at:
                held.append(b.slice(at, to - at))
                n += int(cut[to] - cut[at])
            if to < b.num_rows or n >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            at = to
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: Caches of this Python worker, by holder, and whose turn it is. Workers live on from stage to stage;
#: a stage's cache makes room when another operator's stage runs in the same worker.
_clear: dict[str, Callable[[], None]] = {}
_turn: str | None = None


def claim(holder: str, clear: Callable[[], None]) -> None:
    global _turn
    if _turn == holder:
        return
    if _turn is None:
        _frugal()
    else:
        _clear[_turn]()
        give_back()
    _clear[holder], _turn = clear, holder


_C = ctypes.CDLL(None)
#: glibc's number of the size from which an allocation gets pages of its own.
_MMAP_THRESHOLD = -3


def _frugal() -> None:
    """Have arrays return to the system as soon as they are freed, so that a worker's peak does not stay with it."""
    pa.set_memory_pool(pa.system_memory_pool())
    if hasattr(_C, "mallopt"):
        _C.mallopt(_MMAP_THRESHOLD, 1 << 18)


def give_back() -> None:
    """Return freed memory to the system; without this it stays with the worker, in pieces, when its work changes."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


class Known:
    """A cache of at most about ``most`` entries, emptied when it is full."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def find(self, keys: list, learn: Callable[[list], list]) -> list:
        """The value of each of the distinct ``keys``; those of unknown ones come from ``learn``."""
        found = list(map(self.held.get, keys))
        if None in found:
            lost = [i for i, x in enumerate(found) if x is None]
            new = [keys[i] for i in lost]
            told = learn(new)
            if len(self.held) + len(new) > self.most:
                self.held.clear()
            self.held.update(zip(new[: self.most], told))
            for i, x in zip(lost, told):
                found[i] = x
        return found


def free(new: tuple[str, ...], taken: list[str]) -> list[str]:
    """The names ``new``, each with underscores behind it while ``taken`` has it (in whatever case)."""
    out, held = [], {c.lower() for c in taken}
    for n in new:
        while n.lower() in held:
            n += "_"
        out.append(n)
        held.add(n.lower())
    return out


def _hashed_type(kind: T.DataType) -> bool:
    """Whether Spark hashes values of this type; it does not hash maps and variants, wherever they are nested."""
    if isinstance(kind, T.ArrayType):
        return _hashed_type(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashed_type(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_key(df: DataFrame) -> list[Column]:
    """Two 64-bit keys, k1 and k2, of a row's content, whatever its columns' names and types. Rows of equal content share a
    key, and so a result; values that Spark does not hash count by their JSON."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields]
    cols = [c if _hashed_type(f.dataType) else F.to_json(F.struct(c.alias("v"))) for c, f in zip(cols, df.schema.fields)]
    return [F.xxhash64(F.lit("quill"), *cols).alias("k1"), F.xxhash64(*cols, F.lit("mark")).alias("k2")]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
