"""Blocks of documents, and the test which of their hashes occur more than once in the corpus.

A block is one row that holds some megabytes of documents as a compressed Arrow stream: an atomic unit
with a fixed inner order, written once to the shared folder. ``repeated()`` sends each block's distinct
64-bit hashes, sorted and dealt into buckets by a second, independent hash, to one task per bucket; the
task answers each block with one bit per hash. So a hash costs 8 bytes or less in the shuffle, however
often its block holds it; a hash that every document holds arrives once per block. A block deals into at most
``FAN`` buckets, whatever the corpus. Where that would make buckets of more than ``BUCKET_BYTES`` of input, a
second level follows: groups of blocks merge their shares of a bucket and deal them on by range, so that no
row of the shuffle gets small and no task large, and the bits come back the same way. Two hashes agree by chance
if both the 64 bits and the bucket agree: at n distinct hashes about n * n / 2 ** (65 + log2(buckets)) pairs in all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Input bytes (as stored) behind one bucket, characters of text in one block, and buckets that a block deals into.
BUCKET_BYTES = 12 << 20
BLOCK_CHARS = 2 << 20
FAN = 1024


class Deal(NamedTuple):
    """How hashes are dealt: buckets of a block, and ranges into which each bucket is dealt on (1: none)."""

    buckets: int
    ranges: int


def pack_blocks(docs: DataFrame, text_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block_id, payload, names): all columns of ``docs``, some documents to a row, and for each document two
    64-bit hashes of its text. Written to the shared folder."""
    common.arrow_rows(docs.sparkSession)
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, n = TaskContext.get().partitionId(), [], 0, 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            k = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in texts(table, text_col)]), np.int64)
            names = pa.StructArray.from_arrays([pa.array(k[::2]), pa.array(k[1::2])], names=["k1", "k2"])
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names).cast(kind)], names=["block_id", "payload", "names"])

        for b in common.slices(batches, at, block_chars):
            held.append(b)
            size += b.column(at).nbytes
            if size >= block_chars:
                yield row()
                held, size, n = [], 0, n + 1
        if held:
            yield row()

    return common.materialise(docs.mapInArrow(pack, "block_id long, payload binary, names array<struct<k1: long, k2: long>>"), "blocks")


def first_copies(blocks: DataFrame) -> DataFrame:
    """(block_id, firsts): per block, the places of the documents that are the first with their text in the corpus.
    Equal texts meet as two hashes and a place, combined before the shuffle."""
    rows = blocks.select("block_id", F.posexplode("names").alias("pos", "name"))
    own = rows.groupBy("name").agg(F.min(F.struct("block_id", "pos")).alias("own"))
    return own.groupBy("own.block_id").agg(F.collect_list("own.pos").alias("firsts"))


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def texts(table: pa.Table, col: str) -> list[bytes]:
    """UTF-8 of each text; none for null. bytes.split() then splits at ASCII blanks, and only there."""
    return [x or b"" for x in table.column(col).cast(pa.binary()).to_pylist()]


def words(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(all texts' words in order, each distinct one named once, but for case; how many each text has). ``lower``: A-Z as a-z."""
    common.claim("words", lambda: None)  # keeps nothing, but a coder's cache makes room
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(column)
    named = lists.flatten().dictionary_encode()
    if lower:  # of the dictionary, which begins at its buffer's begin; ascii_lower mistakes arrays that do not
        named = pa.DictionaryArray.from_arrays(named.indices, pc.ascii_lower(named.dictionary))
    counts = np.diff(np.asarray(lists.offsets))
    # Blanks at either end of a text give an empty word.
    empty = pc.equal(pc.binary_length(named.dictionary), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        gone = empty[named.indices.to_numpy()]
        doc = np.repeat(np.arange(len(counts)), counts)
        counts = counts - np.bincount(doc[gone], minlength=len(counts))
        named = pa.DictionaryArray.from_arrays(named.indices.filter(pa.array(~gone)), named.dictionary)
    return named, counts


def word_hashes(named: pa.DictionaryArray) -> np.ndarray:
    """64-bit hash of each word; each distinct one is hashed once."""
    each = common.objects(named.dictionary.cast(pa.large_binary()))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, each), dtype=np.uint64, count=len(each))[named.indices.to_numpy()]


#: Odd multipliers of two independent polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2 ** 64 of every ``width`` consecutive values, by doubling, then mixed."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, length = None, 0, h, 1
    left = width
    while left:
        if left & 1:
            if out is None:
                out, done = power, length
            else:  # what is there, then the next ``length`` values
                m = min(len(out), len(power) - done)
                out = out[:m] * np.uint64(pow(base, length, 1 << 64)) + power[done : done + m]
                done += length
        left >>= 1
        if left:
            power = power[: len(power) - length] * np.uint64(pow(base, length, 1 << 64)) + power[length:]
            length *= 2
    return mix(out[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deal_of(docs: DataFrame, share: float = 1.0) -> Deal:
    wanted = common.power_of_two(common.input_bytes(docs) * share / BUCKET_BYTES, min(16, FAN))
    return Deal(min(wanted, FAN), max(1, wanted // FAN))


def _by_bucket(hashes: tuple[np.ndarray, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that brings each bucket together, hashes in that order, where each bucket begins)."""
    h, deal = hashes
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    b = (deal >> np.uint64(65 - buckets.bit_length())).astype(kind) if buckets > 1 else np.zeros(len(h), kind)
    order = np.argsort(b, kind="stable")
    return order, h[order], np.searchsorted(b[order], np.arange(buckets + 1))


def _new(hs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the sorted hashes differ from the one before in their bucket."""
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    new[starts[starts < len(hs)]] = True
    return new


def distinct(hashes: tuple[np.ndarray, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, sorted within their bucket; where each bucket begins)."""
    _, hs, starts = _by_bucket(hashes, buckets)
    for a, b in zip(starts[:-1], starts[1:]):
        hs[a:b].sort()
    new = _new(hs, starts)
    return hs[new], np.concatenate([[0], np.cumsum(new)])[starts]


def occurrences(hashes: tuple[np.ndarray, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where each bucket of distinct() begins, index of each input hash in distinct(), times each occurs)."""
    order, hs, starts = _by_bucket(hashes, buckets)
    for a, b in zip(starts[:-1], starts[1:]):
        own = np.argsort(hs[a:b])
        hs[a:b], order[a:b] = hs[a:b][own], order[a:b][own]
    new = _new(hs, starts)
    rank = np.cumsum(new) - 1
    index = np.empty(len(hs), np.int64)
    index[order] = rank
    return np.concatenate([[0], np.cumsum(new)])[starts], index, np.bincount(rank) if len(hs) else np.empty(0, np.int64)


def _squeeze(h: np.ndarray) -> bytes:
    """Sorted values as differences, byte planes apart: the upper planes compress."""
    d = np.diff(h, prepend=np.uint64(0)).astype("<u8")
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def _expand(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _held_twice(each: list[np.ndarray]) -> list[np.ndarray]:
    """Of each array of distinct hashes, which of them another array holds too."""
    h = np.concatenate(each)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[:-1] |= same
    twice[1:] |= same
    mark = np.empty(len(h), bool)
    mark[order] = twice
    return np.split(mark, np.cumsum([len(x) for x in each])[:-1])


def _bits(marks: list[np.ndarray]) -> pa.Array:
    return pa.array([np.packbits(m).tobytes() for m in marks], pa.binary())


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """(the blocks' hashes of a bucket, all of them once, sorted)."""
    each = [_expand(x) for x in table.column("data").to_pylist()]
    return each, np.unique(np.concatenate(each))


def repeated(blocks: DataFrame, hashes: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], deal: Deal) -> DataFrame:
    """(block_id, bits): per block, a bit for each of its distinct() hashes that some other block holds too.
    bits is an array of (bucket, packed bits)."""
    buckets, ranges = deal
    # So many blocks form a group that its share of a range is as large as a block's of a bucket.
    groups = max(1, blocks.count() // ranges) if ranges > 1 else 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
                h, starts = distinct(hashes(unpack(payload.as_buffer())), buckets)
                own = [k for k in range(buckets) if starts[k] < starts[k + 1]]
                if own:
                    data = pa.array([_squeeze(h[starts[k] : starts[k + 1]]) for k in own], pa.binary())
                    group = xxhash.xxh32_intdigest(str(block)) % groups
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(own)), pa.array(own, pa.int32()), pa.array([group] * len(own), pa.int32()), data], names=["block_id", "bucket", "share", "data"])

    def meet(table: pa.Table) -> pa.Table:
        marks = _held_twice([_expand(x) for x in table.column("data").to_pylist()])
        return table.set_column(table.schema.get_field_index("data"), "data", _bits(marks))

    def split(table: pa.Table) -> pa.Table:
        _, h = _merged(table)
        top = np.arange(1, ranges, dtype=np.uint64) << np.uint64(65 - ranges.bit_length())
        parts = [(k, x) for k, x in enumerate(np.split(h, np.searchsorted(h, top))) if len(x)]
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(parts), pa.int32()), "span": pa.array([k for k, _ in parts], pa.int32()), "share": pa.array([table.column("share")[0].as_py()] * len(parts), pa.int32()), "data": pa.array([_squeeze(x) for _, x in parts], pa.binary())})

    def answer(table: pa.Table, told: pa.Table) -> pa.Table:
        """What the group's blocks hold twice among themselves, or some other group holds too."""
        each, h = _merged(table)
        ends = np.searchsorted(h, np.arange(1, ranges, dtype=np.uint64) << np.uint64(65 - ranges.bit_length()))
        ends = np.concatenate([[0], ends, [len(h)]])
        other = np.zeros(len(h), bool)
        for k, bits in zip(told.column("span").to_pylist(), told.column("data").to_pylist()):
            other[ends[k] : ends[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=ends[k + 1] - ends[k]).astype(bool)
        marks = [m | other[np.searchsorted(h, x)] for m, x in zip(_held_twice(each), each)]
        return pa.table({"block_id": table.column("block_id"), "bucket": table.column("bucket"), "data": _bits(marks)})

    schema = "block_id long, bucket int, share int, data binary"
    sent = blocks.select("block_id", "payload").mapInArrow(send, schema)
    # As many tasks as buckets or ranges, so that a task's share does not grow with the input.
    if ranges == 1:
        met = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(meet, schema)
    else:
        sent = common.materialise(sent, "sent")
        keys, range_schema = ["bucket", "share"], "bucket int, span int, share int, data binary"
        dealt = sent.repartition(buckets * ranges, *keys)
        ranged = dealt.groupBy(keys).applyInArrow(split, range_schema)
        told = ranged.repartition(buckets * ranges, "bucket", "span").groupBy("bucket", "span").applyInArrow(meet, range_schema)
        met = dealt.groupBy(keys).cogroup(told.groupBy(keys)).applyInArrow(answer, "block_id long, bucket int, data binary")
    return met.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "data")).alias("bits"))


def marks(bits: list[dict] | None, starts: np.ndarray) -> np.ndarray:
    """The bits of repeated() as one array along the block's distinct hashes."""
    out = np.zeros(starts[-1], bool)
    for x in bits or ():
        a, b = starts[x["bucket"]], starts[x["bucket"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(x["data"], np.uint8), count=b - a).astype(bool)
    return out
