"""SentencePiece encoding and decoding by suffix-array matching.

Each batch's text is cut where no piece of the vocabulary joins the bytes on both sides, and the distinct
parts that are new are concatenated and indexed: a suffix array over as many symbols as the longest piece
has. Every piece of the vocabulary is binary-searched for its range of occurrences; all ranges' positions
become edges (begin, end, piece), which are sorted by position in their part and relaxed from left to right.

A BPE model's encoding is the one path whose neighbours are compatible: the pair's own text encodes to
just that pair. So relaxing keeps, for each position, the one piece that ends there and is compatible with
the piece before it. Compatibility is worked out once per pair by merging the pair's text, best score
first, and kept. Characters that no piece holds become their UTF-8 byte pieces. A part longer than an index
is indexed window by window.

The model's normaliser must be the identity with spaces as U+2581 and a space put in front. Decoding joins the pieces,
bytes included, and takes that space away. A text without U+2581 comes back exactly.

Defined results: null and empty texts have no pieces and decode to the empty text; rows are coded each for itself, so
repeated rows come out repeated; an empty table gives no rows; only the id and text columns are read. No ties arise: one path is compatible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import buffers, objects

SPACE = "▁"
#: Code of characters that no piece holds, and of the gap between parts.
OTHER, GAP = 0xFFFF, 0
#: Characters in one index, and of one part in a window.
INDEX = 1 << 19
#: Slots of the table of known pairs (a power of two).
PAIRS = 1 << 21


class Vocabulary:
    """Pieces, scores and compatibility of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        self.text = [m.id_to_piece(i) for i in range(n)]
        self.normal = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.ids = {self.text[i]: i for i in self.normal}
        self.score = {self.text[i]: m.get_score(i) for i in self.normal}
        letters = sorted({c for i in self.normal for c in self.text[i]})
        if any(c not in self.ids for c in letters) or len(letters) >= OTHER or len(self.bytes) != 256:
            raise ValueError("every character of a piece must be a piece, and every byte")
        self.code = {c: k + 1 for k, c in enumerate(letters)}
        self.longest = max(map(len, self.ids))
        #: Pieces that encode to themselves; others never occur.
        self.live = [i for i in self.normal if self.merge(self.text[i]) == (i,)]
        self.table = np.zeros((len(self.live), -(-self.longest // 8) * 8), np.int64)
        for r, i in enumerate(self.live):
            self.table[r, : len(self.text[i])] = [self.code[c] for c in self.text[i]]
        self.sizes = np.array([len(self.text[i]) for i in self.live])
        self.live_ids = np.array(self.live)
        self.raw = [bytes([int(t[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]
        self.raw_column = pa.array(self.raw, pa.large_binary())
        #: Whether some piece holds one byte right before another.
        self.joins = np.zeros((256, 256), bool)
        for i in self.normal:
            x = np.frombuffer(self.raw[i], np.uint8)
            self.joins[x[:-1], x[1:]] = True
        self.pair, self.fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def merge(self, text: str) -> tuple[int, ...]:
        """The definition: join the adjacent pair of the best score, leftmost first, while any joins to a piece."""
        s = list(text)
        while len(s) > 1:
            best, at = None, -1
            for k in range(len(s) - 1):
                x = self.score.get(s[k] + s[k + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, k
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return tuple(self.ids.get(x, -1) for x in s)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair's text encodes to the pair. Answers are kept in a table of one pair to a slot."""
        key = a << 20 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - PAIRS.bit_length())).astype(np.int64)
        found, miss = self.fits[slot], np.flatnonzero(self.pair[slot] != key)
        if len(miss):
            new, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            told = np.array([self.merge(self.text[k >> 20] + self.text[k & 0xFFFFF]) == (k >> 20, k & 0xFFFFF) for k in new.tolist()], bool)
            self.pair[slot[miss][first]], self.fits[slot[miss][first]] = new, told
            found[miss] = told[back]
        return found

    def targets(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray], int]:
        """(the codes renumbered to those present, rows of live pieces that can occur, their lower and upper bounds, bits of a code)."""
        there = np.unique(codes)
        there = there[(there != GAP) & (there != OTHER)]
        bits = 8 if len(there) < 255 else 16
        most = (1 << bits) - 1
        new = np.full(OTHER + 1, -1, np.int64)
        new[there], new[GAP], new[OTHER] = np.arange(1, len(there) + 1), 0, most
        table = new[self.table]
        can = np.flatnonzero((table >= 0).all(1))
        low = table[can].astype(np.uint64)
        high = np.where(np.arange(low.shape[1]) < self.sizes[can][:, None], low, np.uint64(most))
        return new[codes].astype(np.uint64), can, _pack(low, bits), _pack(high, bits), bits


def _pack(table: np.ndarray, bits: int) -> list[np.ndarray]:
    """Rows of codes as 64-bit keys."""
    per, out = 64 // bits, []
    for k in range(0, table.shape[1], per):
        key = table[:, k]
        for c in range(k + 1, k + per):
            key = key << np.uint64(bits) | table[:, c]
        out.append(key)
    return out


def suffixes(codes: np.ndarray, symbols: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array by the first ``symbols`` symbols, the sorted suffixes' keys)."""
    n, per = len(codes), 64 // bits
    key, width = np.concatenate([codes, np.zeros(symbols, np.uint64)]), 1
    while width < per:  # one symbol, then two, four, ...
        key = key[:-width] << np.uint64(bits * width) | key[width:]
        width *= 2
    each = [key[k : k + n] for k in range(0, symbols, per)]
    order = np.lexsort(each[::-1])
    return order, [e[order] for e in each]


def search(sorted_keys: list[np.ndarray], targets: list[np.ndarray], right: bool) -> np.ndarray:
    """Binary search of every target at once: the first suffix not below it (right: above it)."""
    lo = np.zeros(len(targets[0]), np.int64)
    hi = np.full(len(targets[0]), len(sorted_keys[0]), np.int64)
    while (lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, len(sorted_keys[0]) - 1)
        less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for s, t in zip(sorted_keys, targets):
            v = s[at]
            less |= equal & (v < t)
            equal &= v == t
        if right:
            less |= equal
        open_ = lo < hi
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


class PieceCoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes; decode() turns them back."""

    def __init__(self, path: str, most: int = 300_000):
        self.vocabulary, self.parts = Vocabulary(path), common.Known(most)

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(all texts' parts in order, each with spaces for U+2581; where each text's parts begin and the last end)."""
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SPACE, " ")
        front = pc.if_else(pc.equal(texts, ""), "", " ").cast(pa.large_string())
        texts = pc.binary_join_element_wise(front, texts, pa.scalar("", pa.large_string()))
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        cut = np.ones(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = ~self.vocabulary.joins[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
            cut[ends] = True
        starts = np.flatnonzero(cut)
        if not len(data):
            starts = starts[:1]
        parts = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)])
        return parts, np.searchsorted(starts, ends)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids begin and the last end)."""
        parts, at = self._cut(texts)
        named = parts.dictionary_encode()
        found = self.parts.find(objects(named.dictionary), self._learn)
        got = pa.array(found, pa.large_binary()).take(named.indices)
        ends, data = buffers(got)
        return data.view("<u4"), ends[at] // 4

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids, at = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]

    def decode_column(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The texts of ids as encode_column() gives them."""
        got = self.vocabulary.raw_column.take(pa.array(ids.astype(np.int64)))
        ends, data = buffers(got)
        ends = ends[at]
        # The space put in front goes.
        begins = np.minimum(ends[:-1] + 1, ends[1:])
        bounds = np.stack([begins, ends[1:]], 1).ravel()
        pairs = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)]) if len(bounds) else pa.array([], pa.large_binary())
        texts = pairs.take(pa.array(np.arange(0, len(pairs), 2)))
        try:
            return texts.cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that form no text
            return pa.array([x.decode("utf-8", "replace") for x in texts.to_pylist()], pa.large_string())

    def decode(self, ids: bytes) -> str:
        raw = self.vocabulary.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")[1:]

    def _learn(self, parts: list[bytes]) -> list[bytes]:
        """Ids of new parts, as many at a time as an index holds; a longer part alone."""
        out, held, size = [], [], 0
        for p in parts:
            if size and size + len(p) > INDEX:
                out += self._encode_parts(held)
                held, size = [], 0
            held.append(p)
            size += len(p) + 1
        return out + self._encode_parts(held)

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        v = self.vocabulary
        texts = [p.decode().replace(" ", SPACE) for p in parts]
        points = np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")
        table = np.full(int(points.max(initial=0)) + 1, OTHER, np.uint64)
        for c, k in v.code.items():
            if ord(c) < len(table):
                table[ord(c)] = k
        codes = table[points]
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        codes[begins[1:-1] - 1] = GAP
        #: What ends at a position: a piece, -1 for a part's begin or after a character without piece, -2 for nothing.
        last, back = np.full(len(codes) + 1, -2, np.int64), np.zeros(len(codes) + 1, np.int64)
        last[begins[:-1]] = -1
        other = np.flatnonzero(codes == OTHER)
        last[other + 1], back[other + 1] = -1, other
        # Edges of one window end in it; they may begin in the one before.
        for a in range(0, len(codes), INDEX):
            since = max(0, a - v.longest)
            start, end, piece = self._edges(codes[since : a + INDEX])
            inside = end + since > a
            self._relax(start[inside] + since, end[inside] + since, piece[inside], begins, last, back)
        return self._walk(points, begins, last, back)

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every live piece's occurrences."""
        v = self.vocabulary
        dense, can, low, high, bits = v.targets(codes.astype(np.int64))
        order, keys = suffixes(dense, v.table.shape[1], bits)
        first, last = search(keys, low, False), search(keys, high, True)
        counts = last - first
        hit = np.flatnonzero(counts)
        n = counts[hit]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[hit], n)
        start = order[at]
        return start, start + np.repeat(v.sizes[can[hit]], n), np.repeat(v.live_ids[can[hit]], n)

    def _relax(self, start: np.ndarray, end: np.ndarray, piece: np.ndarray, begins: np.ndarray, last: np.ndarray, back: np.ndarray) -> None:
        """All parts at once: first the edges that end at their first position, then at the second, and so on."""
        inside = end - begins[np.searchsorted(begins, start, side="right") - 1]
        by = np.lexsort((-start, inside))
        start, end, piece, inside = start[by], end[by], piece[by], inside[by]
        cuts = np.flatnonzero(np.diff(inside, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = last[s]
            ok = before == -1
            more = np.flatnonzero(before >= 0)
            ok[more] = self.vocabulary.compatible(before[more], p[more])
            last[e[ok]], back[e[ok]] = p[ok], s[ok]

    def _walk(self, points: np.ndarray, begins: np.ndarray, last: np.ndarray, back: np.ndarray) -> list[bytes]:
        """The ids of each part: every part's path, walked back from its end."""
        v = self.vocabulary
        now, on = begins[1:] - 1, np.zeros(len(last), bool)
        floor = begins[:-1]
        while len(now):
            if (last[now] == -2).any():
                raise AssertionError("no compatible path")
            on[now] = True
            now = back[now]
            alive = now > floor
            now, floor = now[alive], floor[alive]
        path = np.flatnonzero(on)
        ids = last[path]
        sizes = np.ones(len(ids), np.int64)
        odd = {k: [v.bytes[x] for x in chr(points[path[k] - 1]).encode()] for k in np.flatnonzero(ids == -1).tolist()}
        for k, x in odd.items():
            sizes[k] = len(x)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(ids, sizes)
        for k, x in odd.items():
            flat[ends[k] : ends[k + 1]] = x
        raw, at = flat.astype("<u4").tobytes(), (4 * ends[np.searchsorted(path, begins, side="right")]).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]


_coders: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    common.claim("pieces", _coders.clear)
    if path not in _coders:
        _coders[path] = PieceCoder(path)
    return _coders[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), decoded (the text that they give back)."""
    common.arrow_rows(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for b in common.slices(batches, 1):
            ids, at = own.encode_column(b.column(1))
            each = pa.array([ids[x:y].tobytes() for x, y in zip(at, at[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), each, own.decode_column(ids, at).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(work, "doc_id long, ids binary, decoded string")
