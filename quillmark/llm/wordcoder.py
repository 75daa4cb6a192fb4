"""Exact encoding with a word-splitting BPE tokenizer, through a bounded cache of letter runs.

The tokenizer of this file drops white space and never joins text across it, so a text's ids are the
ids of its blank-separated chunks in order. Arrow splits a batch into chunks and names the distinct
ones. A chunk of letters and marks encodes as its lower-cased letters and its marks; each distinct half is
looked up once, and only halves never seen go through the tokenizers library, as do other chunks. The ids
of a batch are then taken, chunk by chunk, into one buffer. A tokenizer whose normaliser or pre-tokenizer
is another one gets whole texts instead, without the cache.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common
from .common import buffers, objects

#: Marks of which a run behind letters forms a piece of its own (no apostrophe: it may begin a contraction).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters whose lower case is one letter, alone and in any word, and that no normal form changes.
_LETTERS = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
#: What of a tokenizer's settings the splitting relies on.
_KNOWN = {
    "normalizer": ["NFC", {"Regex": "\\s+"}, "Lowercase"],
    "pre_tokenizer": ["Split", {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "Removed", True, "ByteLevel"],
}


def _settings(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    found = {}
    for name, keys in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")):
        part = whole.get(name) or {}
        found[name] = [x for step in part.get(keys, [part]) for k in ("type", "pattern", "behavior", "invert") if (x := step.get(k)) is not None and x != "Replace"]
    return found


class WordCoder:
    """encode(texts) gives, per text, its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, words: int = 300000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.splits = _settings(path) == _KNOWN
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.halves, self.others = common.Known(words), common.Known(words // 8)

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces that the tokenizer keeps whole, many to a call: each ends at its one end-of-word token."""
        if "" in pieces:  # a chunk without marks
            at = pieces.index("")
            return [*self._pieces(pieces[:at]), b"", *self._pieces(pieces[at + 1 :])]
        each = [np.empty(0, "<u4")]
        for i in range(0, len(pieces), 4096):  # the library's results are large for a while
            texts = [" ".join(pieces[j : min(j + 256, i + 4096)]) for j in range(i, min(i + 4096, len(pieces)), 256)]
            each += [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        ids = np.concatenate(each)
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) != len(pieces) or len(ids) and ends[-1] != len(ids):
            return self._direct(pieces)
        raw, at = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _halves(self, parts: pa.Array) -> pa.Array:
        """Ids of each of ``parts``, which the tokenizer keeps whole; each distinct one is looked up once."""
        named = parts.dictionary_encode()
        return pa.array(self.halves.find(objects(named.dictionary), self._pieces), pa.large_binary()).take(named.indices)

    def _ids(self, chunks: pa.Array) -> pa.Array:
        """Ids of distinct chunks without blanks."""
        chunks = chunks.cast(pa.large_string())
        core = pc.utf8_rtrim(chunks, _MARKS)
        # Letters only, then marks that form a piece of their own: the two parts encode apart.
        plain = pc.match_substring_regex(core, _LETTERS)
        known, core = chunks.filter(plain), core.filter(plain)
        ids = pa.array([], pa.large_binary())
        if len(known):
            # The marks are what lies behind the core.
            ends, data = buffers(known)
            bounds = np.append(np.stack([ends[:-1], ends[:-1] + pc.binary_length(core).to_numpy()], 1).ravel(), ends[-1])
            both = pa.Array.from_buffers(pa.large_string(), 2 * len(known), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
            marks = both.take(pa.array(np.arange(1, 2 * len(known), 2)))
            ids = pc.binary_join_element_wise(self._halves(pc.utf8_lower(core)), self._halves(marks), pa.scalar(b"", pa.large_binary()))
        other = self.others.find(objects(chunks.filter(pc.invert(plain))), self._direct)
        # Both kinds one behind the other, then in the order of the chunks.
        kind = plain.to_numpy(zero_copy_only=False)
        at = np.where(kind, np.cumsum(kind) - 1, len(known) + np.cumsum(~kind) - 1)
        return pa.concat_arrays([ids, pa.array(other, pa.large_binary())]).take(pa.array(at))

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, where each text's ids begin and the last end)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.splits:
            each = self._direct(texts.to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in each], dtype=np.int64)])
        lists = pc.ascii_split_whitespace(texts)
        # Blanks at either end of a text give empty chunks, which have no ids.
        named = lists.flatten().dictionary_encode()
        got = self._ids(named.dictionary).take(named.indices)
        ends, data = buffers(got)
        offsets = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        return data.view("<u4"), ends[offsets] // 4

    def encode(self, texts: list[str | None]) -> list[bytes]:
        ids, at = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


_coders: dict[str, WordCoder] = {}


def coder(path: str) -> WordCoder:
    """One coder per Python worker, kept between tasks."""
    common.claim("words of a tokenizer", _coders.clear)
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]
