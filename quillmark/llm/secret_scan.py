"""Secret scans: fixed patterns, and strings that a tokenizer finds hard to shorten.

Words and names of any text hold many characters a token; random strings do not. A candidate is a run of base64,
url-safe or hexadecimal characters of at least ``LEAST``; of it go, as known to be harmless, whole digests (hexadecimal, of
the length of a usual hash), UUIDs and numbers of six digits or more. What is left of a run must mix kinds of characters as no word
does, and is random if it has fewer than ``RATIO`` characters a token under a byte-level BPE vocabulary. Where a run as a
whole is not random, its alphanumeric parts are judged alone (a key at the end of a path). Long
strings are encoded in slices of ``SLICE`` characters, all of them, so that the encoder's time stays linear.
A random string inside a fixed pattern's span is not told twice.

Whole texts are searched. RE2 first finds the texts in which any pattern can match; in those the spans are found in code
points. Distinct candidates are encoded once a worker, through a bounded cache.

Defined results: a null or empty text has no spans. Each row is judged alone, so repeated rows and null ids give
rows alike; ties of spans at one start go by the order of KINDS. An empty table gives an empty one. Other columns stay as they are, and the
new column takes a name that is free.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The patterns of the contract and the least length of what counts (of a whole match, or of its second group).
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "random")

#: Characters of a candidate at least, characters a token below which it is random, characters encoded at a time.
LEAST, RATIO, SLICE = 20, 2.0, 256

# Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)

_DIGEST = "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in DIGESTS)
_UUID = r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"
_KNOWN = re.compile(rf"(?<![A-Za-z0-9])(?:{_DIGEST}|{_UUID}|[0-9]{{6,}})(?![A-Za-z0-9])")
_RUN, _PART = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"), re.compile(rf"[A-Za-z0-9]{{{LEAST},}}")
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
#: The same matches as HEX: maximal runs, of which the short ones do not count.
_HEX = re.compile(f"[0-9a-f]{{{LEAST_HEX},}}")
#: No text without a match of this has any span.
_MAYBE = rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{{{LEAST_HEX}}}|[A-Za-z0-9+/_=-]{{{LEAST}}}"""

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' matches: leftmost, not overlapping within a kind; matches that are too short go."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def mixed(s: str) -> bool:
    """Whether ``s`` mixes kinds of characters as no word, capitalised word or number does."""
    letters = re.sub(r"[^A-Za-z]", "", s)
    plain = letters.islower() or letters.isupper() or (letters[:1].isupper() and letters[1:].islower())
    return bool(letters) and (not plain or any(c.isdigit() for c in s))


class Vocabulary:
    """Tokens of strings under a tiktoken vocabulary; one per Python worker."""

    def __init__(self, path: str, most: int = 100_000):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = common.Known(most)

    def _random(self, strings: list[str]) -> list[bool]:
        cut = [[s[i : i + SLICE] for i in range(0, len(s), SLICE)] for s in strings]
        return [len(s) < RATIO * sum(len(self.encoding.encode_ordinary(p)) for p in parts) for s, parts in zip(strings, cut)]

    def random(self, s: str) -> bool:
        """Whether ``s`` has fewer than RATIO characters a token."""
        return mixed(s) and (self._random([s])[0] if len(s) > SLICE else self.known.find([s], self._random)[0])


def random_spans(text: str, vocabulary: Vocabulary) -> list[Span]:
    out = []
    for run in _RUN.finditer(text):
        at = run.start()
        for own in [*_KNOWN.finditer(text, run.start(), run.end()), None]:
            to = own.start() if own else run.end()
            out += _of_piece(text, at, to, vocabulary)
            at = own.end() if own else to
    return out


def _of_piece(text: str, at: int, to: int, vocabulary: Vocabulary) -> list[Span]:
    """What is random of a run between known strings, without the marks at its ends."""
    while at < to and not text[at].isalnum():
        at += 1
    while at < to and not text[to - 1].isalnum():
        to -= 1
    if to - at < LEAST:
        return []
    if vocabulary.random(text[at:to]):
        return [(at, 3, to)]
    parts = [(m.start(), m.end()) for m in _PART.finditer(text, at, to)]
    return [(a, 3, b) for a, b in parts if (a, b) != (at, to) and vocabulary.random(text[a:b])]


def spans(text: str, vocabulary: Vocabulary) -> list[Span]:
    """All spans of a text by start, then kind."""
    base = sorted(base_spans(text))
    begins, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    inside = lambda x: (i := bisect_right(begins, x[0])) and reach[i - 1] >= x[2]
    return sorted(base + [x for x in random_spans(text, vocabulary) if not inside(x)])


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    common.claim("tokens of candidates", _vocabularies.clear)
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def scan(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` and a last column ``spans``: array of (kind, start, end), in code points, end exclusive.
    ``vocabulary``: path of a tiktoken file that every executor has."""
    common.arrow_rows(docs.sparkSession)
    kind = "array<struct<kind:string,start:long,end:long>>"

    @F.arrow_udf(kind)
    def found(texts: pa.Array) -> pa.Array:
        maybe = pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False)
        held = iter(common.objects(texts.filter(maybe)))
        words = _vocabulary(vocabulary)
        out = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(next(held), words)] if m else [] for m in common.objects(maybe)]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    (name,) = common.free(("spans",), docs.columns)
    return docs.select("*", found(F.col(f"`{text_col}`").cast("string")).alias(name))
