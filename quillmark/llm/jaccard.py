"""N-gram Jaccard join: which documents are linked by a Jaccard similarity of num/den or more.

A document's set holds its distinct shingles of ``n`` words (A-Z lower-cased). Equal sets are one
class. Classes meet in tiles: for each band of sizes, shingles are dealt by hash into more parts than
a linked pair of that band can differ in shingles, so the pair agrees in all filled parts but so many; a
tile is the classes of a band with the same content of a part. Only contents that occur more than once go on
(blocks.repeated()), and only of classes that share as many as a partner must, so texts like no other leave early.
Up to here only hashes of parts are kept; shingles and signatures are then derived from the blocks for the classes
that are left. Within a tile, hashed bitmap signatures bound the overlap of each pair from above,
|A n B| <= |A| - popcount(a and not b), before sorted arrays are intersected exactly.

Only links between different components matter, so tiles are worked in rounds: first each class with
the first class of its tiles that it shares most tiles with, then for each still separate component its pairs
of the best bounds, then all pairs that the bounds leave. No pair of a tile is skipped unless its two classes are already connected or
the bound rules it out, so the components are exact. Tiles of more than ``TILE`` classes are split
into pairs of chunks.

Sets are compared by 64-bit shingle hashes; classes are named by a 64-bit hash of the set.

Defined results: a text with fewer than n words is one shingle; null, empty or blank texts have no
shingle and stand alone; rows repeated with one doc_id are linked like any others; an empty table
gives no rows; a null doc_id gives a null component only if the whole component has none. Whole texts are read, however
long; of the other columns only those to carry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import common
from .components import components

TILE = 1024
_PART, _NODE = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


class Bands:
    """Size bands: of a linked pair, the larger set lies in the smaller's band or in the next."""

    def __init__(self, num: int, den: int, most: int):
        self.num, self.den, high = num, den, [1]
        while high[-1] < most:
            high.append(max(high[-1] + 1, high[-1] * den // num))
        high.append(max(high[-1] + 1, high[-1] * den // num))
        self.high = np.array(high, np.int64)
        #: Shingles in which a pair may differ whose smaller set lies in the band.
        self.differ = (den - num) * (self.high + self.high * den // num) // (den + num)
        #: More parts than that, so that a linked pair agrees in several and an accident in one does not count.
        self.parts = self.differ + 1 + np.where(self.differ > 0, 2 + self.differ // 10, 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, sizes)


def shingle_sets(texts: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, sorted and distinct within each document; where each document begins)."""
    named, counts = B.words(texts, lower=True)
    begins = np.concatenate([[0], np.cumsum(counts)])
    h = B.word_hashes(named)
    roll = B.rolling(h, n, B.BASES[0])
    full = np.maximum(counts - n + 1, 0)
    doc = np.repeat(np.arange(len(texts)), full)
    at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(begins[:-1], full)
    values = roll[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        own = np.array([B.rolling(h[begins[i] : begins[i + 1]], int(counts[i]), B.BASES[1])[0] for i in short], np.uint64)
        doc, values = np.concatenate([doc, short]), np.concatenate([values, own])
    if len(short):
        order = np.argsort(doc, kind="stable")
        doc, values = doc[order], values[order]
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(doc), bool)
    new[1:] = values[1:] != values[:-1]
    new[ends[ends < len(doc)]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[ends]


def nodes_of(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 64-bit name of each document's set."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(B.mix(values ^ _NODE), dtype=np.uint64)])
    return B.mix(total[begins[1:]] - total[begins[:-1]] + np.diff(begins).astype(np.uint64)).view(np.int64)


def part_keys(values: np.ndarray, begins: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of parts, the document of each as 2 * document + shift, how many of these a linked partner must share): a
    document has keys as the smaller of a pair (shift 0: its band) and as the larger (shift 1: the band before)."""
    sizes = np.diff(begins)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    mixed, keys, docs, need = B.mix(values ^ _PART), [], [], np.zeros(2 * len(sizes), np.int64)
    for shift in (0, 1):
        band = bands.of(sizes) - shift
        use = (sizes > 0) & (band >= 0)
        parts = np.where(use, bands.parts[np.maximum(band, 0)], 0)
        base = np.cumsum(parts) - parts
        on = use[doc]
        d, m = doc[on], mixed[on]
        salt = B.mix(band.astype(np.uint64) + np.uint64(1))
        slot = base[d] + ((B.mix(values[on] ^ salt[d]) >> np.uint64(11)) % np.maximum(parts, 1)[d].astype(np.uint64)).astype(np.int64)
        content = np.zeros(parts.sum(), np.uint64)
        np.add.at(content, slot, m)
        held = np.zeros(parts.sum(), bool)
        held[slot] = True
        owner = np.repeat(np.arange(len(sizes)), parts)
        inner = np.arange(len(owner)) - base[owner]
        filled = np.bincount(owner[held], minlength=len(sizes))
        # Empty parts count only for a set that fills no more parts than a pair may differ in.
        take = held | (filled <= bands.differ[np.maximum(band, 0)])[owner]
        o = owner[take]
        k = B.mix(content[take] ^ B.mix(inner[take].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt[o] + held[take].astype(np.uint64)))
        keys.append(k)
        docs.append(2 * o + shift)
        # A pair's difference touches at most ``differ`` parts; the other filled ones are keys that both have.
        need[shift::2] = np.maximum(filled - np.where(use, bands.differ[np.maximum(band, 0)], 0), 1)
    return np.concatenate(keys), np.concatenate(docs), need


def bitmap(values: np.ndarray, bits: int) -> np.ndarray:
    """Hashed bitmap signature as 64-bit words."""
    out = np.zeros(bits // 64, np.uint64)
    at = B.mix(values) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def width_of(size: int) -> int:
    return max(64, 1 << (8 * size - 1).bit_length())


def fold(signature: np.ndarray, bits: int) -> np.ndarray:
    """The signature of the same set with fewer bits."""
    while len(signature) * 64 > bits:
        signature = signature[: len(signature) // 2] | signature[len(signature) // 2 :]
    return signature


def linked(overlap, a, b, num: int, den: int):
    """Whether an overlap of sets of sizes a and b makes a link."""
    return den * overlap >= num * (a + b - overlap)


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose exact similarity makes a link."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            a, b, x, y = (t.column(i).to_pylist() for i in range(4))
            ok = []
            for i in range(len(a)):
                p, q = np.frombuffer(x[i], "<u8"), np.frombuffer(y[i], "<u8")
                same = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                if linked(same, len(p), len(q), num, den):
                    ok.append(i)
            if ok:
                yield pa.RecordBatch.from_pydict({"a": [a[i] for i in ok], "b": [b[i] for i in ok]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    return common.materialise(both.select("a", "b", "x", "y").mapInArrow(exact, "a long, b long"), "links")


def _tile(t: dict[str, np.ndarray], sigs: list[bytes], num: int, den: int, quota: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one tile between different components that the bitmaps do not rule out; of each component
    the ``quota`` best."""
    node, comp, size, side = (t[c] for c in ("node", "comp", "size", "side"))
    words = [np.frombuffer(x, "<u8") for x in sigs]
    bits = min(len(w) for w in words) * 64
    sig = np.stack([fold(w, bits) for w in words])
    own = np.bitwise_count(sig).sum(1, dtype=np.int64)
    rows, cols = np.flatnonzero(side <= side.min()), np.flatnonzero(side >= side.max())
    found = []
    step = max(1, (1 << 21) // max(1, sig.shape[1] * len(cols)))
    for i in range(0, len(rows), step):
        r = rows[i : i + step]
        both = np.bitwise_count(sig[r][:, None] & sig[cols][None]).sum(2, dtype=np.int64)
        most = np.minimum((size[r] - own[r])[:, None], (size[cols] - own[cols])[None]) + both
        ok = linked(most, size[r][:, None], size[cols][None], num, den) & (comp[r][:, None] != comp[cols][None])
        x, y = np.nonzero(ok)
        found.append((r[x], cols[y], most[x, y] / (size[r][x] + size[cols][y])))
    x, y, score = (np.concatenate(c) for c in zip(*found))
    if quota is not None and len(x):
        each = np.concatenate([comp[x], comp[y]])
        order = np.lexsort((np.tile(-score, 2), each))
        first = np.ones(len(order), bool)
        first[1:] = each[order][1:] != each[order][:-1]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        keep = np.unique(order[np.arange(len(order)) - begin < quota] % len(x))
        x, y = x[keep], y[keep]
    return np.minimum(node[x], node[y]), np.maximum(node[x], node[y])


def _tile_pairs(num: int, den: int, quota: int | None):
    """_tile() over rows that come sorted by tile; a tile is complete when the next one begins."""
    keys, columns = ["key", "x", "y"], ["node", "comp", "size", "side"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            cols = {c: table.column(c).to_numpy() for c in (*keys, *columns)}
            sigs = table.column("sig").to_pylist()
            cut = np.flatnonzero(np.any([cols[k][1:] != cols[k][:-1] for k in keys], axis=0)) + 1
            out = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(sigs)]):
                if b - a > 1 and (cols["comp"][a:b] != cols["comp"][a]).any():
                    out.append(_tile({c: cols[c][a:b] for c in columns}, sigs[a:b], num, den, quota))
            if out:
                a, b = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = [held.column(k)[-1].as_py() for k in keys]
            same = np.all([held.column(k).to_numpy() == v for k, v in zip(keys, last)], axis=0)
            at = int(np.argmax(same))
            if at:
                yield from solve(held.slice(0, at))
                held = held.slice(at)
        if held is not None:
            yield from solve(held)

    return work


def _own_sets(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, where each document's begin, names of the sets; of the first document of each set in the block its place, and its shingles' places)."""
    values, begins = shingle_sets(table.column("text"), n)
    names = nodes_of(values, begins)
    keep = np.zeros(len(names), bool)
    keep[np.unique(names, return_index=True)[1]] = True
    return values, begins, names, keep, np.repeat(keep, np.diff(begins))


def groups(docs: DataFrame, carry: list[str], n: int = 5, num: int = 80, den: int = 100, text_col: str = "text") -> DataFrame:
    """One row per document: the columns ``carry`` (long), n_shingles, and comp, a name of the document's component (null without shingles)."""
    rows = docs.select(*(F.col(f"`{c}`").cast("long").alias(f"c{i}") for i, c in enumerate(carry)), F.col(f"`{text_col}`").alias("text"))
    carried = rows.columns[:-1]
    deal = B.deal_of(docs, 0.5)
    packed = B.pack_blocks(rows, "text")
    sized = Bands(num, den, 1 << 40)

    def hashes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        # Copies within a block say nothing new: one of each class.
        values, begins, _, keep, on = _own_sets(table, n)
        keys, _, _ = part_keys(values[on], np.concatenate([[0], np.cumsum(np.diff(begins)[keep])]), sized)
        return keys, B.mix(keys ^ _NODE)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, found, firsts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                table = B.unpack(payload.as_buffer())
                values, begins, names, keep, on = _own_sets(table, n)
                sizes = np.diff(begins)
                keys, owner, need = part_keys(values[on], np.concatenate([[0], np.cumsum(sizes[keep])]), sized)
                starts, index, times = B.occurrences((keys, B.mix(keys ^ _NODE)), deal.buckets)
                hit = (B.marks(found, starts) | (times > 1))[index]
                # Too few keys in common with anything: no partner.
                hit &= (np.bincount(owner[hit], minlength=len(need)) >= need)[owner]
                # The first document of a set in its block carries the keys, unless an equal text stands in a block before.
                own = np.flatnonzero(keep)[owner // 2]
                first = np.zeros(len(sizes), bool)
                first[firsts or []] = True
                hit &= first[own]
                least = np.full(len(sizes), np.iinfo(np.int32).max)
                np.minimum.at(least, own[hit], need[owner[hit]])
                own = own[hit]
                order = np.argsort(own, kind="stable")
                ends = np.searchsorted(own[order], np.arange(len(sizes) + 1))
                listed = keys[hit][order].view(np.int64)
                for i in range(0, len(sizes), 2048):
                    j = range(i, min(i + 2048, len(sizes)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(table.column(c).slice(i, len(j)).combine_chunks() for c in carried),
                            pa.array(sizes[i : i + 2048]),
                            pa.array(names[i : i + 2048], mask=sizes[i : i + 2048] == 0),
                            pa.array([block] * len(j)),
                            pa.array(j, pa.int32()),
                            pa.array(np.minimum(least[i : i + 2048], np.iinfo(np.int32).max).astype(np.int32)),
                            pa.array([listed[ends[k] : ends[k + 1]] if ends[k] < ends[k + 1] else None for k in j], pa.list_(pa.int64())),
                        ],
                        names=[*carried, "n_shingles", "node", "block_id", "at", "need", "keys"],
                    )

    met = packed.select("block_id", "payload").join(B.repeated(packed, hashes, deal), "block_id", "left").join(B.first_copies(packed), "block_id", "left")
    all_docs = common.materialise(met.select("block_id", "payload", "bits", "firsts").mapInArrow(unfold, ", ".join(f"{c} long" for c in carried) + ", n_shingles long, node long, block_id long, at int, need int, keys array<long>"), "docs")

    # Tiles as (node, key) rows only; sets and signatures are derived for the nodes that any tile of two or more holds.
    held = all_docs.filter("keys is not null").select("node", "block_id", "at", "need", "keys")
    members = held.select("node", "need", F.explode("keys").alias("key")).groupBy("node", "key").agg(F.min("need").alias("need"))
    # Nodes that share fewer keys than a partner must with all others together leave.
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    met = common.materialise(members.join(shared, "key"), "met")
    strong = met.groupBy("node").agg(F.count(F.lit(1)).alias("keys"), F.min("need").alias("need")).filter("keys >= need").select("node")
    members = met.join(strong, "node", "left_semi")
    many = members.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiles = common.materialise(members.join(many, "key"), "tiles")
    common.drop_scratch(met)
    places = held.join(tiles.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("block_id", "at")).alias("p"))
    wanted = places.groupBy("p.block_id").agg(F.collect_list("p.at").alias("ats"))

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, ats in zip(batch.column(0), batch.column(1).to_pylist()):
                table = B.unpack(payload.as_buffer())
                for i in range(0, len(ats), 512):
                    values, begins = shingle_sets(table.column("text").take(pa.array(ats[i : i + 512])), n)
                    each = [values[a:b] for a, b in zip(begins, begins[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(nodes_of(values, begins)),
                            pa.array(np.diff(begins)),
                            pa.array([x.astype("<u8").tobytes() for x in each], pa.binary()),
                            pa.array([bitmap(x, width_of(len(x))).tobytes() for x in each], pa.binary()),
                        ],
                        names=["node", "size", "shingles", "sig"],
                    )

    sets = packed.select("block_id", "payload").join(wanted, "block_id").select("payload", "ats").mapInArrow(derive, "node long, size long, shingles binary, sig binary")
    sets = common.materialise(sets, "classes")
    common.drop_scratch(packed)
    named = all_docs.select(*carried, "n_shingles", "node").join(components(_links(tiles, sets, num, den)), "node", "left")
    return named.select(*(F.col(c).alias(name) for c, name in zip(carried, carry)), "n_shingles", F.coalesce("comp", "node").alias("comp"))


def classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the component), one row per document."""
    named = groups(docs, [id_col], n, num, den, text_col).withColumnRenamed(id_col, "doc_id")
    # Written first: a join with a plain table can be split where one component has many rows.
    least = common.materialise(named.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    return named.join(least, "comp", "left").select("doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _links(tiles: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between classes that connect all that is connected."""
    shared = tiles.filter("node <> lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("count"), F.min("need").alias("need")).filter(F.col("count") >= F.col("need"))
    first = shared.groupBy("node").agg(F.max_by("lead", F.struct("count", "lead")).alias("a")).select("a", F.col("node").alias("b"))
    links = verify(first, sets, num, den)
    for quota in (2, None):
        comp = components(links)
        joined = tiles.join(comp, "node", "left").select("key", "n", "node", F.coalesce("comp", "node").alias("comp"))
        # Tiles of different components; of tiles with the same members, one.
        mixed = joined.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("node")).alias("who")).filter("x <> y")
        mixed = mixed.groupBy("m", "who").agg(F.min("key").alias("key")).select("key")
        rest = joined.join(mixed, "key").join(sets.select("node", "size", "sig"), "node")
        # A large tile is worked as pairs of its chunks.
        cut = F.ceil(F.col("n") / TILE)
        own = F.pmod(F.xxhash64("node"), cut)
        rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)))
        rest = rest.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
        rest = rest.withColumn("side", F.when(F.col("own") == F.col("x"), 0).otherwise(1))
        rest = rest.select("key", "x", "y", "side", "node", "comp", "size", "sig").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        pairs = rest.mapInArrow(_tile_pairs(num, den, quota), "a long, b long").distinct()
        links = links.union(verify(pairs, sets, num, den))
    return links
