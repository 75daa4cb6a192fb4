"""Prefix trie of conversations: nodes are distinct sequences of first turns, with counts rolled up from below.

Every turn becomes a fixed-size label, an md5 of role and text. Two range-sorted scans (``ranged``) number the
turns of each conversation and give each prefix a key of two 64-bit polynomials over its labels, which go on
from one partition to the next, so that a conversation of any length is spread over many tasks. Conversations of
equal turns become one sequence with a weight; their ids are listed in runs of a third sorted scan, and hashed run
by run.

A node is heavy if more than ``SHARD`` turns of distinct sequences lie at or below it; a heavy node's ancestors are heavy.
What hangs below the heavy nodes are prefix shards of at most ``SHARD`` turns, which no other shard shares a node with.
Shards are dealt into bundles of about ``BUNDLE`` turns; for each, numpy builds the level-order (LOUDS) bits and the label
arrays of a trie, level by level, and a pass over the levels from the deepest upwards adds each node's totals to its parent.
The heavy upper levels are merged apart, by the prefix key: their members and children are counted by grouping, and what
the shards below have rolled up reaches a heavy node along the turns of the smallest member of each shard, so that
every shard and every heavy node is told to each of its ancestors exactly once.

Defined results: rows without a conversation id take no part. A null turn comes first; rows of one turn go by the md5 of role and
text, and repeated rows are turns of their own. Null roles and texts are empty. Conversations that share a head keep it when they have
no turn of their own, or none at all. An empty table has no conversation, and so no root. Texts of any length are
taken whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, ranged

#: Turns at or below a node that is not heavy; turns of a bundle of shards; ids of a run that is hashed at once.
SHARD, BUNDLE, IDS = 512, 4096, 8192
#: Multipliers of the two polynomials, odd.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
KEY = ["depth", "p1", "p2"]


class Louds:
    """A level-order unary degree sequence: for each node in level order, as many ones as children, then a zero; a
    super-root's ones for the roots come first. Node i is the i-th one."""

    def __init__(self, roots: int, children: np.ndarray):
        degrees = np.concatenate([[roots], children])
        self.bits = np.ones(int(degrees.sum()) + len(degrees), bool)
        self.bits[np.cumsum(degrees) + np.arange(len(degrees))] = False

    def parents(self) -> np.ndarray:
        """Of each node: rank of zeros before its one, less the super-root; -1 for roots."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(~self.bits)
        return np.diff(zeros) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


def _number(batches: Iterator[pa.RecordBatch]):
    """Rows (conv, turn, label, chars) in order: each conversation's position in this partition, from 1."""
    first = last = None
    held, one = 0, True
    for b in batches:
        if not b.num_rows:
            continue
        conv = b.column(0).to_numpy()
        same = np.concatenate([[first is not None and conv[0] == last], conv[1:] == conv[:-1]])
        begin = ranged.starts(same)
        pos = np.arange(len(conv)) - begin + 1
        pos[begin == 0] += held if same[0] else 0
        if first is None:
            first = int(conv[0])
        one = one and bool((conv == first).all())
        last, held = int(conv[-1]), int(pos[-1])
        words = np.frombuffer(bytes.fromhex("".join(b.column(1).to_pylist())), ">i8").astype(np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pos), pa.array(words[:, 0]), pa.array(words[:, 1]), b.column(2)], names=["conv", "pos", "l1", "l2", "chars"])
    if first is not None:
        yield first, last, one, held


def _keys(batches: Iterator[pa.RecordBatch]):
    """Rows (conv, l1, l2, chars) in order: depth and the two polynomials of the prefix, within this partition."""
    inverse = [pow(x, -1, 1 << 64) for x in BASES]
    first = last = None
    depth, one, held = 0, True, np.zeros(2, np.uint64)
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv = b.column(0).to_numpy()
        same = np.concatenate([[first is not None and conv[0] == last], conv[1:] == conv[:-1]])
        begin = ranged.starts(same)
        at = np.arange(n) - begin
        out = []
        for i in (0, 1):
            h = b.column(1 + i).to_numpy().view(np.uint64)
            up, down = _powers(BASES[i], n + 1), _powers(inverse[i], n + 1)
            sums = np.cumsum(h * down[at], dtype=np.uint64)
            before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
            p = (sums - before) * up[at]
            if same[0]:
                p = np.where(begin == 0, p + held[i] * up[at + 1], p)
            out.append(p)
        d = at + 1 + np.where((begin == 0) & same[0], depth, 0)
        if first is None:
            first = int(conv[0])
        heads = conv == first
        one = one and bool(heads.all())
        last, depth, held = int(conv[-1]), int(d[-1]), np.array([out[0][-1], out[1][-1]], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d.astype(np.int64)), *(pa.array(p.view(np.int64)) for p in out), b.column(1), b.column(2), b.column(3), pa.array(heads)], names=["conv", "depth", "p1", "p2", "l1", "l2", "chars", "head"])
    if first is not None:
        yield first, last, one, (depth, int(held[0]), int(held[1]))


def _joined(before: tuple, own: tuple) -> tuple:
    """The prefix ``own`` behind ``before``."""
    return (before[0] + own[0], *((a * pow(x, own[0], 1 << 64) + b) % (1 << 64) for a, b, x in zip(before[1:], own[1:], BASES)))


def _list_ids(batches: Iterator[pa.RecordBatch]):
    """Rows (depth, p1, p2, conv) in order: for runs of one key, the first id, the number and the ids themselves."""
    key, ids, done = None, [], []

    def told() -> None:
        done.append({"depth": key[0], "p1": key[1], "p2": key[2], "conv": ids[0], "n": len(ids), "ids": ",".join(map(str, ids))})
        ids.clear()

    for b in batches:
        for *own, conv in zip(*(c.to_pylist() for c in b.columns)):
            if ids and (own != key or len(ids) >= IDS):
                told()
            key = own
            ids.append(conv)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=_RUN)
            done.clear()
    if ids:
        told()
        yield pa.RecordBatch.from_pylist(done, schema=_RUN)


_RUN = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("conv", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order, by key: the smallest id, the number of ids and the hash of all of them, joined by commas."""
    names = ["depth", "p1", "p2", "conv", "weight", "ends"]
    key, least, n, hashed = None, None, 0, None
    for b in batches:
        done = []
        for *own, conv, size, ids in zip(*(c.to_pylist() for c in b.columns)):
            if own != key:
                if key is not None:
                    done.append((*key, least, n, hashed.hexdigest()))
                key, least, n, hashed = own, conv, 0, hashlib.sha256()
            hashed.update((("," if n else "") + ids).encode())
            n += size
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done])
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*key, least, n, hashed.hexdigest())))])


def shard_tries(t: pa.Table) -> pa.Table:
    """The nodes of a bundle of shards, from the turns of its sequences: (top_*: the shard's first node; conv, depth, p1, p2,
    l1, l2, chars, weight, ends at a sequence's end)."""
    c = {name: t.column(name).to_numpy(zero_copy_only=False) for name in t.column_names if name != "ends"}
    ends = np.array(t.column("ends").to_pylist(), object)
    top = np.unique(np.stack([c["top_depth"], c["top1"], c["top2"]], 1), axis=0, return_inverse=True)[1].ravel()
    level = c["depth"] - c["top_depth"]
    order = np.lexsort((c["conv"], level))
    _, seq = np.unique(c["conv"], return_inverse=True)
    at = np.zeros(seq.max() + 1, np.int64)  # the node that each sequence has reached
    bounds = [0, *np.cumsum(np.bincount(level)).tolist()]
    parent, rows_of, node_of, sizes = [], [], np.empty(len(order), np.int64), []
    base = 0
    for k in range(len(bounds) - 1):
        own = order[bounds[k] : bounds[k + 1]]
        above = top[own] if k == 0 else at[seq[own]]
        # Siblings stand together, in the order of their labels: level order.
        by = np.lexsort((c["l2"][own], c["l1"][own], above))
        s = own[by]
        new = np.concatenate([[True], (above[by][1:] != above[by][:-1]) | (c["l1"][s][1:] != c["l1"][s][:-1]) | (c["l2"][s][1:] != c["l2"][s][:-1])])
        node = base + np.cumsum(new) - 1
        at[seq[s]] = node
        node_of[s] = node
        parent.append(above[by][new] if k else np.full(int(new.sum()), -1))
        rows_of.append(s[new])
        sizes.append(int(new.sum()))
        base += sizes[-1]
    some = np.concatenate(rows_of)  # one row of each node
    louds = Louds(sizes[0], np.bincount(np.concatenate(parent[1:]), minlength=base) if len(parent) > 1 else np.zeros(base, np.int64))
    up, children = louds.parents(), louds.degrees()
    members, least = np.zeros(base, np.int64), np.full(base, np.iinfo(np.int64).max)
    np.add.at(members, node_of, c["weight"])
    np.minimum.at(least, node_of, c["conv"])
    leaves, saved = (children == 0).astype(np.int64), (members - 1) * c["chars"][some]
    for k in range(len(sizes) - 1, 0, -1):
        z = sum(sizes[: k + 1])
        own = slice(z - sizes[k], z)
        np.add.at(leaves, up[own], leaves[own])
        np.add.at(saved, up[own], saved[own])
    told = np.full(base, None, object)
    last = ends != None  # noqa: E711
    told[node_of[last]] = ends[last]
    root = up < 0
    out = {"conv_id": least, "depth": c["depth"][some], "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}
    cols = {n: pa.array(x.astype(np.int64)) for n, x in out.items()}
    cols["parent_conv_id"] = pa.array(np.where(root, 0, least[up]), pa.int64(), mask=root)
    cols["ends"] = pa.array(told.tolist(), pa.string())
    # The parent's key, from the shard's own: the polynomial less its last label, divided by the base.
    for i, x in enumerate(BASES, 1):
        q = (c[f"p{i}"][some].view(np.uint64) - c[f"l{i}"][some].view(np.uint64)) * np.uint64(pow(x, -1, 1 << 64))
        cols[f"q{i}"] = pa.array(q.view(np.int64), mask=~root)
    return pa.table(cols)


_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_conv_id long, ends string, q1 long, q2 long"


def positions(turns: DataFrame) -> DataFrame:
    """(conv, pos, l1, l2, chars): each conversation's turns numbered from 1, with their labels."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), label.alias("label"), F.length(text).cast("long").alias("chars")).filter("conv is not null")
    ordered = ranged.numbered(rows, "row").repartitionByRange("conv", "turn", "label", "row").sortWithinPartitions("conv", "turn", "label").select("conv", "label", "chars")
    found, edges = ranged.scan(ordered, _number, "conv long, pos long, l1 long, l2 long, chars long", "turns")
    before = ranged.carries(edges, lambda a, b: a + b)
    firsts = {pid: e[0] for pid, e in edges}
    add = found.sparkSession.createDataFrame([(p, firsts[p], n) for p, n in before.items()], "pid int, conv long, before long")
    return found.join(F.broadcast(add), ["pid", "conv"], "left").select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "l1", "l2", "chars")


def rebuilt(rows: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Turns of rebuilt conversations: the first h of the group's first conversation, then the own ones behind the first
    h; h is a hash of the id, at most ``most``."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1)
    head = F.struct("pos", "l1", "l2", "chars")
    heads = rows.filter((F.col("pos") <= most) & (F.col("conv") % group == 0)).groupBy("conv").agg(F.array_sort(F.collect_list(head)).alias("heads"))
    members = rows.filter("pos = 1").select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")).filter("h > 0")
    given = members.join(heads.withColumnRenamed("conv", "base"), "base").select("conv", F.explode(F.slice("heads", 1, F.col("h").cast("int"))).alias("t")).select("conv", "t.*")
    return rows.filter(F.col("pos") > h).unionByName(given)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, depth, p1, p2, l1, l2, chars) of turns in the order of ``pos``."""
    ordered = rows.repartitionByRange("conv", "pos").sortWithinPartitions("conv", "pos").select("conv", "l1", "l2", "chars")
    schema = "conv long, depth long, p1 long, p2 long, l1 long, l2 long, chars long"
    found, edges = ranged.scan(ordered, _keys, f"{schema}, head boolean", "keys")
    before = ranged.carries(edges, _joined)

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in ("depth", "p1", "p2", "head", "pid")}
            d, p = cols["depth"].copy(), [cols["p1"].view(np.uint64).copy(), cols["p2"].view(np.uint64).copy()]
            for pid in np.unique(cols["pid"]).tolist():
                if pid in before:
                    own = np.flatnonzero((cols["pid"] == pid) & cols["head"])
                    n, *q = before[pid]
                    for i in (0, 1):
                        steps = np.array([pow(BASES[i], int(x), 1 << 64) for x in cols["depth"][own]], np.uint64)
                        p[i][own] += np.uint64(q[i]) * steps
                    d[own] += n
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(d), *(pa.array(x.view(np.int64)) for x in p), b.column("l1"), b.column("l2"), b.column("chars")], names=schema.replace(" long", "").split(", "))

    return found.mapInArrow(carried, schema)


def sequences(convs: DataFrame) -> DataFrame:
    """(depth, p1, p2, conv, weight, ends): one row per distinct whole sequence, from (conv, depth, p1, p2) of each conversation."""
    runs = convs.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(_list_ids, "depth long, p1 long, p2 long, conv long, n long, ids string")
    runs = runs.repartition(*KEY).sortWithinPartitions(*KEY, "conv")
    return runs.mapInArrow(_digest, "depth long, p1 long, p2 long, conv long, weight long, ends string")


def nodes(turns: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """All nodes of the trie of rebuilt conversations; ``turns``: conv_id, turn, role, text."""
    spark = turns.sparkSession
    common.arrow_rows(spark, 4096)
    rows = common.materialise(positions(turns), "positions")
    keyed = common.materialise(prefixes(rebuilt(rows, group, most)), "prefixes")
    whole = keyed.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("k"))
    whole = rows.filter("pos = 1").select("conv").join(whole, "conv", "left").select("conv", *(F.coalesce(f"k.{c}", F.lit(0)).cast("long").alias(c) for c in KEY))
    distinct = common.materialise(sequences(whole), "sequences")
    paths = keyed.join(distinct.select("conv", "weight", F.col("depth").alias("whole"), "ends"), "conv")
    paths = common.materialise(paths.withColumn("ends", F.when(F.col("depth") == F.col("whole"), F.col("ends"))), "paths")
    heavy = common.materialise(paths.groupBy(*KEY).agg(F.sum(F.col("whole") - F.col("depth") + 1).alias("below")).filter(F.col("below") > SHARD), "heavy", small=True)
    light, trunk = _shards(paths, heavy)
    light = common.materialise(light, "light")
    total = distinct.agg(F.sum("weight").alias("n"), F.min("conv").alias("least"), F.max(F.when(F.col("depth") == 0, F.col("ends"))).alias("ends")).first()
    if total.n is None:
        return spark.createDataFrame([], _RESULT)
    return _merged(light, trunk, total)


def _shards(paths: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes of all shards, turns at heavy nodes)."""
    marked = paths.join(heavy, KEY, "left").withColumn("heavy", F.col("below").isNotNull()).drop("below")
    key = F.struct(*KEY)
    tops = marked.groupBy("conv").agg(F.min(F.when(~F.col("heavy"), key)).alias("top")).filter("top is not null")
    bundles = max(1, -(-paths.count() // BUNDLE))
    rows = marked.filter("not heavy").join(tops, "conv").select(F.pmod(F.xxhash64("top"), F.lit(bundles)).alias("bundle"), F.col("top.depth").alias("top_depth"), F.col("top.p1").alias("top1"), F.col("top.p2").alias("top2"), "conv", *KEY, "l1", "l2", "chars", "weight", "ends")
    return rows.groupBy("bundle").applyInArrow(lambda t: shard_tries(t), _NODE), marked.filter("heavy")


_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NONE = hashlib.sha256(b"").hexdigest()


def _merged(light: DataFrame, trunk: DataFrame, total) -> DataFrame:
    """The nodes of the shards, the heavy levels above them and the root."""
    inverse = [pow(x, -1, 1 << 64) for x in BASES]
    tops = light.filter("parent_conv_id is null")
    upper = trunk.groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("chars").alias("chars"), F.max("ends").alias("ends"), F.max("l1").alias("l1"), F.max("l2").alias("l2"))

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = []
            for i in (0, 1):
                p, own = (b.column(f"{c}{i + 1}").to_numpy().view(np.uint64) for c in "pl")
                q.append(pa.array(((p - own) * np.uint64(inverse[i])).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, *q], names=[*b.schema.names, "q1", "q2"])

    schema = "depth long, p1 long, p2 long, n_convs long, conv_id long, chars long, ends string, l1 long, l2 long, q1 long, q2 long"
    upper = common.materialise(upper.mapInArrow(parents, schema), "upper", small=True)
    own = (F.col("n_convs") - 1) * F.col("chars")
    # What each conversation tells to the heavy nodes on its way: the shard and the heavy nodes whose smallest member it is.
    gives = tops.select(F.col("conv_id").alias("conv"), "n_leaves", F.col("saved_tokens").alias("saved")).unionByName(upper.select(F.col("conv_id").alias("conv"), F.lit(0).cast("long").alias("n_leaves"), own.alias("saved")))
    gives = gives.groupBy("conv").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    sums = trunk.select("conv", *KEY).join(gives, "conv").groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
    # Of its own heavy nodes, those above are not below: running sums along each owner, in blocks of 1024 levels.
    block = F.floor(F.col("depth") / 1024)
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cut = upper.withColumn("block", block).withColumn("own", own)
    blocks = cut.groupBy("conv_id", "block").agg(F.sum("own").alias("own")).select("conv_id", "block", F.coalesce(F.sum("own").over(across), F.lit(0)).alias("earlier"))
    above = cut.join(blocks, ["conv_id", "block"]).withColumn("above", F.col("earlier") + F.coalesce(F.sum("own").over(inside), F.lit(0)))
    under = tops.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).unionByName(upper.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")))
    children = common.materialise(under.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children")), "children", small=True)
    names = upper.select(F.col("depth").alias("up_depth"), F.col("p1").alias("up1"), F.col("p2").alias("up2"), F.col("conv_id").alias("up"))
    hangs = (F.col("depth") - 1 == F.col("up_depth")) & (F.col("q1") == F.col("up1")) & (F.col("q2") == F.col("up2"))

    def with_parent(rows: DataFrame) -> DataFrame:
        """Nodes of depth 1 hang from the root, the others from a heavy node."""
        root, rest = rows.filter("depth = 1").withColumn("parent", F.lit(total.least)), rows.filter("depth > 1")
        return root.unionByName(rest.join(names, hangs).select(*rows.columns, F.col("up").alias("parent")))

    def told(rows: DataFrame, parent: Column) -> DataFrame:
        return rows.select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"))

    full = above.join(sums, KEY).join(children, KEY).withColumn("saved_tokens", F.col("below") - F.col("above"))
    top = children.filter("depth = 0").agg(F.coalesce(F.sum("n_children"), F.lit(0)).alias("n_children"))
    leaves = tops.agg(F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("s1"))
    spent = upper.agg(F.coalesce(F.sum(own), F.lit(0)).alias("s2"))
    first = top.crossJoin(leaves).crossJoin(spent).select(F.lit(total.least).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(total.n).alias("n_convs"), "n_children", "n_leaves", (F.col("s1") + F.col("s2")).alias("saved_tokens"), F.lit(total.ends).cast("string").alias("ends"))
    return (
        told(first, F.lit(None))
        .unionByName(told(with_parent(full.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "q1", "q2")), F.col("parent")))
        .unionByName(told(with_parent(tops.drop("parent_conv_id")), F.col("parent")))
        .unionByName(told(light.filter("parent_conv_id is not null"), F.col("parent_conv_id")))
    )
