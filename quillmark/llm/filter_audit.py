"""Interaction audit of text filters: what each removes in every order in which they can be applied.

Every document gets a mask of the filters that it fails. Conditions on the text alone are expressions; the
duplicate filter (the same text under any smaller id) is decided by sorting: rows are range-sorted by text
fingerprint, full text and id, each is compared with its predecessor, and the run that a partition begins with
learns from the partitions before it which text has been seen under which smallest id. A text that a third
of all documents share lies in many partitions, since the ids are part of the range key; only fingerprints, ids and
row numbers are range keys, so no text goes to the driver.

The masks are then counted by part, at most 2 ** filters rows a part, and all orders are read off these
counts: the counters are additive, so parts, and parts of parts, can be added up.

Defined results: a null text is empty. A null id is smaller than none and has no smaller one, so such rows
neither fail the duplicate filter nor make others fail it. Rows of one id and one text do not fail it through each other.
Several labels of an id count as their largest. A null part is the empty string, and falls
together with it. An empty table has no parts and no rows. Texts of any length are taken whole. Other columns are ignored, whatever
their names and types.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, ranged


def text_conditions(text: Column) -> dict[str, Column]:
    """The query's filters A to D; a condition is true where the text fails."""
    trimmed = F.trim(text, F.lit(common.BLANKS))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n, distinct = F.when(trimmed == "", 0).otherwise(F.size(words)), F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | ranged.Edge]:
    """Of rows (fp, text, id, part, mask) in order: (id, part, mask, whether an earlier row of this partition has the
    text under a smaller id, digest of the text if the row has the partition's first fingerprint)."""
    first = last = None  # the partition's first and latest fingerprint
    text, least = None, None  # of the latest row: its text, and the smallest id of that text here
    seen: dict[bytes, int | None] = {}  # smallest ids by digest, under the latest fingerprint
    for b in batches:
        if not b.num_rows:
            continue
        fp, texts, ids = b.column(0).to_numpy(), b.column(1), b.column(2)
        same = np.empty(b.num_rows, bool)
        same[0] = first is not None and fp[0] == last and texts[0].as_py() == text
        same[1:] = (fp[1:] == fp[:-1]) & pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        if first is None:
            first = last = int(fp[0])
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        own = pc.fill_null(ids, 0).to_numpy()
        begin = ranged.starts(same)
        # Nulls come first in a run, so its first known id is the smallest.
        at = np.where(known, np.arange(len(own)), len(own))
        runs = np.flatnonzero(np.append(begin == np.arange(len(own)), True))
        smallest = np.minimum.reduceat(at, runs[:-1])
        mins: list[int | None] = [int(own[i]) if i < len(own) else None for i in smallest]
        if same[0] and least is not None:
            mins[0] = least
        of = np.searchsorted(runs[:-1], np.arange(len(own)), side="right") - 1
        has = np.array([m is not None for m in mins])[of]
        fails = known & has & (own > np.array([0 if m is None else m for m in mins], np.int64)[of])
        marks = pa.nulls(len(own), pa.binary())
        # Only the first and the latest fingerprint's texts are digested: those may go on in other partitions.
        heads = fp == first
        digests = {}
        for k, i in enumerate(runs[:-1].tolist()):
            if heads[i] or fp[i] == fp[-1]:
                digests[k] = hashlib.sha256(texts[i].as_py().encode()).digest()
        if heads.any():
            marks = pa.array([digests[k] if h else None for k, h in zip(of.tolist(), heads.tolist())], pa.binary())
        if fp[-1] != last:
            seen = {}
        last = int(fp[-1])
        for k, digest in digests.items():
            if fp[runs[k]] == last:
                seen[digest] = mins[k] if seen.get(digest) is None else seen[digest]
        text, least = texts[-1].as_py(), mins[-1]
        yield pa.RecordBatch.from_arrays([ids, b.column(3), b.column(4), pa.array(fails), marks], names=["id", "part", "mask", "fails", "digest"])
    if first is not None:
        yield first, last, first == last, seen


def _joined(before: dict, own: dict) -> dict:
    return own | {k: v for k, v in before.items() if v is not None or k not in own}


def masks(docs: DataFrame, conditions: dict[str, Column], part: Column, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(id, part, mask) of every row: bit i is condition i, the bit behind them the duplicate filter."""
    spark = docs.sparkSession
    common.arrow_rows(spark, 4096)
    whole = F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = ranged.numbered(rows.withColumn("fp", F.xxhash64("text")), "row")
    # The conditions are read after the sort, so that Spark's sampling of the range keys does not compute them.
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))

    ordered = rows.repartitionByRange("fp", "id", "row").sortWithinPartitions("fp", "text", "id")
    ordered = ordered.select("fp", "text", "id", "part", mask.cast("int").alias("mask"))
    found, edges = ranged.scan(ordered, _compare, "id long, part string, mask int, fails boolean, digest binary", "masks")
    earlier = ranged.carries(edges, _joined)
    seen = [(pid, digest, least) for pid, held in earlier.items() for digest, least in held.items() if least is not None]
    # A partition's first fingerprint has one text, but for collisions: about a row for each partition.
    carried = F.broadcast(spark.createDataFrame(seen, "pid int, digest binary, least long"))
    both = found.join(carried, ["pid", "digest"], "left")
    fails = F.coalesce(F.col("id") > F.col("least"), F.lit(False)) | F.col("fails")
    return both.select("id", "part", (F.col("mask") + F.when(fails, 1 << len(conditions)).otherwise(0)).alias("mask"))


def counted(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of masks() and labels (doc_id, good, toxic: booleans)."""
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # Equal rows become one in the map tasks, so that no id is hot in the join; rows without an id have no label.
    rows = found.groupBy("id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    with_id = rows.filter("id is not null").join(marks, "id", "left").drop("id")
    without = rows.filter("id is null").select("part", "mask", "n", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"))
    share = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return with_id.unionByName(without).groupBy("part", "mask").agg(F.sum("n").alias("n"), share("good"), share("toxic"))


def lattice(names: str) -> list[tuple]:
    """For every mask, order and step: (mask, filter_order, step, kept, removed, redundant, alone, share), where share
    is in how many of all orders the step's filter removes such a document."""
    k, out = len(names), []
    for order in permutations(range(k)):
        said = "".join(names[i] for i in order)
        for step, f in enumerate(order, 1):
            before = sum(1 << i for i in order[: step - 1])
            for mask in range(1 << k):
                hit, early = bool(mask >> f & 1), bool(mask & before)
                out.append((mask, said, step, int(not hit and not early), int(hit and not early), int(hit and early), int(mask == 1 << f), factorial(k) // mask.bit_count() if hit else 0))
    return out


def interactions(counts: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, from counted(); zeros included. At most about 20,000 fixed rows for five
    filters are broadcast."""
    spark = counts.sparkSession
    cells = spark.createDataFrame(lattice(names), "mask int, filter_order string, step int, is_kept int, is_removed int, is_redundant int, is_alone int, share long")
    both = counts.join(F.broadcast(cells), "mask")
    total = lambda flag, of, name: F.sum(F.col(flag) * F.col(of)).alias(name)
    return both.groupBy("part", "filter_order", "step").agg(
        total("is_kept", "n", "kept"),
        total("is_removed", "n", "removed"),
        total("is_redundant", "n", "redundant"),
        total("is_alone", "n", "unique_fails"),
        total("is_removed", "good", "good_lost"),
        total("is_removed", "toxic", "toxic_lost"),
        total("share", "n", "shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: Column, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """The five filters A to E in all orders, by part. ``labels``: doc_id, good, toxic."""
    conditions = text_conditions(F.col("text"))
    return interactions(counted(masks(docs, conditions, part, id_col, text), labels), "".join(conditions) + "E")
