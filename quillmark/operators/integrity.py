"""Frozen data: hashes of raw bytes, coverage, duplicates, disjoint splits, drift of manifests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files above this many bytes are hashed in blocks of BLOCK bytes; Spark's own reader holds a file in one row.
LARGE, BLOCK = 64 << 20, 4 << 20


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, sha256) of files read block by block; a running hash is all that a task holds."""
    for b in batches:
        paths, found = b.column(0).to_pylist(), []
        for path in paths:
            # Spark writes file:/a b, Arrow wants file:///a%20b.
            store, at = fs.FileSystem.from_uri(quote(re.sub(r"^file:/+", "file:///", path), safe="/:"))
            running = hashlib.sha256()
            with store.open_input_stream(at, buffer_size=0) as f:
                while block := f.read(BLOCK):
                    running.update(block)
            found.append(running.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.string())], names=["path", "sha256"])


def digests(spark: SparkSession, path: str, large: int = LARGE) -> DataFrame:
    """(file, sha256) of raw bytes, for files of any size.

    A hash is sequential, so a file is one task's work. Files of at most ``large`` bytes are hashed where Spark reads them; the others
    are dealt one by one to tasks that stream them in blocks, from any store that Arrow opens by its URI.
    """
    every = spark.read.format("binaryFile").load(path)
    small = every.filter(F.col("length") <= large).select("path", F.sha2("content", 256).alias("sha256"))
    names = every.select("path", "length").filter(F.col("length") > large).select("path")
    big = names.repartition("path").mapInArrow(_folded, "path string, sha256 string")
    # A scan makes no row of an empty file.
    listed = spark.createDataFrame([(re.sub(r"^file:/+", "file:/", unquote(u)),) for u in every.inputFiles()], "path string")
    empty = listed.join(every.select("path"), "path", "left_anti").select("path", F.lit(hashlib.sha256().hexdigest()).alias("sha256"))
    return small.unionByName(big).unionByName(empty).select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256")


def hash_drift(found: DataFrame, frozen: DataFrame) -> DataFrame:
    """Files whose hash changed, that are missing, or that were never recorded: (file, problem)."""
    j = found.withColumnRenamed("sha256", "now").join(frozen.withColumnRenamed("sha256", "was"), "file", "full_outer")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unrecorded").when(F.col("now") != F.col("was"), "changed")
    return j.select("file", problem.alias("problem")).filter("problem is not null")


#: Suffixes of files whose loading runs code.
PICKLED = (".pt", ".pth", ".bin")


def checkpoint_drift(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """hash_drift() of a checkpoint that may hold more files than were recorded, but no more pickles."""
    code = F.lit(False)
    for suffix in PICKLED:
        code = code | F.col("file").endswith(suffix)
    return hash_drift(found, recorded).filter((F.col("problem") != "unrecorded") | code)


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def coverage(rows: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has: (key, side). Empty if the two cover each other."""
    left = rows.select(key).distinct().withColumn("l", F.lit(True))
    right = replies.select(key).distinct().withColumn("r", F.lit(True))
    both = left.join(right, key, "full_outer")
    return both.filter("l is null or r is null").select(key, F.when(F.col("l").isNull(), "reply_without_row").otherwise("row_without_reply").alias("side"))


def shared_templates(rows: DataFrame) -> DataFrame:
    """Templates in both splits."""
    return rows.filter("split = 'train'").select("template").intersect(rows.filter("split = 'test'").select("template"))


def manifest_drift(old: DataFrame, new: DataFrame, ignore: tuple[str, ...] = ("endpoint",), defaults: dict[str, str] | None = None) -> DataFrame:
    """Keys of (key, value) manifests that differ; keys absent on a side take their default."""
    j = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "key", "full_outer")
    for k, v in (defaults or {"world_size": "1"}).items():
        j = j.withColumns({c: F.when((F.col("key") == k) & F.col(c).isNull(), v).otherwise(F.col(c)) for c in ("old", "new")})
    return j.filter(~F.col("key").isin(*ignore) & ~F.col("old").eqNullSafe(F.col("new")))


def judge_identity(metadata, kind, keys: tuple[str, ...]):
    """Whole metadata for stub and API judges, else the given keys of the map, all of which must be there."""
    picked = F.map_filter(metadata, lambda k, _: k.isin(*keys))
    chosen = F.when(kind.isin("stub_judge", "api_judge"), metadata).when(F.size(picked) == len(keys), picked).otherwise(F.raise_error(F.lit("judge metadata is incomplete")).cast("map<string,string>"))
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(chosen)))), 256)


def transient(status, error):
    """Whether a failed attempt is worth repeating: HTTP 408, 429, 5xx, or a connection fault."""
    return F.coalesce(status.isin(408, 429) | (status >= 500), F.lit(False)) | F.coalesce(error.isin("timeout", "connection", "url"), F.lit(False))


def worst_case_calls(steps, prompts, group, world):
    """Judge calls that a run can need at most, per process."""
    return F.floor(steps * prompts * group * 2 / world)


def row_words(*cols: Column) -> list[Column]:
    """Four 32-bit words of an md5 of a row's values, as longs; nulls differ from all values."""
    body = F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("0")) for c in cols))
    h = F.md5(body.cast("binary"))
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def multiset_digest(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, rows, digest) per key: equal for equal multisets of rows, in whatever order and parts they come. Sums of row
    hashes add up in the map tasks, so no key is gathered anywhere; good for 2**31 rows a key."""
    words = row_words(*(F.col(c) for c in columns))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *(F.sum(w).alias(f"_{i}") for i, w in enumerate(words)))
    return sums.select(*by, "rows", F.md5(F.concat_ws(",", *(F.col(f"_{i}").cast("string") for i in range(4))).cast("binary")).alias("digest"))


def rank_agreement(rows: DataFrame, by: list[str], rank: str, columns: list[str]) -> DataFrame:
    """(by, ranks, agree): whether all ranks hold the same rows of a key, each as often as the others do."""
    each = multiset_digest(rows, [*by, rank], columns)
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("ranks"), (F.countDistinct("rows", "digest") == 1).alias("agree"))
