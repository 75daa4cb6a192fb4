"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of blanks at both ends and lower-cased (A-Z). ``LineRuns`` keeps, per
key hash, the number of documents that hold the key, as runs: tables in the shared folder, bucketed by hash and
sorted within each bucket. Each batch of documents is counted by key, dealt into the same buckets and merged with the runs
as they lie, which are neither shuffled nor sorted again. Keys that a run holds often enough already are anti-joined away; the others
become a new run at level 0, each with its count over all batches so far, so a line that every document
shares is written a few times and then no more. When a level holds ``fanout`` runs and another batch comes, they are merged into
one run of the next level, so a key is rewritten, and a batch meets runs, a logarithmic number of times.

A key is dropped by how often the whole corpus holds it, so documents are judged when all batches are in:
their line hashes, made once and written by batch, are joined with the frequent keys. A hash is two 64-bit hashes
of the key. Counting combines in the map tasks before the shuffle, so a line that a third of all documents
share arrives once per task.

Runs are listed in the session catalog while batches come in, since Spark reads buckets through it.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` code points are never counted or
dropped; a document that repeats a key counts once; repeated rows count as documents of their own and
get equal results; an empty table gives no rows; columns beside the text are carried along, whatever their names.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def line_key(line: Column) -> Column:
    return common.ascii_lower(F.trim(line, F.lit(common.BLANKS)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column, min_chars: int) -> Column:
    """Two hashes of a key; null for a key that is too short."""
    return F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))


def hashed_lines(docs: DataFrame, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """(k1, k2, batch, hashes): per row of ``docs`` its key, its batch by content, and its lines' hashes in order."""
    text = F.col(f"`{text_col}`")
    hashes = F.transform(split_lines(text), lambda x: _hashes(line_key(x), min_chars))
    return docs.select(*common.row_key(docs), F.pmod(F.xxhash64(F.lit("batch"), text), F.lit(batches)).cast("int").alias("batch"), hashes.alias("hashes"))


#: Spark trusts the order of buckets that are one file each, and does not take a union of bucketed scans to be
#: bucketed: 4.1 does, but reads the scans one after the other, so equal keys would not meet.
_SORTED_SCANS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}


@contextlib.contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """These settings for the plans that run inside."""
    before = {name: spark.conf.get(name, None) for name in _SORTED_SCANS}
    try:
        for name, value in _SORTED_SCANS.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


class LineRuns:
    """Levelled sorted runs of (h1, h2, docs) below the shared folder. A key's newest entry counts all batches so far."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, max(2, fanout)
        #: Runs by level, as (table, path), and the number of merges so far.
        self.levels: list[list[tuple[str, str]]] = [[]]
        self.merges = 0
        # As many as a shuffle has partitions, as far as Spark allows buckets.
        self.buckets = min(int(spark.conf.get(f"spark.sql.{x}")) for x in ("shuffle.partitions", "sources.bucketing.maxBuckets"))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(table) for level in self.levels for table, _ in level]

    def _write(self, counts: DataFrame) -> tuple[str, str]:
        path = common.scratch(self.spark, "run")
        table = f"spark_catalog.default.quillmark_run_{common.fresh()}"
        # One task has all of a bucket, so a bucket is one sorted file.
        rows = counts.repartition(self.buckets, "h1", "h2")
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(table)
        common.expire(self.spark, path)
        return table, path

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for table, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            common.remove(self.spark, path)

    def merged(self, keys: DataFrame) -> DataFrame:
        """(h1, h2, docs) of a batch's keys that no run holds often enough, counted over the batch and all runs."""
        out = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs")).repartition(self.buckets, "h1", "h2")
        held = []
        for i, run in enumerate(self.runs()):
            held.append(f"held{i}")
            out = out.join(run.withColumnRenamed("docs", held[-1]).hint("merge"), ["h1", "h2"], "left")
        if held:
            known = F.greatest(F.lit(0), *held)
            out = out.filter(known < self.min_docs).select("h1", "h2", (F.col("docs") + known).alias("docs"))
        return out

    def add(self, keys: DataFrame) -> None:
        """Add a batch: (h1, h2) once for each of its documents that holds the key. Keys that are frequent already
        stay out of the new run."""
        with _sorted_scans(self.spark):
            level = 0
            while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
                self._merge(level)
                level += 1
            self.levels[0].append(self._write(self.merged(keys)))

    def _merge(self, level: int) -> None:
        if level + 1 == len(self.levels):
            self.levels.append([])
        old, self.levels[level] = self.levels[level], []
        out = self.spark.table(old[0][0])
        for table, _ in old[1:]:
            out = out.unionByName(self.spark.table(table))
        self.levels[level + 1].append(self._write(out.groupBy("h1", "h2").agg(F.max("docs").alias("docs"))))
        self.merges += 1
        self._drop(old)

    def frequent(self) -> DataFrame:
        """Keys found in at least ``min_docs`` documents of all batches so far, written apart: a join with a plain table can be
        split where one key has many rows. Exactly one run holds such a key with its full count."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return common.materialise(out.filter(F.col("docs") >= self.min_docs).select("h1", "h2"), "frequent", small=True)

    def close(self) -> None:
        """Delete all runs, in the catalog too."""
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]


def batch_keys(hashed: DataFrame, batch: int) -> DataFrame:
    """(h1, h2) once for each document of a batch of hashed_lines() that holds the key."""
    own = hashed.filter(F.col("batch") == batch).select(F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))).alias("h"))
    return own.select("h.h1", "h.h2")


def frequent_keys(hashed: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """Keys that at least ``min_docs`` documents of hashed_lines() hold, by runs of all its batches."""
    runs = LineRuns(hashed.sparkSession, min_docs, fanout)
    try:
        for b in range(batches):
            runs.add(batch_keys(hashed, b))
        return runs.frequent()
    finally:
        runs.close()


def kept_text(text: Column, gone: Column) -> Column:
    """The lines of ``text`` that stay, joined by newline: what lies between neighbours of the sorted positions ``gone``
    (null: nothing goes) is copied slice by slice. Lines and positions are worked out once per row, as a lambda's argument."""

    def stay(x: Column) -> Column:
        lines, g = x["lines"], x["gone"]
        between = F.transform(F.sequence(F.lit(0), F.size(g) - 2), lambda i: F.slice(lines, F.get(g, i) + 2, F.get(g, i + 1) - F.get(g, i) - 1))
        return F.array_join(F.flatten(between), "\n")

    lines = split_lines(text)
    edges = F.concat(F.array(F.lit(-1)), F.sort_array(gone), F.array(F.size(lines)))
    return F.when(gone.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.get(F.transform(F.array(F.struct(lines.alias("lines"), edges.alias("gone"))), stay), F.lit(0)))


def dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 8, fanout: int = 4, text_col: str = "text") -> DataFrame:
    """``docs`` and, as the last three columns, n_lines, n_dropped and kept (the text without dropped lines). Where
    ``docs`` has such a name, the new column's gets underscores behind it.

    Only hashes and positions are shuffled to tell what goes, then each document once.
    """
    # Written by batch, so that each batch reads its own lines only.
    hashed = common.materialise(hashed_lines(docs, text_col, min_chars, batches), "lines", small=True, by=("batch",))
    frequent = frequent_keys(hashed, min_docs, batches, fanout)
    lines = hashed.select("k1", "k2", F.posexplode("hashes").alias("pos", "h")).select("k1", "k2", "pos", "h.h1", "h.h2").filter("h1 is not null")
    gone = lines.join(frequent, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = F.col(inner.columns[names.index(text_col)])
    # The key names the row by its own columns' content, in order.
    rows = inner.select(*inner.columns, *common.row_key(inner))
    out = rows.join(gone, ["k1", "k2"], "left")
    n_lines = F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(""))) + 1
    out = out.select(*inner.columns, n_lines.cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long"), kept_text(text, F.col("gone")))
    return out.toDF(*names, *common.free(("n_lines", "n_dropped", "kept"), names))
