"""Corpus pipeline: quality classifier, line dedup, near-duplicate removal, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame, which is written as Parquet and reread as the next stage's docs. All but the last return
the columns of documents, with n_chars following the text. Scratch of the stage before is deleted when
a stage starts, since its result has been written by then; nothing else is.

Stages and parameters:
* quality: documents that the co-trained classifier rejects go. Rows with a null doc_id are judged too.
* lines: lines held by at least 10 documents go; a document left without any text stays, empty. Extra columns with any names are carried.
* near_duplicates: 5-word shingles, Jaccard 0.8 or more; of each component the row of the smallest doc_id stays (a null
  id comes last; of rows of that id one, by a hash of the row). Rows without words are near nothing and stay.
* substrings: words under a 50-word window that occurs anywhere else go; the others are joined by one space.
* packing: pieces of at most 2048 tokens in as few sequences as minimum bin slack finds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import common, cotraining, jaccard, line_runs, packing, substring
from quillmark.llm.queries_models import fitted


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scratch of the stage that ran last.
_left: list[str] = []


def stage(work: Stage) -> Stage:
    """A stage that first deletes the scratch of the stage before it and owns what it makes itself."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear(spark)
        with common.owned() as made:
            out = work(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run_stage


def clear(spark: SparkSession) -> None:
    """Delete what the last stage has left; its result must have been written."""
    while _left:
        common.remove(spark, _left.pop())


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = cotraining.score(docs, fitted(every, sf_dir))
    return out.filter(F.col(f"`{out.columns[-1]}`")).select(*(f"`{c}`" for c in docs.columns))


def _texts(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """``columns`` with the text replaced, and n_chars with it."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_runs.dedup(docs, min_docs=10)
    return _texts(out, docs.columns, F.col(f"`{out.columns[-1]}`"))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = docs.columns
    keys = common.free(("k1", "k2"), names)
    # Rows are told apart by their whole content, since different rows may share an id or have none.
    every = docs.select("*", *(k.alias(name) for k, name in zip(common.row_key(docs), keys)))
    found = jaccard.groups(every, ["doc_id", *keys], n=5, num=80, den=100).toDF("doc_id", "k1", "k2", "n_shingles", "comp")
    least = found.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("own"))
    stay = common.materialise(least.select(F.col("own.k1").alias(keys[0]), F.col("own.k2").alias(keys[1])).distinct(), "stay", small=True)
    # Equal rows become one before the join, in the map tasks first.
    blank = F.length(F.trim(F.coalesce("text", F.lit("")), F.lit(common.BLANKS))) == 0
    kept = every.filter(~blank).dropDuplicates(keys).join(stay, keys, "left_semi")
    return kept.unionByName(every.filter(blank)).select(*(f"`{c}`" for c in names))


@stage
def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.dedup(docs, width=50)
    removed, kept = (F.col(f"`{c}`") for c in out.columns[-2:])
    return _texts(out, docs.columns, F.when(F.size(removed) > 0, kept).otherwise(F.col("text")))


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", substrings),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the fitted classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{common.shared_root(spark)}/quillmark-pipeline-{common.fresh()}"
    for k, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{root}/{k}-{name}")
            common.expire(spark, f"{root}/{k}-{name}")
            if k:
                common.remove(spark, f"{root}/{k - 1}-{STAGES[k - 1][0]}")
            docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
