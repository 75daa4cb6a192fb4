"""Driver queries of the url filter, the SentencePiece coder and the quality classifier."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, pieces, url_templates
from .url_templates import Rule

#: Fixed rules of the query.
RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


#: What stands behind the words of a junk page: three marks of one kind, as they are written in html.
_JUNK = r"%{3}|\*{3}|#{3}|\${3}|(?:&amp;){3}"


def junk_label(html: Column) -> Column:
    """The query's labels, which know nothing of urls or rules: a page is bad if a tenth of its words or more carry
    junk marks, good if less than a hundredth do; between, or without html, it has no label."""
    share = F.regexp_count(html, F.lit(_JUNK)) / F.size(F.split(html, " "))
    return F.when(share >= 0.1, 1.0).when(share < 0.01, 0.0)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by its path template."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_templates.judge(pages, RULES, junk_label(F.col("html")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with the 32k BPE model with byte fallback, and decoded again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def fitted(docs: DataFrame, sf_dir: str) -> cotraining.Model | None:
    """The quality model: good documents are those labelled of quality 1."""
    labels = docs.sparkSession.read.parquet(f"{sf_dir}/labels.parquet")
    return cotraining.train(docs, labels.select("doc_id", (F.col("quality") == 1).alias("good")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated scores by view and combined, and whether it stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cotraining.score(docs, fitted(docs, sf_dir)).select("doc_id", "p_text", "p_meta", "quality_score", "keep")


QUERIES = {"op1_url_filter": op1_url_filter, "op7_sentencepiece": op7_sentencepiece, "op8_quality_classifier": op8_quality_classifier}
ORACLES: dict[str, str] = {}
