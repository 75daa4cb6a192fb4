"""The driver's tables as reward-analytics inputs.

Every line of a document is a reply; the document's language decides the persona. The corpus is passed once
per line number: row_id = SPAN * line + doc_id, with lines counted from 0, so that in each pass eight consecutive
documents form a group, five groups a batch, half a batch a rank. Documents with fewer lines leave gaps. The group's
smallest row_id gives the base reply. What the corpus lacks (quotes, think blocks, speaker prefixes, ellipses, second
lines) is put on by row_id modulo 20. The same rules stand in SQL in plans/sql.py. Ids lie below SPAN.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Persona, Rules
from ..functions.protocol import DIMENSIONS, PAIR_PROTOCOL
from ..session import table

RULES = Rules(
    personas=(
        Persona("a", "Alba", aliases=("Alba",), markers=("the", "and", "tion"), anti_markers=("que", "ç", "!"), openers=("The", "And"), soft_min=20, soft_max=200, zero_at=600),
        Persona("b", "Bruno", aliases=("Bruno",), markers=("que", "eau", "ç"), anti_markers=("the", "and", "!"), foreign=("###",), openers=("Le", "De"), soft_min=20, soft_max=120, zero_at=400),
    ),
    out_of_character=("|",),
    length=(1, 600),
    claim="I am ",
    self_title="Th",
    self_title_persona="a",
)
GROUP, BATCH = 8, 40
#: Rows of one pass at most: a multiple of BATCH, above every doc_id.
SPAN = 40_000_000_000


def decorated(line, k):
    """The reply as a model would have given it."""
    return (
        F.when(k == 1, F.concat(F.lit("「"), line, F.lit("」")))
        .when(k == 2, F.concat(F.lit("<think>\n</think>\n"), line))
        .when(k == 3, F.concat(F.lit("Alba:"), line))
        .when(k == 4, F.concat(line, F.lit("....")))
        .when(k == 5, F.concat(line, F.lit("…")))
        .when(k == 6, F.concat(line, F.lit("\nnext")))
        .when(k == 7, F.concat(F.lit("I am Alba, I am Bruno. "), line))
        .otherwise(line)
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    d = d.select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pass", "given"))
    d = d.withColumn("row_id", F.col("pass").cast("long") * SPAN + F.col("doc_id"))
    d = d.select(
        "row_id",
        F.floor(F.col("row_id") / BATCH).alias("batch"),
        F.floor((F.col("row_id") % BATCH) / 20).alias("rank"),
        (F.col("row_id") % 20).alias("pos"),
        F.floor(F.col("row_id") / GROUP).alias("grp"),
        F.when(F.col("lang").isin("en", "de"), "a").otherwise("b").alias("character"),
        F.col("source").alias("situation"),
        F.col("lang").alias("speaker"),
        F.lit("line").alias("line"),
        decorated(F.col("given"), F.col("row_id") % 20).alias("reply"),
    )
    # The eight rows of a group; its base reply is that of its first row.
    first = Window.partitionBy("grp").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return d.withColumn("base", F.first("reply").over(first)).withColumn("prompt_id", F.col("grp"))


def suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User lines of conversations with the assistant's turn that follows; split by template."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user = t.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("line"))
    reply = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    rows = user.join(reply, ["conv_id", "turn"])
    split = F.when(F.substring(F.md5(F.col("conv_id").cast("string").cast("binary")), 1, 1) < "4", "test").otherwise("train")
    return rows.select(F.concat(F.col("conv_id").cast("string"), F.lit("-L"), F.col("turn").cast("string")).alias("row_id"), F.col("conv_id").alias("template"), "line", "reply", split.alias("split"))


def chat(payload: str) -> tuple[int | None, str | None, str | None]:
    """Stands for a remote judge that prefers the longer candidate: a chat body; by the candidates' lengths some requests find it
    down and some get an answer of no known winner."""
    p = json.loads(payload)
    a, b = len(p["candidate_A"]), len(p["candidate_B"])
    if a % 13 == 0:
        return 503, None, None
    winner = "C" if b % 11 == 0 else "A" if a > b else "B" if a < b else "tie"
    dimension = {"status": "scored", "score": 2, "reason": "length", "evidence_ids": ["E3"]}
    said = {"protocol": PAIR_PROTOCOL, "winner": winner, "scores": {s: {d: dimension for d in DIMENSIONS} for s in "AB"}, "reason": "length", "preference_evidence_ids": ["E3"]}
    return 200, json.dumps({"choices": [{"message": {"content": json.dumps(said)}}]}), None
