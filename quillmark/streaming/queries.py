"""Driver queries of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as P
from ..plans import demo
from ..plans.sql import over
from ..session import expire, shared_folder, written
from ..sources import runs
from . import rewards


def reward_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch metrics of all samples, fed through Structured Streaming from files that cut across batches and groups, a
    quarter of the files at a time."""
    root = shared_folder(spark, "stream")
    rows = rewards.with_size(demo.samples(spark, sf_dir), "batch")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(files, "pos").write.parquet(f"{root}/in")
    expire(spark, root)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(f"{root}/in")
    rewards.score_stream(stream, demo.RULES, P.faulty(P.stub_judge), f"{root}/out", f"{root}/state", limit=1 << 40).awaitTermination()
    return rewards.read_metrics(spark, f"{root}/out").drop("serial")


def gathered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call records of all samples as JSON files by rank and batch (here a pass over the corpus, modulo eight), gathered in two starts; the second
    finds new files, which repeat records of the first."""
    root = shared_folder(spark, "calls")
    asked = written(P.requests(P.score_samples(demo.samples(spark, sf_dir), demo.RULES)))
    n = F.floor(F.col("row_id") / demo.SPAN) % 8
    calls = P.stub_judge(asked).join(asked.select("batch", "rank", "key", n.alias("pass")), ["batch", "rank", "key"])
    side = lambda s: F.struct(*(F.struct(F.lit("scored").alias("status"), F.col(f"{s}_{d}").cast("long").alias("score"), F.lit("r").alias("reason"), F.array(F.lit("E1")).alias("evidence_ids")).alias(d.upper()) for d in "prn"))
    scores = F.struct(side("a").alias("A"), side("b").alias("B")).alias("scores")
    final = F.struct(F.col("status").alias("call_status"), F.struct("winner", scores).alias("judgement"))
    records = calls.select(F.concat(F.lit("rank"), "rank").alias("r"), F.concat(F.lit("batch_"), "pass").alias("b"), "pass", F.col("key").alias("id"), F.col("key").alias("request_sha256"), final.alias("final"))
    for part in (records.filter("pass < 5"), records.filter("pass > 2")):
        part.drop("pass").write.mode("append").partitionBy("r", "b").json(f"{root}/in")
        runs.gather_calls(spark, f"{root}/in/*/*", f"{root}/out", f"{root}/state", lines=True).awaitTermination()
    expire(spark, root)
    return spark.read.parquet(f"{root}/out").groupBy("rank", "batch").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("winner") == "tie").alias("ties"), F.sum("margin_a").alias("margin_sum"))


STREAM_QUERIES = {"reward_stream": reward_stream, "gathered_calls": gathered_calls}
STREAM_ORACLES = {
    "reward_stream": over("per_batch", "SELECT * FROM per_batch"),
    "gathered_calls": over(
        "stub",
        """SELECT CAST(rank AS INTEGER) AS rank, CAST(pass AS INTEGER) AS batch, count(*) AS calls, count(*) FILTER (WHERE w = 'tie') AS ties, CAST(sum(p - q) AS BIGINT) AS margin_sum
 FROM (SELECT DISTINCT rank, row_id // 40000000000 % 8 AS pass, key, w, p, q FROM stub) GROUP BY ALL""",
    ),
}
