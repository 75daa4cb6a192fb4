"""Run outputs: reward records, judge calls, label pages and keys, and the reports' sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import integrity as I

REWARDS = """metrics map<string,string>, rejected_groups array<int>, rank int, row_offset int, values array<double>, samples array<struct<row_id:string,reply:string,
hard:string,style:double,keys:struct<AB:string,BA:string>,margin:double,verdict:double,pairwise:double,unusable:string,value:double,off_topic:boolean,order_inconsistent:boolean>>"""
DIM = "struct<status:string,score:bigint,reason:string,evidence_ids:array<string>>"
SIDE = f"struct<P:{DIM},R:{DIM},N:{DIM}>"
CALL = f"id string, request_sha256 string, final struct<call_status:string,judgement:struct<winner:string,scores:struct<A:{SIDE},B:{SIDE}>>>, mapping map<string,string>"


def _from_path(pattern: str, group: int = 1):
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, group)


def reward_samples(spark: SparkSession, glob: str, group_size: int = 8) -> DataFrame:
    """One row per sample of reward records: rank and serial from the path (rank 0 without a rank folder),
    its global position and group, whether the group was rejected, and the verdict under either name."""
    r = spark.read.schema(REWARDS).option("multiLine", True).json(glob)
    r = r.select("*", F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_path, 'rank(\\\\d+)/', 1) as int)"), "rank", F.lit(0)).alias("rank_no"), _from_path(r"rewards_(\d+)\.json").cast("int").alias("serial"))
    s = r.select("rank_no", "serial", F.coalesce("row_offset", F.lit(0)).alias("row_offset"), "rejected_groups", F.posexplode("samples").alias("pos", "s"))
    group = F.floor((F.col("row_offset") + F.col("pos")) / group_size).cast("int")
    out = s.select(F.col("rank_no").alias("rank"), "serial", "pos", group.alias("grp"), F.array_contains("rejected_groups", group).alias("rejected"), "s.*")
    return out.withColumn("verdict", F.coalesce("pairwise", "verdict")).drop("pairwise")


def _calls(c: DataFrame, *more: str) -> DataFrame:
    score = lambda s, d: F.when(F.col(f"final.judgement.scores.{s}.{d}.status") == "scored", F.col(f"final.judgement.scores.{s}.{d}.score"))
    total = lambda s: score(s, "P") + score(s, "R") + score(s, "N")
    return c.select(
        F.coalesce(F.expr("try_cast(regexp_extract(_metadata.file_path, 'rank(\\\\d+)/', 1) as int)"), F.lit(0)).alias("rank"),
        _from_path(r"batch_(\d+)/").cast("int").alias("batch"),
        "id",
        F.col("final.call_status").alias("status"),
        F.col("final.judgement.winner").alias("winner"),
        F.when(F.col("final.call_status") == "ok", total("A") - total("B")).alias("margin_a"),
        *more,
    )


def judge_calls(spark: SparkSession, glob: str) -> DataFrame:
    """Judge call records keyed by rank, batch and id; a request asked again in a later batch stays apart."""
    return _calls(spark.read.schema(CALL).option("multiLine", True).json(glob))


def new_calls(spark: SparkSession, glob: str, lateness: str = "1 day", lines: bool = False) -> DataFrame:
    """judge_calls() as a stream: each start reads only files that were not there before. A record that comes in several files
    counts once, if they were written within ``lateness`` of each other; the state holds keys for no longer. ``lines``: records as JSON lines."""
    read = spark.readStream.schema(CALL).option("multiLine", not lines).json(glob)
    timed = read.withColumn("written", F.col("_metadata.file_modification_time"))
    return _calls(timed, "written").withWatermark("written", lateness).dropDuplicatesWithinWatermark(["rank", "batch", "id"])


def gather_calls(spark: SparkSession, glob: str, out: str, checkpoint: str, lateness: str = "1 day", lines: bool = False) -> StreamingQuery:
    """Adds the calls of new files to the table ``out``, each exactly once, and stops."""
    rows = new_calls(spark, glob, lateness, lines).drop("written")
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usable_margins(samples: DataFrame, calls: DataFrame) -> DataFrame:
    """Usable judged samples with their raw margin, the mean over both orders in points (-12 to 12)."""
    s = samples.filter(~F.col("rejected") & F.col("hard").isNull() & F.col("keys").isNotNull() & F.col("verdict").isNotNull())
    k = calls.select("rank", F.col("batch").alias("serial"), "id", "margin_a")
    ab, ba = k.withColumnsRenamed({"id": "ab", "margin_a": "m1"}), k.withColumnsRenamed({"id": "ba", "margin_a": "m2"})
    s = s.withColumn("ab", F.substring("keys.AB", 1, 16)).withColumn("ba", F.substring("keys.BA", 1, 16))
    j = s.join(ab, ["rank", "serial", "ab"]).join(ba, ["rank", "serial", "ba"])
    return j.withColumn("margin", (F.col("m1") - F.col("m2")) / 2.0).filter("margin is not null").drop("m1", "m2", "ab", "ba")


def page_items(spark: SparkSession, path: str) -> DataFrame:
    """The items embedded in a label page: the object that its script assigns to DATA."""
    html = spark.read.text(path, wholetext=True)
    body = F.replace(F.regexp_extract("value", r"(?s)const DATA = (\{.*?\});\s*\n", 1), F.lit("<\\/"), F.lit("</"))
    checked = F.when(F.length(body) > 0, body).otherwise(F.raise_error(F.lit("the page carries no item data")).cast("string"))
    return html.select(F.explode(F.from_json(checked, "set_id string, items array<struct<id:string,name:string,card:string,situation:string,speaker:string,line:string,left:string,right:string>>")["items"]).alias("i")).select("i.*")


def exported_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, choice, neither, at) of an exported label file."""
    body = spark.read.text(path, wholetext=True)
    held = F.from_json("value", "set_id string, labels map<string,struct<choice:string,neither:boolean,at:timestamp>>")
    return body.select(F.explode(held["labels"]).alias("id", "l")).select("id", "l.*")


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    body = spark.read.text(path, wholetext=True)
    held = F.from_json("value", "set_id string, items map<string,struct<kind:string,row_id:string,left:string,right:string,v3_pairwise:double,v3_margin:double>>")
    return body.select(F.explode(held["items"]).alias("id", "k")).select("id", "k.*")


def page_payload(items: DataFrame, set_id: str) -> DataFrame:
    """The one-row JSON payload of a label page, safe inside a script element; a set is a few hundred items."""
    body = F.to_json(F.struct(F.lit(set_id).alias("set_id"), F.array_sort(F.collect_list(F.struct(*items.columns))).alias("items")))
    return items.agg(F.replace(body, F.lit("</"), F.lit("<\\/")).alias("payload"))


def render_page(items: DataFrame, set_id: str, template: str, mark: str = "/*LABEL_DATA*/null") -> str:
    """The page's HTML from a template with a marked place."""
    return template.replace(mark, page_payload(items, set_id).first().payload)


def write_answer_key(key: DataFrame, set_id: str, path: str) -> None:
    """The answer key of a label page, apart from it, as one write-once JSON document; a set is a few hundred items."""
    entry = F.struct(*(c for c in key.columns if c != "id"))
    items = key.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("id"), entry)))).alias("items"))
    items.select(F.to_json(F.struct(F.lit(set_id).alias("set_id"), "items")).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


RECORD = "run string, kind string, at timestamp, body string"


def append_record(spark: SparkSession, run: str, kind: str, body: dict, path: str) -> None:
    """A run's manifest, invocation, failure, resume or verification, as a row that is only ever added."""
    row = spark.createDataFrame([(run, kind, json.dumps(body, sort_keys=True))], "run string, kind string, body string")
    row.withColumn("at", F.current_timestamp()).select("run", "kind", "at", "body").write.mode("append").partitionBy("run").parquet(path)


def records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    out = spark.read.schema(RECORD).parquet(path)
    return out if kind is None else out.filter(F.col("kind") == kind)


def manifest_rows(found: DataFrame) -> DataFrame:
    """(run, key, value) of the bodies of records, as integrity.manifest_drift() compares them."""
    return found.select("run", F.explode(F.from_json("body", "map<string,string>")).alias("key", "value"))


def batch_name(serial):
    return F.format_string("rewards_%05d", serial)


def write_parts(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the parts (values of ``by``) that ``rows`` holds and leaves all others: writing a part twice leaves one copy."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_calls(calls: DataFrame, path: str) -> None:
    """Judge calls with all attempts, by run and batch; a batch that is asked again by a replay replaces itself."""
    write_parts(calls, path, ["run", "batch"])


def write_rewards(rewards: DataFrame, path: str) -> None:
    """Reward records by run and serial."""
    write_parts(rewards, path, ["run", "serial"])


def changed_parts(rows: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """The parts of ``rows`` that ``held`` has with other rows: a replay has none. Both have the same columns, in any order."""
    columns = sorted(c for c in rows.columns if c not in by)
    now, was = (I.multiset_digest(d.select(*by, *(F.to_json(F.struct(F.col(c).alias("v"))).alias(c) for c in columns)), by, columns) for d in (rows, held))
    return now.join(was.select(*by, F.col("rows").alias("_rows"), F.col("digest").alias("_digest")), by).filter((F.col("rows") != F.col("_rows")) | (F.col("digest") != F.col("_digest"))).select(*by)


def replay_rewards(rewards: DataFrame, path: str) -> None:
    """Writes reward records and refuses a serial that is there with other records: a serial means one batch for good."""
    spark = rewards.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        held = spark.read.schema(rewards.schema).parquet(path)
        changed = changed_parts(rewards, held, ["run", "serial"]).orderBy("run", "serial").limit(1).collect()
        if changed:
            raise ValueError(f"serial {changed[0].serial} of run {changed[0].run} holds other records")
    write_rewards(rewards, path)


def next_serial(samples: DataFrame) -> int:
    """Numbering goes on after the last serial there is."""
    return (samples.agg(F.max("serial")).first()[0] or 0) + 1
