"""Streams of reward batches: assembly and streak as state, restarts, late and missing members."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quillmark.operators import pairs, reward
from quillmark.plans import demo
from quillmark.sources import runs
from quillmark.streaming import assembly, rewards

JUDGE = pairs.faulty(pairs.stub_judge)


def test_one_file_per_trigger_gives_the_batch_result(spark, tmp_path):
    rows = rewards.with_size(demo.samples(spark, "/root/testdata/sf0.001").filter("row_id < 200"), "batch")
    # Every file holds members of every group; one batch repeats some of its rows in a later file.
    rows.repartition(3, "pos").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: rewards.score_stream(stream, demo.RULES, JUDGE, str(tmp_path / "out"), str(tmp_path / "state"))
    run().awaitTermination()
    j, asked = pairs.judged(rows.drop("expected"), demo.RULES, JUDGE)
    want = reward.batch_metrics(j, asked, reward.groups(j), demo.RULES)
    found = rewards.read_metrics(spark, str(tmp_path / "out"))
    assert found.select("serial").distinct().count() == 1  # no batch was whole before the last file
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert rewards.read_left(spark, str(tmp_path / "out")).count() == 0
    # A restart finds nothing new; a member that comes again is late, and nothing is decided twice.
    run().awaitTermination()
    rows.limit(2).write.mode("append").parquet(str(tmp_path / "in"))
    run().awaitTermination()
    assert rewards.read_metrics(spark, str(tmp_path / "out")).count() == want.count()
    left = rewards.read_left(spark, str(tmp_path / "out")).collect()
    assert [r.assembly for r in left] == [assembly.LATE] * 2
    told = rewards.read_streaks(spark, str(tmp_path / "out")).collect()
    by_batch = {r.batch: r.streak for r in reward.rejected_streaks(want).collect()}
    assert {r.batch: r.streak for r in told} == by_batch and len(told) == len(by_batch)


def test_members_over_several_files_late_and_missing(spark, tmp_path):
    schema = "grp long, pos long, reply string, expected long"
    own, got = spark.newSession(), []
    own.conf.set("spark.sql.shuffle.partitions", "1")

    def feed(rows, until):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        end = time.time() + 60
        while not until(sorted((r.grp, r.pos, r.reply, r.assembly) for r in got)) and query.isActive and time.time() < end:
            time.sleep(0.2)
        return sorted((r.grp, r.pos, r.reply, r.assembly) for r in got)

    (tmp_path / "in").mkdir()
    out = assembly.assembled(own.readStream.schema(schema).parquet(str(tmp_path / "in")), ["grp"], "expected", ["pos"], timeout=15_000, remember=3_600_000)
    query = out.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        whole = [(1, 0, "a", "whole"), (1, 1, "b", "whole"), (2, 0, "c", "whole")]
        assert feed([(1, 0, "a", 2), (2, 0, "c", 1)], lambda g: len(g) == 1) == whole[2:]
        assert feed([(1, 1, "b", 2)], lambda g: len(g) == 3) == whole
        # A repeated member counts once, and the group is given up when its time is over.
        short = [(3, 0, "d", "short"), (3, 1, "e", "short")]
        assert feed([(3, 0, "d", 3), (3, 1, "e", 3), (3, 1, "e", 3)], lambda g: len(g) == 5) == whole + short
        late = [(1, 1, "again", "late"), (3, 2, "too late", "late")]
        assert feed([(3, 2, "too late", 3), (1, 1, "again", 2)], lambda g: len(g) == 7) == sorted(whole + short + late)
    finally:
        query.stop()


def test_a_stuck_stream_stops_and_stays_stopped(spark, tmp_path):
    def broken(pending):
        return pairs.stub_judge(pending).withColumn("status", F.lit("parse_error"))

    schema = "row_id long, batch long, rank long, pos long, grp long, character string, situation string, speaker string, line string, reply string, base string, prompt_id long, expected long"
    run = lambda judge: rewards.score_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), demo.RULES, judge, str(tmp_path / "out"), str(tmp_path / "state"), limit=2).awaitTermination()

    def feed(*batches):
        long = "the one and only reply of twenty letters"
        spark.createDataFrame([(4 * b + i, b, 0, i, b, "a", "s", "x", "y", f"{long} {b}{i}", long, b, 4) for b in batches for i in range(4)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    feed(0)
    run(broken)
    feed(1)
    run(pairs.stub_judge)  # a usable batch between them
    feed(2)
    run(broken)
    assert [(r.batch, r.streak, r.abort) for r in rewards.read_streaks(spark, str(tmp_path / "out")).orderBy("batch").collect()] == [(0, 1, False), (1, 0, False), (2, 1, False)]
    feed(3)
    with pytest.raises(Exception, match="2 consecutive batches"):
        run(broken)
    # Started again, the streak is what it was, and the batch is neither judged nor counted a second time.
    asked = []
    with pytest.raises(Exception, match="2 consecutive batches"):
        run(lambda pending: asked.append(1) or broken(pending))
    assert not asked
    assert rewards.read_metrics(spark, str(tmp_path / "out")).count() == 4


def test_streaks_count_a_serial_once(spark, tmp_path):
    schema = "run string, serial long, batch long, groups long, rejected_groups long"
    got = []
    for rows in ([("r", 0, 0, 2, 2), ("q", 0, 5, 1, 1), ("r", 0, 1, 2, 2)], [("r", 0, 1, 2, 2), ("r", 1, 2, 2, 2)], [("r", 2, 3, 2, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = assembly.streaks(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        out.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.run, r.batch, r.streak, r.abort) for r in got) == [("q", 5, 1, False), ("r", 0, 1, False), ("r", 1, 2, False), ("r", 2, 3, True), ("r", 3, 0, False)]


def test_new_call_files_add_rows_once(spark, tmp_path):
    def call(rank, batch, key, p=3):
        folder = tmp_path / f"rank{rank}/calls/batch_{batch:05d}/{key}"
        folder.mkdir(parents=True, exist_ok=True)
        d = lambda n: {x: {"status": "scored", "score": n, "reason": "r", "evidence_ids": ["E1"]} for x in "PRN"}
        (folder / "result.json").write_text(json.dumps({"id": key, "request_sha256": key, "final": {"call_status": "ok", "judgement": {"winner": "A", "scores": {"A": d(p), "B": d(1)}}}}))

    glob, out = f"{tmp_path}/rank*/calls/batch_*/*/*.json", str(tmp_path / "out")
    read = []

    def gather():
        q = runs.gather_calls(spark, glob, out, str(tmp_path / "state"))
        q.awaitTermination()
        read.append(sum(p.numInputRows for p in q.recentProgress))
        return sorted((r["rank"], r.batch, r.id, r.margin_a) for r in spark.read.parquet(out).collect())

    call(0, 1, "a")
    call(1, 1, "a", 2)
    assert gather() == [(0, 1, "a", 6), (1, 1, "a", 3)]
    call(0, 2, "a")  # asked again in a later batch
    (tmp_path / "rank0/calls/batch_00001/a/copy.json").write_text((tmp_path / "rank0/calls/batch_00001/a/result.json").read_text())
    assert gather() == [(0, 1, "a", 6), (0, 2, "a", 6), (1, 1, "a", 3)]
    assert gather() == [(0, 1, "a", 6), (0, 2, "a", 6), (1, 1, "a", 3)]
    assert read == [2, 2, 0]  # earlier files are not read again
    assert sorted((r["rank"], r.batch, r.id, r.margin_a) for r in runs.judge_calls(spark, f"{tmp_path}/rank*/calls/batch_*/*/result.json").collect()) == gather()
