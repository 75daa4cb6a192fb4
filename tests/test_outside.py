"""An outside judge: strict answers, budgets, redaction, and no request asked twice."""

import gzip
import json
import os
import signal
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillmark.functions.protocol import allowed_citations, evidence, pair_payload
from quillmark.operators import outside, pairs
from quillmark.plans import demo

# Workers do not import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
DIM = {"status": "scored", "score": 3, "reason": "r", "evidence_ids": ["E1"]}


def reply(payload, **changes):
    """A chat body: the longer candidate wins."""
    p = json.loads(payload)
    a, b = len(p["candidate_A"]), len(p["candidate_B"])
    said = {"protocol": "style-pairwise", "winner": "A" if a > b else "B" if a < b else "tie", "scores": {s: {d: DIM for d in "PRN"} for s in "AB"}, "reason": "length", "preference_evidence_ids": ["E1"]} | changes
    return json.dumps({"choices": [{"message": {"content": json.dumps(said)}}]})


def pending(spark, n):
    rows = [(i % 2, 0, f"{i:064x}", "a", "s", "x", "y", "long" * (i % 5 + 1), "text" * (i % 3 + 1)) for i in range(n)]
    return spark.createDataFrame(rows, "batch long, rank long, key string, character string, situation string, speaker string, line string, shown_a string, shown_b string")


C = F.col
ITEMS = lambda: evidence(demo.RULES, C("character"), C("situation"), C("speaker"), C("line"))
PAYLOAD = lambda: pair_payload(demo.RULES, C("character"), ITEMS(), C("shown_a"), C("shown_b"))


def judge_of(client, tmp_path, **limits):
    return outside.outside_judge(PAYLOAD(), allowed_citations(ITEMS()), client, f"file://{tmp_path}/record", buckets=4, **limits)


def test_a_killed_judge_asks_each_key_once(spark, tmp_path):
    log, fuse = str(tmp_path / "log"), str(tmp_path / "fuse")

    def client(payload):
        with open(log, "ab") as f:
            f.write(b"x\n")
            asked = f.tell() // 2
        if asked == 14 and not os.path.exists(fuse):
            open(fuse, "w").close()
            os.truncate(log, os.path.getsize(log) - 2)  # this one was not answered
            os.kill(os.getpid(), signal.SIGKILL)
        return 200, reply(payload), None

    rows = pending(spark, 40)
    rows = rows.union(rows.limit(5).withColumn("batch", F.lit(7).cast("long")))  # the same requests in another batch
    judge = judge_of(client, tmp_path)
    with pytest.raises(Exception):
        judge(rows.repartition(1)).collect()
    assert os.path.exists(fuse)
    for _ in range(2):
        calls = judge(rows).collect()
        assert len(calls) == 45 and {r.status for r in calls} == {"ok"}
        assert os.path.getsize(log) // 2 == 40
    want = {r.key: "A" if len(r.shown_a) > len(r.shown_b) else "B" if len(r.shown_a) < len(r.shown_b) else "tie" for r in rows.collect()}
    assert all(r.winner == want[r.key] and (r.a_p, r.b_n) == (3, 3) for r in calls)
    held = outside.recorded(spark, f"{tmp_path}/record").collect()
    assert len(held) == 40 and {r.attempts for r in held} == {1}
    # The calls serve as a judge's: outcomes come from them.
    asked = pending(spark, 40).select("batch", "rank", F.monotonically_increasing_id().alias("row_id"), "key", F.lit(False).alias("reverse"))
    assert pairs.outcomes(asked, judge(pending(spark, 40))).count() == 40


def test_faults_budgets_and_redaction(spark, tmp_path):
    def client(payload):
        n = len(json.loads(payload)["candidate_A"]) // 4
        return {1: (503, None, None), 2: (None, None, "timeout"), 3: (401, "the key s3cret is wrong", None), 4: (200, reply(payload, winner="C", reason="s3cret"), None), 5: (200, reply(payload), None)}[n]

    rows = pending(spark, 10)
    calls = {r.key: r for r in judge_of(client, tmp_path, secret="s3cret", attempts=2)(rows).collect()}
    kinds = {k: (r.status, r.attempts, r.transient) for k, r in calls.items()}
    want = [("inference_error", 2, True), ("inference_error", 2, True), ("inference_error", 1, False), ("parse_error", 1, False), ("ok", 1, False)]
    assert kinds == {f"{i:064x}": want[i % 5] for i in range(10)}
    assert all("s3cret" not in str(r) for r in outside.recorded(spark, f"{tmp_path}/record").collect())
    assert calls[f"{3:064x}"].error == "Invalid judge version/winner"
    # A budget a bucket, which a second run does not renew; more budget asks for what is left.
    asked = []
    for budget, total in ((1, 1), (1, 1), (3, 3), (100, 10)):
        calls = outside.outside_judge(PAYLOAD(), allowed_citations(ITEMS()), lambda p: (200, reply(p), None), f"file://{tmp_path}/small", buckets=1, budget=budget, every=2)(rows).collect()
        assert sum(r.status == "ok" for r in calls) == total and len(calls) == 10
        assert {r.error for r in calls if r.status != "ok"} <= {"budget exhausted"}
    calls = outside.outside_judge(PAYLOAD(), allowed_citations(ITEMS()), lambda p: asked.append(p), f"file://{tmp_path}/tiny", buckets=1, most_bytes=10)(rows).collect()
    assert {(r.status, r.error, r.attempts) for r in calls} == {("inference_error", "input budget exceeded", 0)}
    assert judge_of(client, tmp_path)(rows.limit(0)).count() == 0


def test_an_answer_is_parsed_twice_at_most(spark, tmp_path):
    calls = judge_of(lambda p: (200, reply(p), None), tmp_path)(pending(spark, 4))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = calls._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert 1 <= plan.count("parseJson(") <= 2


def test_records_are_compressed_and_plain_ones_are_read(spark, tmp_path):
    said = lambda p: (200, reply(p), None)
    judge = outside.outside_judge(PAYLOAD(), allowed_citations(ITEMS()), said, f"file://{tmp_path}/record", buckets=1, every=100)
    assert {r.status for r in judge(pending(spark, 40)).collect()} == {"ok"}
    files = list((tmp_path / "record/bucket=0").glob("*.json*"))
    bodies = sum(len(r.body) for r in outside.recorded(spark, f"{tmp_path}/record").collect())
    assert [f.suffixes for f in files] == [[".json", ".gz"]] and files[0].stat().st_size < bodies / 5
    files[0].with_suffix("").write_bytes(gzip.decompress(files[0].read_bytes()))
    files[0].unlink()
    again = outside.outside_judge(PAYLOAD(), allowed_citations(ITEMS()), lambda p: (500, None, None), f"file://{tmp_path}/record", buckets=1)
    assert {r.status for r in again(pending(spark, 40)).collect()} == {"ok"}
    assert outside.recorded(spark, f"{tmp_path}/record").count() == 40
