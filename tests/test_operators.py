"""Group reward, integrity, sources and streaming."""

import json
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quillmark.functions.lexicon import STYLE_RULES, persona_identity
from quillmark.operators import evaluation, integrity, labels, pairs, prefix, reward, stats
from quillmark.sources import config, frozen, runs

SAMPLE = "row_id long, batch long, rank long, pos long, grp long, character string, situation string, speaker string, line string, reply string, base string, prompt_id long"


def samples(spark, replies, base="是。", size=4, rank=lambda i: 0):
    rows = [(i, 0, rank(i), i, i // size, "rei", "s", "x", "y", r, base, i // size) for i, r in enumerate(replies)]
    return spark.createDataFrame(rows, SAMPLE)


def scripted(ab, ba):
    """The winner as displayed, by order; the reversed request shows the base first."""
    return pairs.scripted_judge(ab, ba, F.col("shown_a") == "是。")


@pytest.mark.parametrize(("ab", "ba", "want"), [("A", "B", (0.166667, 1.0, False)), ("B", "A", (-0.166667, 0.0, False)), ("tie", "tie", (0.0, 0.5, False)), ("A", "A", (0.0, 0.5, True)), ("tie", "B", (0.083333, 0.5, True))])
def test_pair_outcome(spark, ab, ba, want):
    j, _ = pairs.judged(samples(spark, ["走。"]), STYLE_RULES, scripted(ab, ba))
    r = j.first()
    assert (r.margin, r.verdict, r.order_inconsistent) == want


def test_batch_values_calls_and_reuse(spark):
    j, asked = pairs.judged(samples(spark, ["走。", "走。", "a\nb", "「是。」"]), STYLE_RULES, scripted("A", "B"))
    decided = reward.groups(j)
    got = {r.row_id: r.reward for r in reward.rewards(j, decided).collect()}
    assert got == {0: 0.166667, 1: 0.166667, 2: -1.0, 3: 0.0}
    m = reward.batch_metrics(j, asked, decided, STYLE_RULES).first()
    assert (m.judge_calls, m.reused_requests, m.rejected_groups, m.varied_groups, m.hard) == (2, 2, 0, 1, 1)


def test_a_failure_rejects_its_group_across_ranks(spark):
    rows = samples(spark, ["走。"] * 5 + ["坏。"] + ["走。"] * 6, rank=lambda i: i // 6)

    def judge(pending):
        calls = scripted("A", "B")(pending)
        bad = pending.filter("shown_a = '坏。' or shown_b = '坏。'").select("key", F.lit(True).alias("bad")).distinct()
        out = calls.join(bad, "key", "left")
        return out.withColumn("status", F.when(F.col("bad"), "parse_error").otherwise(F.col("status"))).select(*calls.columns)

    j, _ = pairs.judged(rows, STYLE_RULES, judge)
    decided = reward.groups(j)
    assert {r.grp: (r.rejected, r.reason) for r in decided.collect()} == {0: (False, None), 1: (True, "AB parse_error"), 2: (False, None)}
    got = reward.rewards(j, decided)
    assert {r.row_id for r in got.filter("reward is null").collect()} == {4, 5, 6, 7}
    ranks = spark.createDataFrame([(0, 0, 0, 6), (0, 1, 6, 6)], "batch long, rank long, row_offset long, rows long")
    spans = reward.mask_spans(ranks, decided.withColumn("index", F.col("grp")), 4)
    assert {(r["rank"], r.start, r.end) for r in spans.collect()} == {(0, 4, 6), (1, 0, 2)}


def test_layout_errors(spark):
    rows = samples(spark, ["a"] * 7)
    assert [r.grp for r in reward.layout_errors(rows, 4).collect()] == [1]


def test_running_and_streaks(spark):
    flags = [1, 1, 0, 1, 1, 1, 1, 0, 1]
    m = spark.createDataFrame([(i, 4 * f, 4) for i, f in enumerate(flags)], "batch long, rejected_groups long, groups long")
    got = [(r.streak, r.abort) for r in reward.rejected_streaks(m).orderBy("batch").collect()]
    assert got == [(1, False), (2, False), (0, False), (1, False), (2, False), (3, True), (4, True), (0, False), (1, False)]
    out = prefix.running(m, "batch", {"s": "groups"}, {"x": "rejected_groups"}, width=2).orderBy("batch").collect()
    assert [r.s for r in out] == [4 * (i + 1) for i in range(9)] and out[-1].x == 4


def test_checkpoints(spark):
    states = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)], "step int, rank int")
    assert reward.latest_complete(states, 2).first().step == 2
    assert reward.latest_complete(states, 3).first().step is None


def test_agreement_of_a_constant_judge_is_null(spark):
    rows = spark.createDataFrame([(1, 0.0), (-1, 0.0), (0, 0.0)], "human int, judge double")
    r = labels.agreement(rows).first()
    assert (r.pairs, r.exact_three_way, r.decisive, r.decisive_rate, r.pearson) == (3, 1, 0, None, None)
    assert labels.gate(labels.agreement(rows)).first().passed is False


def test_bands_are_half_open(spark):
    rows = spark.createDataFrame([(x,) for x in (-3.1, -3.0, -0.5, 0.49, 0.5, 3.0)], "m double")
    assert [r[0] for r in rows.select(labels.band(F.col("m"))).collect()] == [0, 1, 2, 2, 3, 4]


def suite(tmp_path):
    row = {"id": "T1-L1-rei", "template": "T1", "character": "rei", "situation": "s", "speaker": "x", "line": "y"}
    other = {**row, "id": "T2-L1-asuka", "template": "T2", "character": "asuka"}
    files = {}
    for name, rows in (("train", [row]), ("test", [other])):
        raw = json.dumps(rows, ensure_ascii=False).encode()
        (tmp_path / f"{name}.json").write_bytes(raw)
        files[f"{name}.json"] = sha256(raw).hexdigest()
    (tmp_path / "freeze.json").write_text(json.dumps({"files": files, "persona_sha256": persona_identity(STYLE_RULES)}))
    return tmp_path


def test_frozen_suite_loads_and_one_more_byte_is_refused(spark, tmp_path):
    folder = suite(tmp_path)
    rows = frozen.load_suite(spark, str(folder), STYLE_RULES)
    assert {(r.id, r.split) for r in rows.collect()} == {("T1-L1-rei", "train"), ("T2-L1-asuka", "test")}
    assert frozen.select_character(rows, STYLE_RULES, "rei").count() == 1
    with pytest.raises(ValueError, match="unknown character"):
        frozen.select_character(rows, STYLE_RULES, "who")
    (folder / "test.json").write_bytes((folder / "test.json").read_bytes() + b"\n")
    with pytest.raises(ValueError, match="changed"):
        frozen.load_suite(spark, str(folder), STYLE_RULES)


def test_base_replies_must_cover_the_suite(spark, tmp_path):
    folder = suite(tmp_path)
    rows = frozen.load_suite(spark, str(folder), STYLE_RULES)
    base = tmp_path / "base"
    base.mkdir()

    def freeze(replies):
        raw = json.dumps(replies).encode()
        (base / "replies.json").write_bytes(raw)
        (base / "freeze.json").write_text(json.dumps({"replies_sha256": sha256(raw).hexdigest(), "suite_freeze_sha256": sha256((folder / "freeze.json").read_bytes()).hexdigest()}))

    freeze({"T1-L1-rei": "a", "T2-L1-asuka": "b"})
    assert frozen.load_base_replies(spark, str(base), str(folder), rows).count() == 2
    freeze({"T1-L1-rei": "a", "T2-L1-asuka": 5})
    with pytest.raises(ValueError, match="not a text"):
        frozen.load_base_replies(spark, str(base), str(folder), rows)
    freeze({"T1-L1-rei": "a", "other": "b"})
    with pytest.raises(ValueError, match="without"):
        frozen.load_base_replies(spark, str(base), str(folder), rows)


def test_build_suite_ids(spark):
    t = spark.createDataFrame([("T1", "s", "x", ["a", "b"]), ("T2", "s", "x", ["c"])], "template string, situation string, speaker string, lines array<string>")
    got = {(r.id, r.split) for r in frozen.build_suite(t, STYLE_RULES, ["T2"]).collect()}
    assert got == {("T1-L1-rei", "train"), ("T1-L1-asuka", "train"), ("T1-L2-rei", "train"), ("T1-L2-asuka", "train"), ("T2-L1-rei", "test"), ("T2-L1-asuka", "test")}


def test_reward_records_and_calls(spark, tmp_path):
    at = tmp_path / "rank1"
    at.mkdir()
    sample = {"row_id": "r", "reply": "x", "hard": None, "style": 0.5, "keys": {"AB": "a" * 64, "BA": "b" * 64}, "verdict": 1.0, "margin": 0.1}
    (at / "rewards_00003.json").write_text(json.dumps({"rejected_groups": [1], "row_offset": 6, "samples": [sample] * 4}))
    got = runs.reward_samples(spark, str(tmp_path / "rank*" / "rewards_*.json"), 8).orderBy("pos").collect()
    assert [(r["rank"], r.serial, r.grp, r.rejected) for r in got] == [(1, 3, 0, False), (1, 3, 0, False), (1, 3, 1, True), (1, 3, 1, True)]
    dim = lambda n: {"status": "scored", "score": n, "reason": "", "evidence_ids": []}
    for key, a, b in (("a", 4, 2), ("b", 1, 3)):
        call = at / "calls" / "batch_00003" / (key * 16)
        call.mkdir(parents=True)
        scores = {"A": {d: dim(a) for d in "PRN"}, "B": {d: dim(b) for d in "PRN"}}
        (call / "result.json").write_text(json.dumps({"id": key * 16, "final": {"call_status": "ok", "judgement": {"winner": "A", "scores": scores}}}))
    calls = runs.judge_calls(spark, str(tmp_path / "rank*" / "calls" / "batch_*" / "*" / "result.json"))
    found = runs.usable_margins(runs.reward_samples(spark, str(tmp_path / "rank*" / "rewards_*.json")), calls).collect()
    assert [r.margin for r in found] == [6.0, 6.0]


def test_label_page_round_trip(spark, tmp_path):
    item = ("q001", "n", "c", "s", "x", "</script> y", "left", "right")
    items = spark.createDataFrame([item], "id string, name string, card string, situation string, speaker string, line string, left string, right string")
    html = runs.render_page(items, "set", "<script>\nconst DATA = /*LABEL_DATA*/null;\n</script>\n")
    assert "</script> y" not in html
    (tmp_path / "label.html").write_text(html)
    assert [tuple(r) for r in runs.page_items(spark, str(tmp_path / "label.html")).collect()] == [item]


def test_labelled_items(spark):
    key = spark.createDataFrame([("q1", "test", "r", "base", "policy"), ("q2", "opener", "r", "opener", "no_opener")], "id string, kind string, row_id string, left string, right string")
    items = spark.createDataFrame([("q1", "B", "P"), ("q2", "O", "N")], "id string, left string, right string")
    chosen = spark.createDataFrame([("q1", "L2")], "id string, choice string")
    rows = spark.createDataFrame([("r", "rei")], "id string, character string")
    got = {r.id: (r.first, r.second, r.human) for r in labels.labelled_items(key, items, chosen, rows).collect()}
    assert got == {"q1": ("P", "B", -2), "q2": ("O", "N", None)}
    assert labels.uncovered(key, items).count() == 0 and labels.uncovered(key, items.limit(1)).count() == 1


def test_counterparts(spark):
    rows = spark.createDataFrame([("T-L1-rei", "rei"), ("T-L1-asuka", "asuka"), ("U-L1-rei", "rei")], "id string, character string")
    replies = spark.createDataFrame([("T-L1-rei", "a"), ("T-L1-asuka", " "), ("U-L1-rei", "b")], "row_id string, reply string")
    got = evaluation.counterparts(rows, replies).collect()
    assert {(r.id, r.other_reply, r.status) for r in got} == {("T-L1-rei", " ", "empty"), ("T-L1-asuka", "a", "empty")}


def test_overflow_steps(spark):
    log = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, float("inf"))], "step int, grad_norm double")
    assert [r.step for r in stats.overflow_steps(log).collect()] == [2, 3]


def test_settings():
    assert settings_of("# c\nA = 'x y'\nB=2\n") == {"A": "x y", "B": "2"}
    assert config.settings("A=1", ("A",), {"A": "9", "Z": "0"}) == {"A": "9"}
    assert settings_of("\ufeff\n  # c\nA=\"it's\"\nB = x#y ") == {"A": "it's", "B": "x#y"}
    for bad in ("C=1", "A=1\nA=2", "novalue", "A='open", 'A="', "a=1", "=1", "A='x' y"):
        with pytest.raises(ValueError):
            settings_of(bad)


def settings_of(text):
    return config.settings(text, ("A", "B"), {})


def test_settings_file(tmp_path):
    (tmp_path / "env").write_text("A=1\n")
    assert config.settings_file(str(tmp_path / "env"), ("A",), {}) == {"A": "1"} and config.settings_file(None, ("A",), {"A": "2"}) == {"A": "2"}
    with pytest.raises(FileNotFoundError):
        config.settings_file(str(tmp_path / "none"), ("A",), {})


def test_a_suite_frozen_elsewhere_names_its_own_identity(spark, tmp_path):
    folder = suite(tmp_path)
    held = json.loads((folder / "freeze.json").read_text())
    (folder / "freeze.json").write_text(json.dumps({**held, "persona_sha256": "f" * 64}))
    with pytest.raises(ValueError, match="persona"):
        frozen.load_suite(spark, str(folder), STYLE_RULES)
    assert frozen.load_suite(spark, str(folder), STYLE_RULES, "f" * 64).count() == 2


def test_canon(spark, tmp_path):
    entry = {"episode": "e1", "context": "c", "line": "l"}

    def freeze(held):
        raw = json.dumps(held).encode()
        (tmp_path / "canon.json").write_bytes(raw)
        (tmp_path / "freeze.json").write_text(json.dumps({"canon_sha256": sha256(raw).hexdigest()}))
        return sha256(raw).hexdigest()

    digest = freeze({"rei": [entry, {**entry, "line": "m"}], "asuka": [entry]})
    got = frozen.load_canon(spark, str(tmp_path), STYLE_RULES).collect()
    assert {(r.character, r.position, r.line) for r in got} == {("rei", 0, "l"), ("rei", 1, "m"), ("asuka", 0, "l")}
    assert frozen.canon_identity(spark, str(tmp_path / "canon.json")) == digest and frozen.canon_identity(spark, None) is None
    for bad, why in (({"rei": [entry]}, "characters"), ({"rei": [{**entry, "line": " "}], "asuka": [entry]}, "empty field")):
        freeze(bad)
        with pytest.raises(ValueError, match=why):
            frozen.load_canon(spark, str(tmp_path), STYLE_RULES)


def test_documents_and_freezes_are_written_once_and_read_back(spark, tmp_path):
    frozen.write_document(spark, {"b": [1, "é"], "a": None}, str(tmp_path / "doc"))
    assert frozen.read_document(spark, str(tmp_path / "doc")) == {"a": None, "b": [1, "é"]}
    with pytest.raises(Exception, match="already exists"):
        frozen.write_document(spark, {}, str(tmp_path / "doc"))
    (tmp_path / "x.json").write_text("[1]")
    made = frozen.write_freeze(spark, str(tmp_path / "x.json"), str(tmp_path / "freeze"), seed=3)
    assert made == {"files": {"x.json": sha256(b"[1]").hexdigest()}, "seed": 3} == frozen.read_document(spark, str(tmp_path / "freeze"))


def test_answer_key_and_run_records(spark, tmp_path):
    key = [("q001", "test", "r1", "base", "policy", 1.0, 2.5), ("q002", "opener", "r2", "opener", "no_opener", None, None)]
    rows = spark.createDataFrame(key, "id string, kind string, row_id string, left string, right string, v3_pairwise double, v3_margin double")
    runs.write_answer_key(rows, "set", str(tmp_path / "key"))
    assert sorted(tuple(r) for r in runs.answer_key(spark, str(tmp_path / "key")).collect()) == key
    runs.append_record(spark, "r1", "manifest", {"lr": "1", "world_size": "2"}, str(tmp_path / "log"))
    runs.append_record(spark, "r1", "resume", {"step": 3}, str(tmp_path / "log"))
    assert runs.records(spark, str(tmp_path / "log")).count() == 2
    found = runs.manifest_rows(runs.records(spark, str(tmp_path / "log"), "manifest"))
    assert {(r.key, r.value) for r in found.collect()} == {("lr", "1"), ("world_size", "2")}


def test_checkpoints_may_not_hold_unrecorded_pickles(spark):
    found = spark.createDataFrame([("a.json", "1"), ("new.txt", "2"), ("new.pt", "3"), ("b.bin", "9")], "file string, sha256 string")
    recorded = spark.createDataFrame([("a.json", "1"), ("b.bin", "4"), ("gone.bin", "5")], "file string, sha256 string")
    got = {(r.file, r.problem) for r in integrity.checkpoint_drift(found, recorded).collect()}
    assert got == {("new.pt", "unrecorded"), ("b.bin", "changed"), ("gone.bin", "missing")}


def test_retries_record_attempts_and_keep_to_their_budget(spark):
    asked = pairs.requests(pairs.score_samples(samples(spark, ["走。", "坏。", "好。"]), STYLE_RULES))
    pending = pairs.pending(asked)
    text = F.concat("shown_a", "shown_b")

    def judge(rows, attempt):
        calls = pairs.stub_judge(rows)
        bad = rows.select("key", (F.contains(text, F.lit("坏")) if attempt > 1 else F.contains(text, F.lit("坏")) | F.contains(text, F.lit("好"))).alias("bad"))
        return calls.join(bad, "key").withColumn("status", F.when(F.col("bad"), "parse_error").otherwise(F.col("status"))).select(*calls.columns)

    got = pairs.retried(judge)(pending).join(pending.select("key", text.alias("text")), "key").collect()
    want = {"走": ["ok"], "坏": ["parse_error", "parse_error"], "好": ["parse_error", "ok"]}
    assert len(got) == 6
    for r in got:
        tries = want[next(w for w in want if w in r.text)]
        assert [a.status for a in r.attempts] == tries and r.status == tries[-1]
    for budget in (0, 4, 6, 8):
        rows = pairs.retried(judge, 1, budget)(pending).collect()
        spent = sum(len(r.attempts or []) for r in rows)
        assert len(rows) == 6 and spent == min(budget, 10)
        assert sum(r.status == "inference_error" for r in rows) == max(0, 6 - budget)
    assert all(len(r.attempts) == 1 for r in pairs.retried(judge, 0)(pending).collect())
    with pytest.raises(ValueError):
        pairs.retried(judge, 2)


def test_label_sets_of_several_kinds_repeat_no_pair(spark):
    rows = spark.createDataFrame([(i, f"r{i}", i % 3) for i in range(30)] + [(0, "r0", 0)], "row_id long, reply string, more int")
    got = labels.label_set([("test", rows, 10), ("train", rows.drop("more"), 15), ("opener", rows, 15)], "s")
    assert {r.kind: r.n for r in labels.kind_counts(got).collect()} == {"test": 10, "train": 15, "opener": 5}
    assert got.select("row_id", "reply").distinct().count() == 30


def test_probe_reasons_and_base_violations(spark):
    cases = [("ok", None, False), ("ok", None, True), ("unusable", "AB parse_error", None), ("identical", None, None), ("empty", None, None)]
    judged = spark.createDataFrame(cases, "status string, unusable string, order_inconsistent boolean")
    got = {r.reason: r.n for r in evaluation.order_probe_reasons(judged).collect()}
    assert got == {"order_inconsistent": 1, "AB parse_error": 1, "skipped identical": 1, "skipped empty": 1}
    rows = spark.createDataFrame([("rei", "好。"), ("rei", "a\nb"), ("asuka", "x" * 90)], "character string, reply string")
    assert {r.reason: r.n for r in evaluation.base_violations(rows, STYLE_RULES).collect()} == {"multi_line": 1, "length": 1}
    with pytest.raises(Exception, match="empty base reply"):
        evaluation.base_violations(rows.union(spark.createDataFrame([("rei", " ")], rows.schema)), STYLE_RULES).collect()


def test_manifest_drift(spark):
    old = spark.createDataFrame([("lr", "1"), ("endpoint", "x")], "key string, value string")
    new = spark.createDataFrame([("lr", "2"), ("endpoint", "y"), ("world_size", "1")], "key string, value string")
    assert [r.key for r in integrity.manifest_drift(old, new).collect()] == ["lr"]


def test_digests_of_files_of_any_size(spark, tmp_path, monkeypatch):
    """Over 2 GB, mostly a hole; files around the limit and the block; an empty one; several large ones at once."""
    (tmp_path / "d").mkdir()
    sizes = {"empty": 0, "one": 1, "limit": 1000, "over": 1001, "blocks": 4096, "odd name ü 5%20.bin": 4097}
    want = {}
    for k, (name, size) in enumerate(sizes.items()):
        body = bytes((i * 7 + k) % 251 for i in range(size))
        (tmp_path / "d" / name).write_bytes(body)
        want[name] = sha256(body).hexdigest()
    monkeypatch.setattr(integrity, "BLOCK", 1024)
    got = {r.file: r.sha256 for r in integrity.digests(spark, str(tmp_path / "d"), large=1000).collect()}
    assert got == want
    monkeypatch.setattr(integrity, "BLOCK", 4 << 20)
    big, size = tmp_path / "big.pt", (2 << 30) + 12345
    with big.open("wb") as f:
        f.write(b"head")
        f.seek(size - 4)
        f.write(b"tail")
    running = sha256(b"head")
    zeros = bytes(1 << 24)
    left = size - 8
    while left:
        running.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    running.update(b"tail")
    assert [tuple(r) for r in integrity.digests(spark, str(big)).collect()] == [("big.pt", running.hexdigest())]


def test_quota_picks_limit_each_key_before_the_shuffle(spark):
    rows = spark.range(4000).selectExpr("id as row_id", "if(id % 3 = 0, 'a', 'b') as character", "cast(id as string) as reply", "(id % 100 - 50) / 8.0 as margin", "id % 7 = 0 as opener", "id div 40 as batch", "id div 8 as grp")
    for df in (labels.pick_bands(rows, 34, "s"), labels.opener_pairs(rows, 11, "a", "s")):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    got = labels.pick_bands(rows, 34, "s").groupBy("character", "band").count().collect()
    assert all(r["count"] == 3 + (r.band < 2) for r in got) and len(got) == 10
    assert {r.character: r["count"] for r in labels.opener_pairs(rows, 11, "a", "s").groupBy("character").count().collect()} == {"a": 6, "b": 5}


def test_a_replayed_part_leaves_one_copy(spark, tmp_path):
    schema = "run string, serial long, row_id long, value double, keys map<string,string>"
    rows = lambda serial, v: spark.createDataFrame([("r", serial, i, v, {"AB": "x"}) for i in range(3)], schema)
    path = str(tmp_path / "rewards")
    for serial, v in ((1, 0.5), (2, 0.25), (1, 0.5), (2, 0.25)):
        runs.replay_rewards(rows(serial, v), path)
    held = spark.read.schema(schema).parquet(path)
    assert sorted((r.serial, r.row_id, r.value) for r in held.collect()) == [(s, i, v) for s, v in ((1, 0.5), (2, 0.25)) for i in range(3)]
    assert runs.next_serial(held) == 3
    with pytest.raises(ValueError, match="serial 2 of run r holds other records"):
        runs.replay_rewards(rows(2, 0.75), path)
    with pytest.raises(ValueError, match="serial 1"):
        runs.replay_rewards(rows(1, 0.5).union(rows(1, 0.5)), path)
    calls = spark.createDataFrame([("r", 1, "k", [("ok",)])], "run string, batch long, key string, attempts array<struct<status:string>>")
    for _ in range(2):
        runs.write_calls(calls, str(tmp_path / "calls"))
    runs.write_calls(calls.withColumn("batch", F.lit(2).cast("long")), str(tmp_path / "calls"))
    assert spark.read.parquet(str(tmp_path / "calls")).count() == 2


def test_rank_digests_find_one_altered_row(spark):
    rows = [(g, r, f"t{i}", i / 8, None if i % 5 else i) for g in range(3) for r in range(2) for i in range(50)]
    schema = "step int, rank int, name string, value double, extra int"
    df = spark.createDataFrame(rows, schema)
    agree = lambda d: {r.step: (r.ranks, r.agree) for r in integrity.rank_agreement(d, ["step"], "rank", ["name", "value", "extra"]).collect()}
    assert agree(df.repartition(7)) == {g: (2, True) for g in range(3)}
    altered = [(g, r, n, v + (1e-9 if (g, r, n) == (1, 1, "t7") else 0), x) for g, r, n, v, x in rows]
    assert agree(spark.createDataFrame(altered, schema)) == {0: (2, True), 1: (2, False), 2: (2, True)}
    # One row twice, another missing: the same number of rows.
    moved = [(g, r, "t8" if (g, r, n) == (2, 0, "t7") else n, 1.0 if (g, r, n) == (2, 0, "t7") else v, x) for g, r, n, v, x in rows]
    assert agree(spark.createDataFrame(moved, schema))[2] == (2, False)

