"""Rule engine, protocol and strict parsing, case by case."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.functions import protocol, rules, strict_json
from quillmark.functions.lexicon import STYLE_RULES
from quillmark.operators import integrity, stats
from quillmark.sources import runs


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("x"))).collect()]


def test_clean_reply(spark):
    cases = {
        "「知道了。」": "知道了。",
        "<think>\n\n</think>\n\n「是。」": "是。",
        " \n　走吧\t": "走吧",
        "他说「走」。": "他说「走」。",
        "「走」「留」": "「走」「留」",
        "「」": "「」",
        "<think>想</think>好": "<think>想</think>好",
        "「 嗯 」": "嗯",
    }
    assert column(spark, list(cases), rules.clean_reply) == list(cases.values())


def test_marker_text(spark):
    assert column(spark, ["嗯...", "嗯……", "嗯…", "a..b", "......"], rules.marker_text) == ["嗯……", "嗯……", "嗯……", "a..b", "……"]


def test_hard_violation(spark):
    cases = [
        ("rei", "知道了。", None),
        ("rei", "", "length"),
        ("rei", "字" * 81, "length"),
        ("rei", "字" * 80, None),
        ("rei", "走。\n停。", "multi_line"),
        ("rei", "作为AI，我不能回答。", "out_of_character"),
        ("rei", "本小姐才不去。", "impersonation"),
        ("rei", "我是明日香。", "impersonation"),
        ("asuka", "本小姐来也。", None),
        ("asuka", "凌波丽：是。", "speaker_prefix"),
        ("rei", "有件事：明天。", None),
        ("rei", "嗯嗯嗯", "catchphrase_cap"),
        ("asuka", "哼哼笨蛋笨蛋才不", "catchphrase_cap"),
        ("nobody", "知道了。", None),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c string, x string, want string")
    got = rows.select("x", "want", rules.hard_violation(STYLE_RULES, F.col("x"), F.col("c")).alias("got")).collect()
    assert [(r.x, r.got) for r in got] == [(r.x, r.want) for r in got]


def test_style_score(spark):
    score = lambda c: lambda x: rules.style_score(STYLE_RULES, x, F.lit(c))
    assert column(spark, ["嗯……不知道。", "知道了。", "笨蛋！", "字" * 50, "字" * 35], score("rei")) == [1.0, 0.6, 0.3, 0.3, 0.45]
    assert column(spark, ["哼，笨蛋，才不是那样呢", "哼", "哼……"], score("asuka")) == [1.0, 0.65, 0.35]
    a, b, c = column(spark, ["嗯...", "嗯……", "嗯…"], score("rei"))
    assert a == b == c


def test_rule_metrics_of_nothing_are_null(spark):
    empty = spark.createDataFrame([], "reply string, character string, hard string, style double")
    m = empty.agg(*rules.rule_metrics(STYLE_RULES, *(F.col(c) for c in ("reply", "character", "hard", "style")))).first()
    assert m.samples == 0 and m.hard_violation_rate is None and m.length_mean is None


DIM = {"status": "scored", "score": 3, "reason": "r", "evidence_ids": ["E1"]}


def response(**change):
    body = {"protocol": "style-pairwise", "winner": "A", "scores": {s: {d: dict(DIM) for d in "PRN"} for s in "AB"}, "reason": "why", "preference_evidence_ids": ["E1"]}
    return {**body, **change}


def dim(**change):
    r = response()
    r["scores"]["B"]["N"] = {**DIM, **change}
    return json.dumps(r)


CASES = [
    (json.dumps(response()), None),
    (json.dumps(response(winner="tie", preference_evidence_ids=[])), None),
    ("not json", "Invalid JSON"),
    (json.dumps(response()) + " 1", "Invalid JSON"),
    (json.dumps(response()) + ",1", "Invalid JSON"),
    ("[]", "Unexpected judge fields"),
    (json.dumps(response(extra=1)), "Unexpected judge fields"),
    (json.dumps(response(winner="C")), "Invalid judge version/winner"),
    (json.dumps(response(protocol="x")), "Invalid judge version/winner"),
    (json.dumps(response(reason=" ")), "Missing pairwise reason"),
    (json.dumps(response(scores={"A": {}})), "Both candidates required"),
    (json.dumps(response(preference_evidence_ids=["E9"])), "Unknown evidence citation"),
    (json.dumps(response(preference_evidence_ids=[])), "Strict preference needs evidence citation"),
    (json.dumps(response(scores={"A": {"P": DIM}, "B": {}})), "Three dimensions required"),
    (dim(more=1), "Invalid dimension schema"),
    (dim(status="maybe"), "Invalid dimension status"),
    (dim(score=5), "Score must be integer in 0..4"),
    (dim(score=3.0), "Score must be integer in 0..4"),
    (dim(score=True), "Score must be integer in 0..4"),
    (dim(score="3"), "Score must be integer in 0..4"),
    (dim(status="insufficient"), "Non-scored dimension must be null"),
    (dim(status="insufficient", score=None), None),
    (dim(reason=""), "Missing dimension reason"),
    (dim(evidence_ids=["x"]), "Unknown evidence citation"),
    (dim(evidence_ids=[]), "Dimension needs evidence citation"),
    (json.dumps(response()).replace('"score": 3', '"score": 3, "score": 3', 1), "Invalid JSON"),
]


def test_pair_response_errors(spark):
    allowed = F.array(*(F.lit(x) for x in ("E1", "E2", "E3", "candidate:A", "candidate:B")))
    assert column(spark, [c for c, _ in CASES], lambda x: strict_json.pair_error(x, allowed)) == [e for _, e in CASES]


def test_a_response_is_parsed_once(spark):
    """However many rules name it; a text that looks like an object is none."""
    allowed = F.array(F.lit("E1"))
    as_text = json.dumps(response(scores=json.dumps({"A": 1, "B": 2})))
    df = spark.createDataFrame([(json.dumps(response()),), (as_text,)], "raw string").select(strict_json.pair_error(F.col("raw"), allowed).alias("error"), strict_json.pair_scores(F.col("raw")).alias("s"))
    assert [r.error for r in df.collect()] == [None, "Both candidates required"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("parseJson(") <= 2 and "get_json_object" not in plan  # one for the errors, one for the scores


def test_attribution_errors(spark):
    good = {"protocol": "style-attribution", "speaker": "rei", "reason": "r"}
    cases = [(good, None), ({**good, "x": 1}, "Unexpected attribution fields"), ({**good, "speaker": "who"}, "Invalid attribution version/speaker"), ({**good, "reason": ""}, "Missing attribution reason")]
    assert column(spark, [json.dumps(c) for c, _ in cases], lambda x: strict_json.attribution_error(x, ("rei", "asuka", "neither"))) == [e for _, e in cases]


def test_requests_hide_the_mapping_and_refuse_blank_candidates(spark):
    lit = F.lit
    items = protocol.evidence(STYLE_RULES, lit("rei"), lit("room"), lit("x"), lit("hello"))
    a, b = protocol.displayed(lit("new"), lit("old"), lit(True))
    body = json.loads(one(spark, protocol.pair_payload(STYLE_RULES, lit("rei"), items, a, b))[0])
    assert (body["candidate_A"], body["candidate_B"]) == ("old", "new")
    assert [e["id"] for e in body["evidence"]] == ["E1", "E2", "E3"] and "reverse" not in body
    with pytest.raises(Exception, match="nonempty"):
        one(spark, protocol.pair_payload(STYLE_RULES, lit("rei"), items, lit(" "), b))
    with pytest.raises(Exception, match="budget"):
        one(spark, protocol.within_budget(lit("漢" * 10), 29))


def test_exact_tests(spark):
    p = lambda w, l: round(one(spark, stats.binomial_two_sided(F.lit(w).cast("long"), F.lit(l).cast("long")))[0], 4)  # noqa: E731,E741
    assert [p(19, 13), p(10, 2), p(23, 9), p(0, 0), p(5, 5)] == [0.3771, 0.0386, 0.0201, 1.0, 1.0]


def test_exact_tests_of_large_counts(spark):
    def brute(w, l):  # noqa: E741
        n = w + l
        return min(1.0, 2 * math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(min(w, l) + 1)))

    p = lambda w, l: one(spark, stats.binomial_two_sided(F.lit(w).cast("long"), F.lit(l).cast("long")))[0]  # noqa: E731,E741
    for w, l in [(3409, 571), (2000, 1980), (2100, 1900), (50_000, 50_600), (100, 3)]:  # noqa: E741
        assert p(w, l) == pytest.approx(brute(w, l), rel=1e-5, abs=1e-12)
    # More terms than an array holds; by the normal distribution.
    w, l = 3_000_000_000, 3_000_100_000  # noqa: E741
    assert p(w, l) == pytest.approx(math.erfc((l - w - 1) / math.sqrt(2 * (w + l))), rel=1e-3)


def test_provider_text(spark):
    body = json.dumps({"output": [{"type": "reasoning"}, {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "a"}, {"type": "output_text", "text": "b"}]}]})
    chat = json.dumps({"choices": [{"message": {"content": "c"}}]})
    assert column(spark, [body, chat, "{}"], strict_json.provider_text) == ["ab", "c", None]


def test_status_envelope(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    none = F.lit(None).cast("string")
    got = one(spark, *(strict_json.envelope(F.lit("x"), *lit(a, b), e) for a, b, e in ((False, False, none), (False, False, F.lit("bad")), (False, True, F.lit("bad")), (True, True, F.lit("bad")))))
    assert got == ["ok", "parse_error", "incomplete_response", "inference_error"]


def test_judge_identity_redaction_and_file_names(spark):
    meta = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    ident = lambda d, kind: integrity.judge_identity(meta(d), F.lit(kind), ("model", "seed"))
    a, b, c, d = one(spark, ident({"model": "m", "seed": "1", "host": "x"}, "local"), ident({"host": "y", "seed": "1", "model": "m"}, "local"), ident({"model": "m", "seed": "1", "host": "x"}, "api_judge"), ident({"seed": "1", "host": "y", "model": "m"}, "api_judge"))
    assert a == b and len({a, c, d}) == 3
    with pytest.raises(Exception, match="incomplete"):
        one(spark, ident({"model": "m"}, "local"))
    assert one(spark, protocol.redact(F.lit("key=abc, abc"), "abc"), protocol.redact(F.lit("x"), "")) == ["key=[redacted], [redacted]", "x"]
    assert one(spark, runs.batch_name(F.lit(7)), runs.batch_name(F.lit(123456))) == ["rewards_00007", "rewards_123456"]


def test_evidence_persona_keys_and_display(spark):
    names = [p.name for p in STYLE_RULES.personas]
    assert one(spark, *(protocol.persona_key(STYLE_RULES, F.lit(n)) for n in names)) == ["rei", "asuka"]
    with pytest.raises(Exception, match="unknown persona"):
        one(spark, protocol.persona_key(STYLE_RULES, F.lit("who")))
    canon = F.array(*(F.struct(F.lit(e).alias("episode"), F.lit("c").alias("context"), F.lit(t).alias("line")) for e, t in (("e1", "l1"), ("e2", "l2"))))
    assert one(spark, protocol.render_canon(canon)) == ["e1 c: l1\ne2 c: l2"]
    args = [F.lit(x) for x in ("rei", "s", "x", "y")]
    items = one(spark, protocol.evidence(STYLE_RULES, *args), protocol.evidence(STYLE_RULES, *args, canon))
    assert [[i.id for i in e] for e in items] == [["E1", "E2", "E3"], ["E1", "E2", "E3", "E4"]] and items[1][2].text == "x：y"
    shown = [x for r in (False, True) for x in protocol.displayed(F.lit("p"), F.lit("b"), F.lit(r))]
    assert one(spark, *shown) == ["p", "b", "b", "p"]
    assert one(spark, *(protocol.mapping(F.lit(r)) for r in (False, True))) == [{"A": "A", "B": "B"}, {"A": "B", "B": "A"}]
    assert one(spark, protocol.counterpart_id(F.lit("T-1-L2-rei"), F.lit("asuka")), protocol.character_of(F.lit("T-1-L2-rei"))) == ["T-1-L2-asuka", "rei"]


def test_similarity_is_the_edit_distance_ratio(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    pairs = [("", ""), ("abc", ""), ("知道了。", "知道。"), ("kitten", "sitting"), ("é😀x", "e😀")]
    rows = spark.createDataFrame(list(enumerate(pairs)), "i int, p struct<a:string,b:string>")
    got = [r[0] for r in rows.orderBy("i").select(stats.similarity(F.col("p.a"), F.col("p.b"))).collect()]
    assert got == pytest.approx([1 - distance(a, b) / max(len(a), len(b), 1) for a, b in pairs])


def mixed(x):
    m = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def test_bootstrap_interval_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(stats, "SLICE", 7)
    data = [(i, i % 3 - 1, ((i * 7) % 11) / 10 - 0.4 + 0.3 * (i % 3)) for i in range(60)]
    rows = spark.createDataFrame([*data, (99, None, 1.0), (98, 1, None)], "key int, human int, judge double")
    hashes = {r.key: r.h for r in rows.select("key", F.xxhash64(F.lit("s"), F.col("key").cast("string")).alias("h")).collect()}
    cdf, term = [math.exp(-1)], math.exp(-1)
    for k in range(1, 11):
        term /= k
        cdf.append(cdf[-1] + term)
    assert stats.poisson_edges().tolist() == pytest.approx(cdf)
    found, taken = [], []
    for draw in range(1, 41):
        w = []
        for key, *_ in data:
            u = ((mixed((hashes[key] + draw * 0x9E3779B97F4A7C15) % (1 << 64)) >> 11) + 0.5) / 2**53
            w.append(sum(u > c for c in cdf))
        taken += w
        n = sum(w)
        mean = [sum(a * r[k] for a, r in zip(w, data)) / n for k in (1, 2)]
        cov = sum(a * (r[1] - mean[0]) * (r[2] - mean[1]) for a, r in zip(w, data))
        var = [sum(a * (r[k] - mean[k - 1]) ** 2 for a, r in zip(w, data)) for k in (1, 2)]
        found.append(cov / math.sqrt(var[0] * var[1]))
    assert sum(taken) / len(taken) == pytest.approx(1, abs=0.06)
    found.sort()
    at = lambda q: found[int(q * 39)] + (q * 39 - int(q * 39)) * (found[min(39, int(q * 39) + 1)] - found[int(q * 39)])
    for parts in (1, 5):
        df = stats.bootstrap_pearson(rows.repartition(parts), 40, "s")
        r = df.first()
        assert (r.low, r.high) == pytest.approx((at(0.025), at(0.975)), abs=2e-6)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    empty = stats.bootstrap_pearson(rows.limit(0), 5, "s").first()
    assert (empty.low, empty.high) == (None, None)


@pytest.mark.parametrize("tracked", [16, 64, 1 << 14])
def test_top_phrases_equal_brute_force(spark, tracked):
    """Few tracked phrases: keys that the sketch cannot settle are counted in full; hot phrases are settled by it."""
    rng = random.Random(tracked)
    words = [f"w{i}" for i in range(40)]
    rows = [(by, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for by in "ab" for _ in range(300)]
    rows += [("hot", "the same four words\tand\n more")] * 900 + [("hot", f"x{i} y{i} z{i}") for i in range(100)] + [("few", "a b c d"), ("none", "a b"), ("none", None)]
    want = []
    for by in {b for b, _ in rows}:
        n = Counter(" ".join(w[i : i + 3]) for b, t in rows if b == by for w in [re.findall(r"[^ \t\n]+", t or "")] for i in range(len(w) - 2))
        want += [(by, p, c, r) for r, (p, c) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0]))[:4], 1)]
    got = stats.top_phrases(spark.createDataFrame(rows, "by string, reply string"), "by", 4, 3, tracked)
    assert sorted(tuple(r) for r in got.select("by", "phrase", "n", "rank").collect()) == sorted(want)


def test_window_shares(spark):
    rows = spark.createDataFrame([(i % 10, i % 3 == 0) for i in range(40)], "step long, flag boolean")
    got = {(r.first, r.last): (r.steps, r.share) for r in stats.window_shares(rows, "step", F.col("flag"), [(0, 4), (3, 9), (20, 30)]).collect()}
    share = lambda a, b: round(sum(i % 3 == 0 for i in range(40) if a <= i % 10 <= b) / sum(a <= i % 10 <= b for i in range(40)), 6)
    assert got == {(0, 4): (5, share(0, 4)), (3, 9): (7, share(3, 9))}
