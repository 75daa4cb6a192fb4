"""Pairwise judging: requests in both display orders, judges, and the order-debiased outcome.

Samples are rows of (batch, rank, row_id, character, situation, speaker, line, reply, base, hard,
style, base_style). Judged calls are rows of (batch, rank, key, status, winner, a_p, a_r, a_n, b_p,
b_r, b_n), labels as displayed.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.lexicon import Rules
from ..functions.protocol import PAIR_PROTOCOL, identity

MARGIN_SCALE = 12
SCORES = ("a_p", "a_r", "a_n", "b_p", "b_r", "b_n")


def score_samples(samples: DataFrame, rules: Rules) -> DataFrame:
    """Cleans both replies, classifies and scores them; raw_base keeps what was given."""
    c, reply, base = (F.col(x) for x in ("character", "reply", "base"))
    out = R.pin(samples.withColumn("raw_base", base), reply=R.clean_reply(reply), base=R.clean_reply(base))
    out = R.pin(out, marked=R.marker_text(reply), base_marked=R.marker_text(base))
    out = R.pin(
        out,
        hard=R.hard_violation(rules, reply, c, F.col("marked")),
        style=R.style_score(rules, reply, c, F.col("marked")),
        base_style=R.style_score(rules, base, c, F.col("base_marked")),
    )
    return out.drop("marked", "base_marked")


def eligible():
    """Cheap rules come first: only clean replies that differ from the base reach the judge."""
    return F.col("hard").isNull() & (F.col("reply") != F.col("base"))


def requests(scored: DataFrame) -> DataFrame:
    """Two rows per eligible sample, AB and BA, with the shown candidates, their scores and the request's identity."""
    both = scored.filter(eligible()).withColumn("reverse", F.explode(F.array(F.lit(False), F.lit(True))))
    swap = lambda x, y: F.when(F.col("reverse"), F.col(y)).otherwise(F.col(x))
    both = both.withColumn("shown_a", swap("reply", "base")).withColumn("shown_b", swap("base", "reply"))
    both = both.withColumn("style_a", swap("style", "base_style")).withColumn("style_b", swap("base_style", "style"))
    key = identity(F.lit(PAIR_PROTOCOL), *(F.col(x) for x in ("character", "situation", "speaker", "line", "shown_a", "shown_b")))
    return R.pin(both, key=key)


def pending(asked: DataFrame) -> DataFrame:
    """Each distinct request once per batch and rank; a later batch asks again."""
    return asked.dropDuplicates(["batch", "rank", "key"]).select("batch", "rank", "key", "character", "situation", "speaker", "line", "shown_a", "shown_b", "style_a", "style_b")


class Judge(Protocol):
    """Anything that turns pending requests into judged calls; an outside model plugs in by mapInPandas."""

    def __call__(self, pending: DataFrame) -> DataFrame: ...


def _calls(df: DataFrame) -> DataFrame:
    return df.select("batch", "rank", "key", "status", "winner", *SCORES)


def stub_judge(pending: DataFrame) -> DataFrame:
    """Deterministic and offline: the higher rule score wins, equal ones tie; P follows the score, R and N are 3."""
    a, b = F.col("style_a"), F.col("style_b")
    winner = F.when(a > b, "A").when(a < b, "B").otherwise("tie")
    three = F.lit(3)
    return _calls(pending.withColumn("status", F.lit("ok")).withColumn("winner", winner).withColumns({"a_p": F.bround(4 * a).cast("int"), "a_r": three, "a_n": three, "b_p": F.bround(4 * b).cast("int"), "b_r": three, "b_n": three}))


def scripted_judge(ab: str, ba: str, is_reverse) -> Callable[[DataFrame], DataFrame]:
    """Fixed winner per display order: the winner gets P 4, the loser 2, a tie 3 each; R and N are 3."""

    def judge(pending: DataFrame) -> DataFrame:
        winner = F.when(is_reverse, ba).otherwise(ab)
        p = lambda side: F.when(winner == side, 4).when(winner.isin("A", "B"), 2).otherwise(3)
        three = F.lit(3)
        return _calls(pending.withColumns({"status": F.lit("ok"), "winner": winner, "a_p": p("A"), "b_p": p("B"), "a_r": three, "a_n": three, "b_r": three, "b_n": three}))

    return judge


def faulty(judge: Judge) -> Judge:
    """A judge with deterministic faults by request: about 1 in 16 unreadable, 1 in 16 undecided, 2 in 16
    favouring whatever is shown first. Stands for an outside judge in tests and demonstrations."""

    def work(pending: DataFrame) -> DataFrame:
        h = F.substring(F.md5(F.col("key").cast("binary")), 1, 1)
        calls = judge(pending)
        broken, unsure, first = h == "0", h == "1", h.isin("2", "3")
        out = calls.withColumn("status", F.when(broken, "parse_error").otherwise(F.col("status")))
        out = out.withColumn("winner", F.when(broken, F.lit(None)).when(unsure, "insufficient").when(first, "A").otherwise(F.col("winner")))
        for c in SCORES:
            new = {"a_p": F.lit(4), "b_p": F.lit(2)}.get(c, F.col(c))
            out = out.withColumn(c, F.when(broken | (unsure & F.lit(c == "a_p")), F.lit(None).cast("int")).when(first, new).otherwise(F.col(c)))
        return _calls(out)

    return work


def retried(judge: Callable[[DataFrame, int], DataFrame], retries: int = 1, budget: int | None = None) -> Judge:
    """A judge that asks once more for what did not come back as ok, with every attempt recorded as a row of ``attempts``
    (attempt, status). ``judge(pending, attempt)`` gives calls; ``budget`` is what each rank of a batch may spend: first
    attempts take from it before any retry, in the order of their keys, and what it does not reach is an inference_error."""
    if retries not in (0, 1):
        raise ValueError("at most one retry")

    def work(pending: DataFrame) -> DataFrame:
        on, batch = ["batch", "rank", "key"], Window.partitionBy("batch", "rank")
        number = F.row_number().over(batch.orderBy("key"))
        within = lambda room: F.lit(True) if budget is None else number <= room
        asked = pending.withColumn("reached", within(F.lit(budget)))
        one = _calls(judge(asked.filter("reached").drop("reached"), 1))
        missed = asked.filter("not reached").select(*on)
        if retries:
            spare = F.greatest(F.lit(budget) - F.col("wanted"), F.lit(0)) if budget is not None else None
            wanted = pending.groupBy("batch", "rank").agg(F.count(F.lit(1)).alias("wanted"))
            failed = pending.join(one.filter("status <> 'ok'").select(*on), on, "left_semi").join(wanted, ["batch", "rank"])
            again = failed.withColumn("reached", within(spare)).filter("reached").drop("reached", "wanted")
            two = _calls(judge(again, 2)).select(*on, F.struct("status", "winner", *SCORES).alias("second"))
        else:
            two = one.limit(0).select(*on, F.struct("status", "winner", *SCORES).alias("second"))
        both = one.join(two, on, "left")
        tries = F.filter(F.array(F.struct(F.lit(1).alias("attempt"), F.col("status")), F.struct(F.lit(2).alias("attempt"), F.col("second.status").alias("status"))), lambda t: t["status"].isNotNull())
        last = lambda c: F.when(F.col("second").isNotNull(), F.col(f"second.{c}")).otherwise(F.col(c)).alias(c)
        done = both.select(*on, *(last(c) for c in ("status", "winner", *SCORES)), tries.alias("attempts"))
        lost = missed.select(*on, F.lit("inference_error").alias("status"), F.lit("budget exhausted").alias("error"))
        return done.unionByName(lost, allowMissingColumns=True)

    return work


def flaky(judge: Judge, broken_once, broken_twice) -> Callable[[DataFrame, int], DataFrame]:
    """A judge for retried() whose first answer is unreadable where ``broken_once`` holds, and its second where ``broken_twice`` does."""

    def work(pending: DataFrame, attempt: int) -> DataFrame:
        broken = broken_twice if attempt > 1 else broken_once | broken_twice
        calls = judge(pending).withColumn("broken", broken)
        return _calls(calls.select("batch", "rank", "key", F.when(F.col("broken"), "parse_error").otherwise(F.col("status")).alias("status"), *(F.when(~F.col("broken"), F.col(c)).alias(c) for c in ("winner", *SCORES))))

    return work


def outcomes(asked: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per judged sample: policy and base totals of both orders, margin, verdict, flags, or why it is unusable."""
    j = asked.select("batch", "rank", "row_id", "reverse", "key").join(calls, ["batch", "rank", "key"], "left")
    rev = F.col("reverse")
    total = lambda s: sum((F.col(f"{s}_{d}") for d in ("r", "n")), F.col(f"{s}_p"))
    scored = F.col("winner") != "insufficient"
    for s in SCORES:
        scored = scored & F.col(s).isNotNull()
    j = j.withColumn("policy", F.when(rev, total("b")).otherwise(total("a"))).withColumn("other", F.when(rev, total("a")).otherwise(total("b")))
    j = j.withColumn("policy_r", F.when(rev, F.col("b_r")).otherwise(F.col("a_r")))
    original = F.when(rev & (F.col("winner") == "A"), "B").when(rev & (F.col("winner") == "B"), "A").otherwise(F.col("winner"))
    j = j.withColumn("won", original).withColumn("status", F.coalesce("status", F.lit("missing")))
    j = j.withColumn("decided", F.coalesce(scored, F.lit(False)))
    side = lambda c, r: F.max(F.when(rev == F.lit(r), F.col(c)))
    w = j.groupBy("batch", "rank", "row_id").agg(
        *[side(c, r).alias(f"{n}_{c}") for r, n in ((False, "ab"), (True, "ba")) for c in ("status", "decided", "policy", "other", "policy_r", "won")]
    )
    why = (
        F.when(F.col("ab_status") != "ok", F.concat(F.lit("AB "), F.col("ab_status")))
        .when(F.col("ba_status") != "ok", F.concat(F.lit("BA "), F.col("ba_status")))
        .when(~F.col("ab_decided") | ~F.col("ba_decided"), "insufficient")
    )
    ok = why.isNull()
    gap = lambda n: F.col(f"{n}_policy") - F.col(f"{n}_other")
    differs = F.col("ab_won") != F.col("ba_won")
    verdict = F.when(differs, 0.5).when(F.col("ab_won") == "A", 1.0).when(F.col("ab_won") == "B", 0.0).otherwise(0.5)
    return w.select(
        "batch",
        "rank",
        "row_id",
        why.alias("unusable"),
        F.when(ok, F.round((gap("ab") + gap("ba")) / F.lit(2.0 * MARGIN_SCALE), 6)).alias("margin"),
        F.when(ok, F.abs(gap("ab") - gap("ba"))).alias("order_margin_gap"),
        F.when(ok, (F.col("ab_policy") + F.col("ba_policy")) / F.lit(2.0)).alias("policy_prn"),
        F.when(ok, (F.col("ab_other") + F.col("ba_other")) / F.lit(2.0)).alias("base_prn"),
        F.when(ok, verdict).alias("verdict"),
        F.when(ok, differs).alias("order_inconsistent"),
        F.when(ok, (F.col("ab_policy_r") <= 1) & (F.col("ba_policy_r") <= 1)).alias("off_topic"),
        "ab_won",
        "ba_won",
    )


def judged(samples: DataFrame, rules: Rules, judge: Judge, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(samples with their outcome, status and value; requests). ``keep`` may write the scored and the judged samples
    and read them back, for reports that branch on them."""
    scored = keep(score_samples(samples, rules))
    asked = requests(scored)
    found = outcomes(asked, judge(pending(asked)))
    out = scored.join(found, ["batch", "rank", "row_id"], "left")
    out = R.pin(out, status=F.when(F.col("hard").isNotNull(), "hard").when(F.col("reply") == F.col("base"), "identical").when(F.col("unusable").isNotNull() | F.col("margin").isNull(), "unusable").otherwise("ok"))
    value = F.when(F.col("status") == "hard", -1.0).when(F.col("status") == "identical", 0.0).otherwise(F.col("margin"))
    return keep(R.pin(out, value=value)), asked
