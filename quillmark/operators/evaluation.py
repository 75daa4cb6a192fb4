"""Held-out evaluation, attribution, order probe, and the survey before training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.lexicon import Rules


def rate(condition, decimals: int = 6):
    return F.round(F.avg(condition.cast("double")), decimals)


def vs_base(judged: DataFrame, *by: str) -> DataFrame:
    """Reward and verdict against base; a violation counts as a loss, an identical reply as a tie."""
    scored = F.col("status") != "unusable"
    verdict = F.when(F.col("status") == "hard", 0.0).when(F.col("status") == "identical", 0.5).otherwise(F.col("verdict"))
    d = judged.withColumn("v", F.when(scored, verdict)).withColumn("w", F.when(scored, F.col("value")))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(scored).alias("scored"),
        F.round(F.avg("w"), 6).alias("reward_mean"),
        F.round(F.avg("margin"), 6).alias("margin_mean"),
        F.count_if(F.col("margin") > 0).alias("margin_positive"),
        F.count_if(F.col("margin") < 0).alias("margin_negative"),
        F.round(F.avg("v"), 6).alias("win_rate"),
        F.count_if(F.col("v") == 1.0).alias("wins"),
        F.count_if(F.col("v") == 0.5).alias("ties"),
        F.count_if(F.col("v") == 0.0).alias("losses"),
        F.count_if(F.col("status") == "hard").alias("hard"),
        F.count_if(F.col("status") == "identical").alias("identical"),
        F.count_if(F.col("order_inconsistent")).alias("order_inconsistent"),
        F.count_if(~scored).alias("unusable"),
    )


def stub_attribution(rules: Rules, reply):
    """The persona with more of its markers in the raw reply, else neither."""
    a, b = rules.personas
    hits = [R.total([F.contains(reply, F.lit(m)).cast("int") for m in p.markers]) for p in (a, b)]
    return F.when(hits[0] > hits[1], a.key).when(hits[0] < hits[1], b.key).otherwise("neither")


def attribution(rows: DataFrame, rules: Rules, *by: str) -> DataFrame:
    """``rows``: character, reply, first, second (the answers under both card orders; null for a failed call)."""
    a, b = rules.personas
    other = F.when(F.col("character") == a.key, b.key).otherwise(a.key)
    ok = (F.length("reply") > 0) & (F.col("first") == F.col("second"))
    only = lambda e: F.round(F.avg(F.when(ok, e.cast("double"))), 6)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(ok).alias("consistent"),
        only(F.col("first") == F.col("character")).alias("correct_rate"),
        only(F.col("first") == other).alias("cross_character_rate"),
        only(F.col("first") == "neither").alias("neither_rate"),
    )


def side_by_side(rows: DataFrame) -> DataFrame:
    """One markdown table row per sample, bars escaped, line ends as spaces."""
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return rows.select("row_id", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("row_id").cast("string"), cell("line"), cell("base"), cell("reply")), F.lit(" |")).alias("markdown"))


def counterparts(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """Each row's own base reply beside the other character's for the same template and line, with a
    status for pairs that cannot be compared. ``rows``: id, character; ``replies``: row_id, reply."""
    named = rows.join(replies.withColumnRenamed("row_id", "id"), "id").withColumn("scene", F.regexp_replace("id", r"-[^-]*\z", ""))
    other = named.select("scene", F.col("character").alias("other_character"), F.col("reply").alias("other_reply"))
    both = named.join(other, "scene").filter(F.col("character") != F.col("other_character"))
    blank = (F.length(F.trim("reply")) == 0) | (F.length(F.trim("other_reply")) == 0)
    return both.withColumn("status", F.when(blank, "empty").when(F.col("reply") == F.col("other_reply"), "identical").otherwise("probe"))


def order_probe(judged: DataFrame, repeat_agrees) -> DataFrame:
    """Order consistency over probed cases. A verdict that follows the position makes its case unusable,
    but its margin still counts. ``repeat_agrees``: whether a repeated call gave the same winner."""
    d = judged.withColumn("usable", (F.col("status") == "ok") & ~F.col("order_inconsistent"))
    return d.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("usable").alias("usable"),
        rate(F.coalesce("usable", F.lit(False)), 3).alias("usable_rate"),
        rate(repeat_agrees, 3).alias("repeat_agreement"),
        F.round(F.avg(F.when(F.col("usable"), F.col("verdict"))), 3).alias("own_character_preferred"),
        F.round(F.avg("margin"), 3).alias("own_character_margin"),
        F.round(F.avg("order_margin_gap"), 3).alias("order_margin_gap_mean"),
    )


def order_probe_reasons(judged: DataFrame) -> DataFrame:
    """(reason, n) of the cases that are not usable: why the call failed, a verdict that follows the position, or,
    for pairs that were not probed at all, "skipped" and why. Skipped pairs are in no denominator of order_probe()."""
    skipped = F.col("status").isin("hard", "identical", "empty")
    reason = F.when(skipped, F.concat(F.lit("skipped "), F.col("status"))).when(F.col("status") != "ok", F.coalesce("unusable", F.lit("unusable"))).when(F.col("order_inconsistent"), "order_inconsistent")
    return judged.withColumn("reason", reason).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def base_violations(rows: DataFrame, rules: Rules) -> DataFrame:
    """(reason, n) of base replies (character, reply, given as they are) that break a rule; an empty reply is an error."""
    reply = F.when(F.length(F.trim("reply")) > 0, F.col("reply")).otherwise(F.raise_error(F.lit("an empty base reply")).cast("string"))
    checked = R.pin(rows, reply=reply)
    return checked.select(R.hard_violation(rules, F.col("reply"), F.col("character")).alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def survey_rows(scored: DataFrame, *by: str) -> DataFrame:
    """Diversity of the samples of each prompt, on cleaned replies."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.countDistinct("reply").alias("distinct_replies"),
        F.countDistinct("style").alias("distinct_style_scores"),
        F.count("hard").alias("hard"),
        F.array_join(F.array_sort(F.collect_set("hard")), ",").alias("hard_reasons"),
        F.avg("style").alias("style_mean"),
    )


def survey_overall(rows: DataFrame) -> DataFrame:
    """Over survey rows: hard_rate is a ratio of sums, style_mean a mean of row means."""
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("distinct_replies") == 1).alias("one_reply"),
        F.count_if(F.col("hard") == F.col("samples")).alias("all_hard"),
        F.round(F.coalesce(F.sum("hard"), F.lit(0)) / F.greatest(F.coalesce(F.sum("samples"), F.lit(0)), F.lit(1)), 6).alias("hard_rate"),
        F.round(F.avg("style_mean"), 6).alias("style_mean"),
    )


# The survey's gate.
MIN_VARIED, MARGIN_LOW, MARGIN_HIGH, MAX_REJECTED = 0.6, -0.5, 0.5, 0.2


def survey_gate(decided: DataFrame, judged: DataFrame) -> DataFrame:
    """Whether training may start; an undefined figure fails."""
    g = decided.agg(F.count(F.lit(1)).alias("groups"), F.count_if("rejected").alias("rejected"), F.count_if(~F.col("rejected") & (F.col("distinct_values") > 1)).alias("varied"))
    m = judged.agg(F.avg("margin").alias("margin"))
    varied = F.try_divide("varied", F.col("groups") - F.col("rejected"))
    lost = F.try_divide("rejected", "groups")
    passed = (varied >= MIN_VARIED) & F.col("margin").between(MARGIN_LOW, MARGIN_HIGH) & (lost <= MAX_REJECTED)
    # One row each: the join is of two aggregates.
    return g.join(F.broadcast(m)).select("groups", F.round(varied, 6).alias("varied_share"), F.round(lost, 6).alias("rejected_share"), F.round("margin", 6).alias("margin_mean"), F.coalesce(passed, F.lit(False)).alias("passed"))
