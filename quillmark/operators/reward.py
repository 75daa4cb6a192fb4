"""Group reward: a group with any unusable sample is rejected whole; metrics, totals and streaks of batches.

Groups are found by (batch, grp) columns, never by row order, so a group may straddle ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.lexicon import Rules
from .prefix import running


def layout_errors(samples: DataFrame, size: int) -> DataFrame:
    """Groups that are not ``size`` rows of one prompt: (batch, grp, members, prompts). Empty if all is well."""
    g = samples.groupBy("batch", "grp").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("prompt_id").alias("prompts"))
    return g.filter((F.col("members") != size) | (F.col("prompts") != 1))


def groups(judged: DataFrame) -> DataFrame:
    """(batch, grp, members, rejected, reason of the first unusable member in row order, distinct values)."""
    bad = F.col("unusable").isNotNull()
    return judged.groupBy("batch", "grp").agg(
        F.count(F.lit(1)).alias("members"),
        F.bool_or(bad).alias("rejected"),
        F.min_by("unusable", F.when(bad, F.struct("rank", "pos"))).alias("reason"),
        F.countDistinct("value").alias("distinct_values"),
    )


def rewards(judged: DataFrame, decided: DataFrame) -> DataFrame:
    """Each sample's reward: null for every member of a rejected group."""
    out = judged.join(decided.select("batch", "grp", "rejected"), ["batch", "grp"])
    return out.withColumn("reward", F.when(~F.col("rejected"), F.col("value")))


def batch_metrics(judged: DataFrame, asked: DataFrame, decided: DataFrame, rules: Rules) -> DataFrame:
    """One row per batch. All but varied_groups also counts members of rejected groups."""
    c = lambda e: F.count_if(e)
    ok = F.col("status") == "ok"
    per = judged.groupBy("batch").agg(
        *R.rule_metrics(rules, F.col("reply"), F.col("character"), F.col("hard"), F.col("style")),
        c(F.col("status") == "hard").alias("hard"),
        R.mean6(F.col("value")).alias("reward_mean"),
        R.mean6(F.col("margin")).alias("margin_mean"),
        F.round(F.avg(F.when(ok, (F.col("margin") > 0).cast("double"))), 6).alias("margin_positive_rate"),
        F.round(F.avg("policy_prn"), 6).alias("policy_prn_mean"),
        F.round(F.avg("base_prn"), 6).alias("base_prn_mean"),
        F.round(F.avg((F.col("status") == "identical").cast("double")), 6).alias("identical_rate"),
        c(F.col("status") == "identical").alias("skipped_identical"),
        F.round(F.avg("verdict"), 6).alias("win_rate_vs_base"),
        c(F.col("order_inconsistent")).alias("order_inconsistent"),
        F.round(F.avg(F.when(ok, F.col("order_inconsistent").cast("double"))), 6).alias("order_inconsistent_rate"),
        c(F.col("off_topic")).alias("off_topic"),
    )
    grouped = decided.groupBy("batch").agg(F.count(F.lit(1)).alias("groups"), c(F.col("rejected")).alias("rejected_groups"), c(~F.col("rejected") & (F.col("distinct_values") > 1)).alias("varied_groups"))
    calls = reuse(asked).groupBy("batch").agg(F.sum("judge_calls").alias("judge_calls"), F.sum("reused_requests").alias("reused_requests"))
    out = per.join(grouped, "batch").join(calls, "batch", "left")
    return out.fillna(0, ["judge_calls", "reused_requests"])


def reuse(asked: DataFrame) -> DataFrame:
    """Distinct requests and spared ones, per batch and rank."""
    n = asked.groupBy("batch", "rank").agg(F.count(F.lit(1)).alias("wanted"), F.countDistinct("key").alias("judge_calls"))
    return n.select("batch", "rank", "judge_calls", (F.col("wanted") - F.col("judge_calls")).alias("reused_requests"))


TOTALS = ("groups", "rejected_groups", "judge_calls", "reused_requests", "skipped_identical", "hard", "order_inconsistent")


def running_totals(metrics: DataFrame) -> DataFrame:
    """The counters after each batch, batches included."""
    counted = metrics.select("batch", F.lit(1).alias("batches"), *TOTALS)
    out = running(counted, "batch", sums={f"total_{c}": c for c in ("batches", *TOTALS)})
    return out.select("batch", *(f"total_{c}" for c in ("batches", *TOTALS)))


def rejected_streaks(metrics: DataFrame, limit: int = 3) -> DataFrame:
    """Consecutive batches whose every group was rejected, and whether the run must stop there."""
    all_bad = F.col("rejected_groups") == F.col("groups")
    m = running(metrics.select("batch", all_bad.cast("long").alias("bad")), "batch", sums={"count": "bad"})
    m = running(m.withColumn("reset", F.when(F.col("bad") == 0, F.col("count"))), "batch", maxima={"at": "reset"})
    streak = F.col("count") - F.coalesce("at", F.lit(0))
    return m.select("batch", streak.cast("long").alias("streak"), (streak >= limit).alias("abort"))


def advantages(rewarded: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """Group-relative advantage: reward less its group's mean, over the batch's sample deviation plus
    ``epsilon``; both choices are ours. Rejected groups get zero and are masked."""
    group, batch = Window.partitionBy("batch", "grp"), Window.partitionBy("batch")
    gap = F.col("reward") - F.avg("reward").over(group)
    spread = F.coalesce(F.stddev_samp("reward").over(batch), F.lit(0.0))
    return rewarded.withColumn("advantage", F.coalesce(gap / (spread + epsilon), F.lit(0.0)))


def mask_spans(ranks: DataFrame, decided: DataFrame, size: int) -> DataFrame:
    """(batch, rank, start, end): the local row ranges that rejected groups cut out of each rank's rows.

    ``ranks``: batch, rank, row_offset, rows; ``decided`` needs batch, index (the group's place in the batch) and rejected.
    """
    bad = decided.filter("rejected").select("batch", (F.col("index") * size).alias("g0"), ((F.col("index") + 1) * size).alias("g1"))
    j = ranks.join(bad, "batch").filter((F.col("g0") < F.col("row_offset") + F.col("rows")) & (F.col("g1") > F.col("row_offset")))
    return j.select("batch", "rank", F.greatest(F.col("g0") - F.col("row_offset"), F.lit(0)).alias("start"), F.least(F.col("g1") - F.col("row_offset"), F.col("rows")).alias("end"))


def superseded(serials: DataFrame, checkpoint: int) -> DataFrame:
    """Batches after the checkpoint that a resumed run replaces; they stay on disk."""
    return serials.filter(F.col("serial") > checkpoint)


def latest_complete(states: DataFrame, world: int) -> DataFrame:
    """The last step of which every rank's state exists; one row, null if there is none."""
    whole = states.groupBy("step").agg(F.countDistinct("rank").alias("ranks")).filter(F.col("ranks") == world)
    return whole.agg(F.max("step").alias("step"))
