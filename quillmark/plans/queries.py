"""Driver queries of the reward analytics, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import strict_json
from ..functions.protocol import allowed_citations, attribution_payload, evidence, pair_payload, policy_prompt, within_budget
from ..operators import evaluation as E
from ..operators import integrity as I
from ..operators import labels as L
from ..operators import pairs as P
from ..operators import reward as W
from ..operators import stats as S
from ..operators.outside import outside_judge
from ..session import shared_folder, table, written
from . import demo
from .sql import METRICS, mean6, over

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _scored(spark, d) -> DataFrame:
    return P.score_samples(demo.samples(spark, d), demo.RULES)


def _judged(spark, d) -> tuple[DataFrame, DataFrame]:
    """Samples are scored once and judged once: both are written, since every report branches on them."""
    return P.judged(demo.samples(spark, d), demo.RULES, P.faulty(P.stub_judge), written)


def _human(spark, d) -> DataFrame:
    """Document quality as a stand-in for a human's preference, the rule score as the judge's."""
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).otherwise(-1).alias("human")).distinct()
    return _scored(spark, d).withColumn("doc_id", F.col("row_id") % demo.SPAN).join(labels, "doc_id").select("row_id", "character", "reply", "human", F.round(F.col("style") - 0.6, 6).alias("judge"))


@query(over("cleaned", "SELECT row_id, reply, base FROM cleaned"))
def clean_reply(spark: SparkSession, d: str) -> DataFrame:
    return demo.samples(spark, d).select("row_id", R.clean_reply(F.col("reply")).alias("reply"), R.clean_reply(F.col("base")).alias("base"))


@query(over("marked", "SELECT row_id, m AS marker_text FROM marked"))
def marker_normalize(spark: SparkSession, d: str) -> DataFrame:
    return demo.samples(spark, d).select("row_id", R.marker_text(R.clean_reply(F.col("reply"))).alias("marker_text"))


@query(over("scored", "SELECT character, coalesce(hard, 'none') AS reason, count(*) AS n FROM scored GROUP BY ALL"))
def hard_violation_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("character", F.coalesce("hard", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(over("scored", "SELECT character, style, count(*) AS n FROM scored GROUP BY ALL"))
def style_score_hist(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("character", "style").agg(F.count(F.lit(1)).alias("n"))


@query(over("scored", f"SELECT character, {METRICS} FROM scored GROUP BY character"))
def rule_metrics_by_persona(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).groupBy("character").agg(*R.rule_metrics(demo.RULES, F.col("reply"), F.col("character"), F.col("hard"), F.col("style")))


@query(over("scored", f"SELECT coalesce(character, 'all') AS character, samples, stock_opener_rate FROM (SELECT character, {METRICS} FROM scored GROUP BY ROLLUP (character))"))
def stock_opener_rate(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).rollup("character").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg(R.opens_with_stock(demo.RULES, F.col("reply"), F.col("character")).cast("double")), 6).alias("stock_opener_rate"))
    return s.withColumn("character", F.coalesce("character", F.lit("all")))


@query(over("reused", "SELECT * FROM reused"))
def pair_requests_dedup(spark: SparkSession, d: str) -> DataFrame:
    return W.reuse(P.requests(_scored(spark, d)))


@query(over("stub", "SELECT row_id, reverse, w AS winner, p AS a_p, q AS b_p FROM stub"))
def stub_judge_scores(spark: SparkSession, d: str) -> DataFrame:
    asked = P.requests(_scored(spark, d))
    calls = P.stub_judge(P.pending(asked)).select("batch", "rank", "key", "winner", "a_p", "b_p")
    return asked.select("row_id", "reverse", "batch", "rank", "key").join(calls, ["batch", "rank", "key"]).select("row_id", "reverse", "winner", "a_p", "b_p")


@query(over("outcome", "SELECT row_id, unusable, margin, verdict, order_inconsistent, CAST(order_margin_gap AS INTEGER) AS order_margin_gap FROM outcome"))
def pair_outcome(spark: SparkSession, d: str) -> DataFrame:
    asked = P.requests(_scored(spark, d))
    return P.outcomes(asked, P.faulty(P.stub_judge)(P.pending(asked))).select("row_id", "unusable", "margin", "verdict", "order_inconsistent", "order_margin_gap")


@query(over("asked", "SELECT count(DISTINCT row_id) AS samples, 0e0 AS margin_mean, 0.5e0 AS verdict_mean, count(DISTINCT row_id) AS inconsistent FROM asked"))
def order_bias_outcome(spark: SparkSession, d: str) -> DataFrame:
    """A judge that always prefers what is shown first: margin 0, verdict a flagged tie."""
    asked = P.requests(_scored(spark, d))
    out = P.outcomes(asked, P.scripted_judge("A", "A", F.lit(False))(P.pending(asked)))
    return out.agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("margin"), 6).alias("margin_mean"), F.round(F.avg("verdict"), 6).alias("verdict_mean"), F.count_if("order_inconsistent").alias("inconsistent"))


@query(over("grouped", "SELECT * FROM grouped"))
def group_rejection(spark: SparkSession, d: str) -> DataFrame:
    return W.groups(_judged(spark, d)[0])


@query(over("grouped", "SELECT reason, count(*) AS n FROM grouped WHERE rejected GROUP BY reason"))
def rejection_reasons(spark: SparkSession, d: str) -> DataFrame:
    return W.groups(_judged(spark, d)[0]).filter("rejected").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(over("rewarded", "SELECT row_id, status, reward FROM rewarded"))
def reward_values(spark: SparkSession, d: str) -> DataFrame:
    j, _ = _judged(spark, d)
    return W.rewards(j, W.groups(j)).select("row_id", "status", "reward")


def _metrics(spark, d) -> DataFrame:
    j, asked = _judged(spark, d)
    return W.batch_metrics(j, asked, W.groups(j), demo.RULES)


@query(over("per_batch", "SELECT * REPLACE (CAST(off_topic AS BIGINT) AS off_topic) FROM per_batch"))
def batch_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d)


@query(
    over(
        "per_batch",
        "SELECT batch, count(*) OVER w AS total_batches, "
        + ", ".join(f"CAST(sum({c}) OVER w AS BIGINT) AS total_{c}" for c in W.TOTALS)
        + " FROM per_batch WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)",
    )
)
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    return W.running_totals(_metrics(spark, d))


@query(
    """WITH m AS (SELECT event_id // 5 AS batch, bool_and(event_type IN ('click', 'view')) AS bad FROM events GROUP BY 1),
i AS (SELECT *, sum(CAST(NOT bad AS INTEGER)) OVER (ORDER BY batch) AS island FROM m),
s AS (SELECT batch, CAST(sum(CAST(bad AS INTEGER)) OVER (PARTITION BY island ORDER BY batch) AS BIGINT) AS streak FROM i)
SELECT batch, streak, streak >= 3 AS abort FROM s"""
)
def rejected_streaks(spark: SparkSession, d: str) -> DataFrame:
    """Streaks over a made-up run: events stand for groups, five to a batch, two kinds of them rejected."""
    e = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 5).alias("batch")).agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("event_type").isin("click", "view")).alias("rejected_groups"))
    return W.rejected_streaks(e)


@query(over("grouped", "SELECT batch, count(*) AS groups, count(*) FILTER (WHERE NOT rejected AND distinct_values > 1) AS varied_groups FROM grouped GROUP BY batch"))
def varied_groups(spark: SparkSession, d: str) -> DataFrame:
    g = W.groups(_judged(spark, d)[0])
    return g.groupBy("batch").agg(F.count(F.lit(1)).alias("groups"), F.count_if(~F.col("rejected") & (F.col("distinct_values") > 1)).alias("varied_groups"))


@query(
    over(
        "rewarded",
        """SELECT row_id, round(coalesce((reward - avg(reward) OVER (PARTITION BY batch, grp)) / (coalesce(stddev_samp(reward) OVER (PARTITION BY batch), 0) + 1e-4), 0), 5) AS advantage FROM rewarded""",
    )
)
def group_advantage(spark: SparkSession, d: str) -> DataFrame:
    j, _ = _judged(spark, d)
    return W.advantages(W.rewards(j, W.groups(j))).select("row_id", F.round("advantage", 5).alias("advantage"))


@query(
    over(
        "grouped",
        """, g AS (SELECT batch, grp % 5 AS i FROM grouped WHERE rejected), r AS (SELECT DISTINCT batch, rank, rank * 20 AS o FROM raw)
SELECT batch, rank, greatest(i * 8 - o, 0) AS start, least(i * 8 + 8 - o, 20) AS "end" FROM r JOIN g USING (batch) WHERE i * 8 < o + 20 AND i * 8 + 8 > o""",
    ).replace("\n, g AS", ", g AS")
)
def mask_spans(spark: SparkSession, d: str) -> DataFrame:
    j, _ = _judged(spark, d)
    ranks = j.select("batch", "rank").distinct().select("batch", "rank", (F.col("rank") * 20).alias("row_offset"), F.lit(20).cast("long").alias("rows"))
    return W.mask_spans(ranks, W.groups(j).withColumn("index", F.col("grp") % 5), demo.GROUP)


_VS = """count(*) AS cases, count(*) FILTER (WHERE status <> 'unusable') AS scored, round(avg(value), 6) AS reward_mean, round(avg(margin), 6) AS margin_mean,
 count(*) FILTER (WHERE margin > 0) AS margin_positive, count(*) FILTER (WHERE margin < 0) AS margin_negative, round(avg(v), 6) AS win_rate,
 count(*) FILTER (WHERE v = 1) AS wins, count(*) FILTER (WHERE v = 0.5) AS ties, count(*) FILTER (WHERE v = 0) AS losses, count(*) FILTER (WHERE status = 'hard') AS hard,
 count(*) FILTER (WHERE status = 'identical') AS identical, count(*) FILTER (WHERE order_inconsistent) AS order_inconsistent, count(*) FILTER (WHERE status = 'unusable') AS unusable
 FROM (SELECT *, CASE status WHEN 'hard' THEN 0e0 WHEN 'identical' THEN 0.5e0 ELSE verdict END AS v FROM final)"""


@query(over("final", f"SELECT character, {_VS} GROUP BY character"))
def vs_base_report(spark: SparkSession, d: str) -> DataFrame:
    return E.vs_base(_judged(spark, d)[0], "character")


_ANSWER = "CASE WHEN {a} > {b} THEN 'a' WHEN {a} < {b} THEN 'b' ELSE 'neither' END"
_HITS = {"a": "(CAST(contains(reply, 'the') AS INTEGER) + CAST(contains(reply, 'and') AS INTEGER) + CAST(contains(reply, 'tion') AS INTEGER))", "b": "(CAST(contains(reply, 'que') AS INTEGER) + CAST(contains(reply, 'eau') AS INTEGER) + CAST(contains(reply, 'ç') AS INTEGER))"}


@query(
    over(
        "cleaned",
        f"""SELECT character, count(*) AS cases, count(*) FILTER (WHERE ok) AS consistent,
 round(avg(CASE WHEN ok THEN CAST(one = character AS DOUBLE) END), 6) AS correct_rate, round(avg(CASE WHEN ok THEN CAST(one = other AS DOUBLE) END), 6) AS cross_character_rate,
 round(avg(CASE WHEN ok THEN CAST(one = 'neither' AS DOUBLE) END), 6) AS neither_rate
 FROM (SELECT *, length(reply) > 0 AND one = two AS ok, CASE character WHEN 'a' THEN 'b' ELSE 'a' END AS other FROM (
   SELECT *, {_ANSWER.format(**_HITS)} AS one, CASE WHEN row_id % 7 = 0 THEN 'a' ELSE {_ANSWER.format(**_HITS)} END AS two FROM cleaned)) GROUP BY character""",
    )
)
def attribution_report(spark: SparkSession, d: str) -> DataFrame:
    """The stub's answers; under the swapped card order one row in seven falls back to the first card."""
    rows = demo.samples(spark, d).withColumn("reply", R.clean_reply(F.col("reply")))
    answer = E.stub_attribution(demo.RULES, F.col("reply"))
    rows = rows.withColumn("first", answer).withColumn("second", F.when(F.col("row_id") % 7 == 0, "a").otherwise(answer))
    return E.attribution(rows, demo.RULES, "character")


@query(over("cleaned", "SELECT row_id, '| ' || row_id || ' | line | ' || replace(replace(base, '|', '\\|'), chr(10), ' ') || ' | ' || replace(replace(reply, '|', '\\|'), chr(10), ' ') || ' |' AS markdown FROM cleaned"))
def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    return E.side_by_side(_scored(spark, d))


@query(
    over(
        "final",
        """SELECT count(*) AS cases, count(*) FILTER (WHERE u) AS usable, round(avg(CAST(coalesce(u, false) AS DOUBLE)), 3) AS usable_rate, round(avg(CAST(row_id % 11 <> 0 AS DOUBLE)), 3) AS repeat_agreement,
 round(avg(CASE WHEN u THEN verdict END), 3) AS own_character_preferred, round(avg(margin), 3) AS own_character_margin, round(avg(order_margin_gap), 3) AS order_margin_gap_mean
 FROM (SELECT *, status = 'ok' AND NOT order_inconsistent AS u FROM final WHERE status IN ('ok', 'unusable'))""",
    )
)
def order_probe_summary(spark: SparkSession, d: str) -> DataFrame:
    """Judged samples as probed cases; one repeated call in eleven disagrees."""
    j, _ = _judged(spark, d)
    return E.order_probe(j.filter(F.col("status").isin("ok", "unusable")), F.col("row_id") % 11 != 0)


_SURVEY = "SELECT batch, grp, count(*) AS samples, count(DISTINCT reply) AS distinct_replies, count(DISTINCT style) AS distinct_style_scores, count(hard) AS hard, coalesce(string_agg(DISTINCT hard, ',' ORDER BY hard), '') AS hard_reasons, avg(style) AS style_mean FROM scored GROUP BY batch, grp"


@query(over("scored", f"SELECT * REPLACE (round(style_mean, 9) AS style_mean) FROM ({_SURVEY})"))
def survey_rows(spark: SparkSession, d: str) -> DataFrame:
    return E.survey_rows(_scored(spark, d), "batch", "grp").withColumn("style_mean", F.round("style_mean", 9))


@query(over("scored", f"SELECT count(*) AS rows, count(*) FILTER (WHERE distinct_replies = 1) AS one_reply, count(*) FILTER (WHERE hard = samples) AS all_hard, round(sum(hard) / sum(samples), 6) AS hard_rate, round(avg(style_mean), 6) AS style_mean FROM ({_SURVEY})"))
def survey_overall(spark: SparkSession, d: str) -> DataFrame:
    return E.survey_overall(E.survey_rows(_scored(spark, d), "batch", "grp"))


@query(
    over(
        "grouped",
        """SELECT groups, round(v, 6) AS varied_share, round(l, 6) AS rejected_share, round(m, 6) AS margin_mean, v >= 0.6 AND m BETWEEN -0.5 AND 0.5 AND l <= 0.2 AS passed
 FROM (SELECT count(*) AS groups, count(*) FILTER (WHERE NOT rejected AND distinct_values > 1) / count(*) FILTER (WHERE NOT rejected) AS v, count(*) FILTER (WHERE rejected) / count(*) AS l FROM grouped), (SELECT avg(margin) AS m FROM final)""",
    )
)
def survey_gate(spark: SparkSession, d: str) -> DataFrame:
    j, _ = _judged(spark, d)
    return E.survey_gate(W.groups(j), j)


_USABLE = "SELECT f.*, margin * 24 AS mm FROM final f JOIN grouped g USING (batch, grp) WHERE NOT g.rejected AND f.status = 'ok'"


def _usable(spark, d) -> DataFrame:
    """Usable judged samples of groups that were not rejected, with their raw margin over both orders."""
    j, _ = _judged(spark, d)
    kept = W.groups(j).filter("not rejected").select("batch", "grp")
    return j.filter("status = 'ok'").join(kept, ["batch", "grp"], "left_semi").withColumn("margin", F.col("margin") * 24)


@query(
    over(
        "grouped",
        f"""SELECT row_id, character, band FROM (SELECT *, row_number() OVER (PARTITION BY character, band ORDER BY md5('seed|' || row_id), row_id) AS n FROM (
 SELECT *, CASE WHEN mm >= -99 AND mm < -3 THEN 0 WHEN mm >= -3 AND mm < -0.5 THEN 1 WHEN mm >= -0.5 AND mm < 0.5 THEN 2 WHEN mm >= 0.5 AND mm < 3 THEN 3 WHEN mm >= 3 AND mm < 99 THEN 4 END AS band FROM ({_USABLE})) WHERE band IS NOT NULL)
 WHERE n <= 3 + CAST(band < 2 AS INTEGER)""",
    )
)
def margin_band_pick(spark: SparkSession, d: str) -> DataFrame:
    return L.pick_bands(_usable(spark, d), 34, "seed").select("row_id", "character", "band")


@query(
    over(
        "cleaned",
        """SELECT batch, grp, character, with_opener, without_opener FROM (
 SELECT *, row_number() OVER (PARTITION BY character ORDER BY md5('seed|' || batch || '|' || grp), batch, grp) AS n FROM (
  SELECT batch, grp, character, arg_min(row_id, o) FILTER (WHERE op) AS with_opener, arg_min(row_id, o) FILTER (WHERE NOT op) AS without_opener FROM (
   SELECT *, md5('seed|' || row_id) AS o, CASE WHEN character = 'a' THEN starts_with(reply, 'The') OR starts_with(reply, 'And') ELSE starts_with(reply, 'Le') OR starts_with(reply, 'De') END AS op FROM cleaned)
  GROUP BY batch, grp, character) WHERE with_opener IS NOT NULL AND without_opener IS NOT NULL) WHERE n <= 5 + CAST(character = 'a' AS INTEGER)""",
    )
)
def opener_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("opener", R.per_persona(demo.RULES, F.col("character"), lambda p: R.starts_any(F.col("reply"), p.openers)))
    return L.opener_pairs(rows, 11, "a", "seed")


@query(
    over(
        "cleaned",
        """SELECT printf('q%03d', row_number() OVER (ORDER BY h, row_id)) AS id, 'test' AS kind, CAST(row_id AS VARCHAR) AS row_id, CASE WHEN swapped THEN base ELSE reply END AS "left", CASE WHEN swapped THEN reply ELSE base END AS "right", swapped FROM (
 SELECT *, md5('seed|test|' || row_id) AS h, substr(md5('seed-side|test|' || row_id), 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS swapped FROM (
  SELECT * FROM (SELECT row_id, reply, base FROM cleaned WHERE reply <> base ORDER BY md5('pick|' || row_id), row_id LIMIT 100)))""",
    )
)
def blind_label_set(spark: SparkSession, d: str) -> DataFrame:
    """A hundred sampled pairs as a blind label set; the size of the set is the feature."""
    s = _scored(spark, d).filter(F.col("reply") != F.col("base"))
    picked = L.hash_sample(s, "pick", "row_id", 100)
    return L.blind(picked.select(F.lit("test").alias("kind"), F.col("row_id").cast("string").alias("row_id"), F.col("reply").alias("first"), F.col("base").alias("second")), "seed")


_AGREE = """count(*) AS pairs, count(*) FILTER (WHERE sign(human) = sign(judge)) AS exact_three_way, count(*) FILTER (WHERE judge <> 0) AS decisive,
 count(*) FILTER (WHERE judge <> 0 AND sign(human) = sign(judge)) AS decisive_agree, round(count(*) FILTER (WHERE judge <> 0 AND sign(human) = sign(judge)) / nullif(count(*) FILTER (WHERE judge <> 0), 0), 3) AS decisive_rate, round(CASE WHEN isnan(corr(human, judge)) THEN NULL ELSE corr(human, judge) END, 3) AS pearson FROM human"""


@query(over("human", f"SELECT {_AGREE}"))
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    return L.agreement(_human(spark, d))


@query(over("human", f"SELECT character, {_AGREE} GROUP BY character"))
def agreement_by_persona(spark: SparkSession, d: str) -> DataFrame:
    return L.agreement(_human(spark, d), "character")


@query(over("human", f"SELECT *, decisive_rate > 0.707 AND pearson > 0.38 AS passed FROM (SELECT {_AGREE})"))
def agreement_gate(spark: SparkSession, d: str) -> DataFrame:
    return L.gate(L.agreement(_human(spark, d)))


@query(over("human", "SELECT count(*) FILTER (WHERE judge > 0) AS judge_for, count(*) FILTER (WHERE human > 0) AS human_for, count(*) FILTER (WHERE judge < 0) AS judge_against, count(*) FILTER (WHERE human < 0) AS human_against FROM human"))
def opener_preference(spark: SparkSession, d: str) -> DataFrame:
    return L.opener_preference(_human(spark, d))


@query(over("human", "SELECT row_id, CASE WHEN row_id % 2 = 1 THEN -c ELSE c END AS score FROM (SELECT row_id, CASE row_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN -1 WHEN 4 THEN -2 END AS c FROM human)"))
def human_scores(spark: SparkSession, d: str) -> DataFrame:
    """Choices dealt by row, sides swapped on odd rows."""
    choice = F.element_at(F.array(*(F.lit(c) for c in (*L.CHOICES, "SKIP"))), (F.col("row_id") % 6 + 1).cast("int"))
    return _human(spark, d).select("row_id", L.human_score(choice, F.col("row_id") % 2 == 1).alias("score"))


@query(
    """SELECT k % 8 AS "case", CASE k % 8 WHEN 0 THEN 'ok' WHEN 1 THEN 'Unexpected judge fields' WHEN 2 THEN 'Invalid judge version/winner' WHEN 3 THEN 'Invalid JSON'
 WHEN 4 THEN 'Score must be integer in 0..4' WHEN 5 THEN 'Dimension needs evidence citation' WHEN 6 THEN 'Invalid JSON' ELSE 'Missing pairwise reason' END AS error, count(*) AS n FROM (SELECT event_id AS k FROM events) GROUP BY ALL"""
)
def strict_parse_status(spark: SparkSession, d: str) -> DataFrame:
    """A valid response and seven faults, dealt over the events, through the strict parser."""
    dim = '{"status":"scored","score":3,"reason":"r","evidence_ids":["E1"]}'
    side = f'{{"P":{dim},"R":{dim},"N":{dim}}}'
    good = f'{{"protocol":"style-pairwise","winner":"A","scores":{{"A":{side},"B":{side}}},"reason":"why","preference_evidence_ids":["E1"]}}'
    cases = [
        good,
        good[:-1] + ',"more":1}',
        good.replace('"winner":"A"', '"winner":"C"'),
        good.replace('"reason":"why"', '"reason":"why","reason":"two"'),
        good.replace('"score":3', '"score":3.0', 1),
        good.replace('"reason":"r","evidence_ids":["E1"]', '"reason":"r","evidence_ids":[]', 1),
        good + " {}",
        good.replace('"reason":"why"', '"reason":" "'),
    ]
    k = F.col("event_id") % 8
    raw = F.element_at(F.array(*(F.lit(c) for c in cases)), (k + 1).cast("int"))
    error = strict_json.pair_error(raw, F.array(*(F.lit(x) for x in ("E1", "E2", "E3", "candidate:A", "candidate:B"))))
    return table(spark, d, "events").select(k.alias("case"), F.coalesce(error, F.lit("ok")).alias("error")).groupBy("case", "error").agg(F.count(F.lit(1)).alias("n"))


@query(over("suite", "SELECT split, count(*) AS rows, count(DISTINCT template) AS templates, 0 AS shared FROM suite GROUP BY split"))
def suite_split_disjoint(spark: SparkSession, d: str) -> DataFrame:
    s = demo.suite(spark, d)
    shared = I.shared_templates(s).agg(F.count(F.lit(1)).cast("int").alias("shared"))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("template").alias("templates")).join(F.broadcast(shared))


@query("SELECT doc_id, 'row_without_reply' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'reply_without_row' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    return I.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return I.duplicates(table(spark, d, "conversations"), "conv_id")


@query("SELECT DISTINCT event_id // 100 AS serial FROM events WHERE event_id // 100 > 10")
def superseded_batches(spark: SparkSession, d: str) -> DataFrame:
    return W.superseded(table(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("serial")).distinct(), 10)


@query("SELECT max(step) AS step FROM (SELECT event_id // 50 AS step FROM events WHERE event_type <> 'error' GROUP BY 1 HAVING count(DISTINCT event_id % 4) = 4)")
def latest_complete_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter("event_type <> 'error'")
    return W.latest_complete(e.select(F.floor(F.col("event_id") / 50).alias("step"), (F.col("event_id") % 4).alias("rank")), 4)


@query(over("final", "SELECT count(*) FILTER (WHERE verdict = 1) AS wins, count(*) FILTER (WHERE verdict = 0) AS losses FROM final"))
def win_loss_counts(spark: SparkSession, d: str) -> DataFrame:
    j, _ = _judged(spark, d)
    return S.sign_test(j, F.col("verdict") == 1.0, F.col("verdict") == 0.0).drop("p_value")


@query(
    """WITH c AS (SELECT count(*) FILTER (WHERE quality = 1) AS wins, count(*) FILTER (WHERE quality = 0) AS losses FROM labels),
t AS (SELECT wins, losses, wins + losses AS n, unnest(range(0, least(wins, losses) + 1)) AS i FROM c)
SELECT any_value(wins) AS wins, any_value(losses) AS losses, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) AS p_value FROM t"""
)
def sign_test(spark: SparkSession, d: str) -> DataFrame:
    """All labels as a paired trial of good against bad."""
    return S.sign_test(table(spark, d, "labels"), F.col("quality") == 1, F.col("quality") == 0)


@query(
    over(
        "scored",
        """, c AS (SELECT count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE NOT x AND y) AS c FROM (SELECT hard IS NOT NULL AS x, length(reply) > 500 AS y FROM scored)),
t AS (SELECT b, c, b + c AS n, unnest(range(0, least(b, c) + 1)) AS i FROM c)
SELECT any_value(b) AS only_first, any_value(c) AS only_second, round(any_value((b - c) * (b - c) / (b + c)), 6) AS chi2, round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) AS p_value FROM t""",
    ).replace("\n, c AS", ", c AS")
)
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return S.mcnemar(s, F.col("hard").isNotNull(), F.length("reply") > 500)


@query(over("per_batch", f"SELECT (SELECT {mean6('style_score_mean')} FROM (SELECT * FROM per_batch ORDER BY batch LIMIT 20)) AS first_mean, (SELECT {mean6('style_score_mean')} FROM (SELECT * FROM per_batch ORDER BY batch DESC LIMIT 20)) AS last_mean"))
def curve_first_last(spark: SparkSession, d: str) -> DataFrame:
    return S.curve_ends(_metrics(spark, d), "batch", "style_score_mean")


@query(over("per_batch", f"SELECT batch // 10 AS block, count(*) AS steps, {mean6('style_score_mean')} AS block_mean FROM per_batch GROUP BY 1"))
def curve_blocks(spark: SparkSession, d: str) -> DataFrame:
    return S.curve_blocks(_metrics(spark, d), "batch", "style_score_mean")


@query(over("cleaned", "SELECT character, CAST(sum(n) AS BIGINT) AS replies, count(*) AS distinct_replies, round(count(*) / sum(n), 6) AS distinct_ratio, round(max(n) / sum(n), 6) AS top_share FROM (SELECT character, reply, count(*) AS n FROM cleaned GROUP BY ALL) GROUP BY character"))
def collapse_monitor(spark: SparkSession, d: str) -> DataFrame:
    return S.collapse(_scored(spark, d), "character")


@query(over("cleaned", "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY character ORDER BY n DESC, reply) AS INTEGER) AS rank FROM (SELECT character, reply, count(*) AS n FROM cleaned GROUP BY ALL)) WHERE rank <= 5"))
def top_replies(spark: SparkSession, d: str) -> DataFrame:
    return S.top_replies(_scored(spark, d), "character", 5)


@query("SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY md5('s|' || doc_id), doc_id LIMIT 50")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """Fifty documents; the limit is the feature."""
    return L.hash_sample(table(spark, d, "documents").select("doc_id").distinct(), "s", "doc_id", 50)


@query()
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Seeded Poisson bootstrap of Pearson's r."""
    return S.bootstrap_pearson(_human(spark, d).select(F.col("row_id").alias("key"), "human", "judge"), draws=100)


@query()
def reply_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Edit distances count code points; the SQL engine's count bytes, so a test checks it instead."""
    return _scored(spark, d).select("row_id", F.round(S.similarity(F.col("reply"), F.col("base")), 6).alias("similarity"))


@query("SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, regexp_extract(html, 'var t=\"([^\"]*)\"', 1) AS payload FROM pages")
def page_payload(spark: SparkSession, d: str) -> DataFrame:
    """What a page embeds: its heading and the string that its script assigns."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), F.regexp_extract("html", 'var t="([^"]*)"', 1).alias("payload"))


@query("SELECT event_id, event_type = 'error' AND (s IN (408, 429) OR s >= 500) AS transient FROM (SELECT *, [200, 404, 408, 429, 500, 503, 400][CAST(event_id % 7 + 1 AS INTEGER)] AS s FROM events)")
def transient_errors(spark: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*(F.lit(s) for s in (200, 404, 408, 429, 500, 503, 400))), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", ((F.col("event_type") == "error") & I.transient(status, F.lit(None).cast("string"))).alias("transient"))


@query()
def judge_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Pair, attribution and policy prompts of every sample that can be asked, with their citation ids."""
    s = _scored(spark, d).filter("trim(reply) <> '' and trim(base) <> ''")
    c, args = F.col("character"), [F.col(x) for x in ("situation", "speaker", "line")]
    items = evidence(demo.RULES, c, *args)
    pair = within_budget(pair_payload(demo.RULES, c, items, F.col("reply"), F.col("base")), 1 << 20)
    return s.select("row_id", pair.alias("pair"), attribution_payload(demo.RULES, F.lit(False), *args, F.col("reply")).alias("attribution"), policy_prompt(demo.RULES, c, *args).alias("prompt"), F.array_join(allowed_citations(items), ",").alias("citations"))


@query(
    over(
        "stub",
        """SELECT attempts, status, count(*) AS n FROM (SELECT DISTINCT batch, rank, key, CASE WHEN h IN ('0', '4') THEN 2 ELSE 1 END AS attempts, CASE WHEN h = '0' THEN 'parse_error' ELSE 'ok' END AS status FROM stub) GROUP BY ALL""",
    )
)
def judge_retries(spark: SparkSession, d: str) -> DataFrame:
    """One request in sixteen is unreadable twice, one more only at first: attempts and final status."""
    h = F.substring(F.md5(F.col("key").cast("binary")), 1, 1)
    judge = P.retried(P.flaky(P.stub_judge, h == "4", h == "0"))
    return judge(P.pending(P.requests(_scored(spark, d)))).groupBy(F.size("attempts").alias("attempts"), "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    over(
        "cleaned",
        """, o AS (SELECT DISTINCT row_id, reply FROM cleaned WHERE reply <> base),
t AS (SELECT * FROM o ORDER BY md5('s|test|' || row_id), row_id LIMIT 30),
u AS (SELECT * FROM o WHERE row_id % 2 = 0 AND row_id NOT IN (SELECT row_id FROM t) ORDER BY md5('s|train|' || row_id), row_id LIMIT 40),
v AS (SELECT * FROM o WHERE length(reply) > 20 AND row_id NOT IN (SELECT row_id FROM t) AND row_id NOT IN (SELECT row_id FROM u) ORDER BY md5('s|opener|' || row_id), row_id LIMIT 30)
SELECT kind, count(*) AS n, CAST(sum(row_id % 1000) AS BIGINT) AS row_sum FROM (SELECT 'test' AS kind, row_id FROM t UNION ALL SELECT 'train', row_id FROM u UNION ALL SELECT 'opener', row_id FROM v) GROUP BY kind""",
    ).replace("\n, o AS", ", o AS")
)
def label_set_kinds(spark: SparkSession, d: str) -> DataFrame:
    """A label set of three kinds, none of which repeats a pair of another; the sizes are the feature."""
    s = _scored(spark, d).filter(F.col("reply") != F.col("base")).select("row_id", "reply", "base")
    chosen = L.label_set([("test", s, 30), ("train", s.filter("row_id % 2 = 0"), 40), ("opener", s.filter("length(reply) > 20"), 30)], "s")
    return chosen.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("row_id") % 1000).alias("row_sum"))


@query(over("final", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN status IN ('hard', 'identical') THEN 'skipped ' || status WHEN status <> 'ok' THEN unusable WHEN order_inconsistent THEN 'order_inconsistent' END AS reason FROM final) WHERE reason IS NOT NULL GROUP BY reason"))
def order_probe_reasons(spark: SparkSession, d: str) -> DataFrame:
    return E.order_probe_reasons(_judged(spark, d)[0])


@query(over("scored", "SELECT hard AS reason, count(*) AS n FROM scored WHERE hard IS NOT NULL AND length(trim(reply)) > 0 GROUP BY hard"))
def base_violation_hist(spark: SparkSession, d: str) -> DataFrame:
    """All cleaned replies that hold anything, as base replies."""
    rows = _scored(spark, d).select("character", "reply").filter(F.length(F.trim("reply")) > 0)
    return E.base_violations(rows, demo.RULES)


_TRIGRAMS = r"""SELECT character, array_to_string(w[i:i + 2], ' ') AS phrase, count(*) AS n FROM (SELECT character, w, unnest(range(1, len(w) - 1)) AS i FROM (
 SELECT character, regexp_extract_all(reply, '[^\x20\x09-\x0D]+') AS w FROM cleaned) WHERE len(w) >= 3) GROUP BY ALL"""


@query(over("cleaned", f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY character ORDER BY n DESC, phrase) AS INTEGER) AS rank FROM ({_TRIGRAMS})) WHERE rank <= 10"))
def top_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent phrases of three words of each persona; ten is the feature."""
    return S.top_phrases(written(_scored(spark, d).select("character", "reply")), "character", 10)


@query(over("per_batch", f"SELECT {mean6('win_rate_vs_base')} AS last_mean FROM (SELECT * FROM per_batch ORDER BY batch DESC LIMIT 50)"))
def curve_last_fifty(spark: SparkSession, d: str) -> DataFrame:
    """Mean win rate of the last fifty batches; fifty is the feature."""
    return S.curve_ends(_metrics(spark, d), "batch", "win_rate_vs_base", 50).select("last_mean")


@query(
    over(
        "scored",
        """SELECT CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS last, count(DISTINCT row_id // 40000000000) AS steps, round(avg(CAST(length(reply) < 40 AS DOUBLE)), 6) AS share
 FROM scored JOIN (VALUES (0, 4), (5, 9), (0, 1000000)) v(a, b) ON row_id // 40000000000 BETWEEN a AND b GROUP BY a, b""",
    )
)
def short_reply_windows(spark: SparkSession, d: str) -> DataFrame:
    """Share of short replies by windows of passes over the corpus."""
    return S.window_shares(_scored(spark, d).withColumn("step", F.floor(F.col("row_id") / demo.SPAN)), "step", F.length("reply") < 40, [(0, 4), (5, 9), (0, 1_000_000)])


_HALVES = """SELECT grp, k, md5(concat_ws(chr(31), '=' || CAST(pos AS VARCHAR), '=' || reply, '=' || CAST(round(style, 3) AS DECIMAL(9, 3)))) AS h FROM (
 SELECT *, unnest([0, 1]) AS k FROM (SELECT doc_id, pos, reply, style, doc_id AS grp FROM (SELECT row_id % 40000000000 AS doc_id, row_id // 40000000000 AS pos, reply, style FROM scored))) WHERE k = 0 OR grp % 7 <> 3 OR pos <> 0"""


@query(
    over(
        "scored",
        f"""SELECT grp, count(*) AS ranks, count(DISTINCT (n, a, b, c, d)) = 1 AS agree FROM (
 SELECT grp, k, count(*) AS n, {", ".join(f"sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS {c}" for i, c in enumerate("abcd"))} FROM ({_HALVES}) GROUP BY ALL) GROUP BY grp""",
    )
)
def rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two ranks score every document's lines; the second loses the first line of one document in seven."""
    s = _scored(spark, d).select((F.col("row_id") % demo.SPAN).alias("grp"), F.floor(F.col("row_id") / demo.SPAN).alias("pos"), "reply", F.col("style").cast("decimal(9,3)").alias("style"))
    both = s.withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1)))).filter("rank = 0 or grp % 7 <> 3 or pos <> 0")
    return I.rank_agreement(both, ["grp"], "rank", ["pos", "reply", "style"])


@query(
    over(
        "asked",
        """SELECT status, winner, CAST(CASE status WHEN 'inference_error' THEN 2 ELSE 1 END AS INTEGER) AS attempts, count(*) AS calls FROM (
 SELECT status, CASE WHEN status = 'ok' THEN CASE WHEN a > b THEN 'A' WHEN a < b THEN 'B' ELSE 'tie' END END AS winner FROM (
  SELECT *, CASE WHEN a % 13 = 0 THEN 'inference_error' WHEN b % 11 = 0 THEN 'parse_error' ELSE 'ok' END AS status FROM (
   SELECT DISTINCT batch, rank, key, length(shown_a) AS a, length(shown_b) AS b FROM asked WHERE trim(shown_a) <> '' AND trim(shown_b) <> ''))) GROUP BY ALL""",
    )
)
def outside_judge_calls(spark: SparkSession, d: str) -> DataFrame:
    """All requests of all samples through a client asked from Spark's tasks, its answers recorded and strictly parsed."""
    pending = P.pending(P.requests(written(_scored(spark, d)))).filter("trim(shown_a) <> '' and trim(shown_b) <> ''")
    items = evidence(demo.RULES, F.col("character"), F.col("situation"), F.col("speaker"), F.col("line"))
    payload = pair_payload(demo.RULES, F.col("character"), items, F.col("shown_a"), F.col("shown_b"))
    record = shared_folder(spark, "answers")
    judge = outside_judge(payload, allowed_citations(items), demo.chat, record, buckets=256, every=4096, attempts=2)
    return judge(pending).groupBy("status", "winner", "attempts").agg(F.count(F.lit(1)).alias("calls"))
