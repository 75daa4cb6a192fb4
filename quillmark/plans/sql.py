"""The queries' SQL oracles: the same figures from the same tables, written apart from the Spark code."""

from __future__ import annotations

_A = {"markers": ("the", "and", "tion"), "anti": ("que", "ç", "!"), "open": ("The", "And"), "foreign": (), "other": "Bruno", "soft": (20, 200, 600)}
_B = {"markers": ("que", "eau", "ç"), "anti": ("the", "and", "!"), "open": ("Le", "De"), "foreign": ("###",), "other": "Alba", "soft": (20, 120, 400)}


def mean6(x: str) -> str:
    return f"floor((2 * sum(CAST(round({x} * 1e6) AS BIGINT)) + count({x})) / (2e0 * count({x}))) / 1e6"


def _has(x: str, parts) -> str:
    return "(" + (" OR ".join(f"contains({x}, '{p}')" for p in parts) or "false") + ")"


def _starts(x: str, parts) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in parts) + ")"


def _mt(x: str) -> str:
    return rf"regexp_replace({x}, '\.{{3,}}|…+', '……', 'g')"


def _count(x: str, m: str) -> str:
    return f"((length({x}) - length(replace({x}, '{m}', ''))) // {len(m)})"


def _clean(raw: str) -> str:
    strip = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    x = strip(rf"regexp_replace({raw}, '^\s*<think>\s*</think>\s*', '')")
    inner = f"substring({x}, 2, length({x}) - 2)"
    return f"CASE WHEN length({x}) > 2 AND starts_with({x}, '「') AND ends_with({x}, '」') AND NOT contains({inner}, '「') AND NOT contains({inner}, '」') THEN {strip(inner)} ELSE {x} END"


def _hard(p: dict) -> str:
    counts = [_count("m", x) for x in p["markers"]]
    return f"""CASE WHEN length(reply) < 1 OR length(reply) > 600 THEN 'length' WHEN contains(reply, chr(10)) THEN 'multi_line'
      WHEN contains(reply, '|') THEN 'out_of_character'
      WHEN {_has("reply", p["foreign"])} OR contains(reply, 'I am {p["other"]}') THEN 'impersonation'
      WHEN regexp_matches(reply, '^[^，。！？\\s]{{1,6}}[：:]') AND {_starts("reply", ("Alba", "Bruno"))} THEN 'speaker_prefix'
      WHEN greatest({", ".join(counts)}) > 2 OR {" + ".join(counts)} > 4 THEN 'catchphrase_cap' END"""


def _style(p: dict, text: str) -> str:
    m, (lo, hi, zero) = _mt(text), p["soft"]
    present = " + ".join(f"CAST(contains({m}, '{x}') AS INTEGER)" for x in p["markers"])
    length = f"CASE WHEN length({text}) < {lo} THEN 0.5e0 WHEN length({text}) <= {hi} THEN 1e0 ELSE greatest(0e0, 1e0 - (length({text}) - {hi}) / {float(zero - hi)}e0) END"
    return f"round(0.4e0 * (least({present}, 2) / 2e0) + 0.3e0 * (CASE WHEN {_has(m, p['anti'])} THEN 0e0 ELSE 1e0 END) + 0.3e0 * ({length}), 6)"


def _by(make) -> str:
    return f"CASE WHEN character = 'a' THEN {make(_A)} ELSE {make(_B)} END"


CTES = {
    "raw": """SELECT row_id, row_id // 40 AS batch, (row_id % 40) // 20 AS rank, row_id % 20 AS pos, row_id // 8 AS grp,
      CASE WHEN lang IN ('en', 'de') THEN 'a' ELSE 'b' END AS character, source AS situation, lang AS speaker, 'line' AS line, l, row_id % 20 AS k FROM (
      SELECT doc_id + 40000000000 * (generate_subscripts(ls, 1) - 1) AS row_id, lang, source, unnest(ls) AS l FROM (
        SELECT *, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))""",
    "decorated": """SELECT * EXCLUDE (l, k), CASE k WHEN 1 THEN '「' || l || '」' WHEN 2 THEN '<think>' || chr(10) || '</think>' || chr(10) || l WHEN 3 THEN 'Alba:' || l
      WHEN 4 THEN l || '....' WHEN 5 THEN l || '…' WHEN 6 THEN l || chr(10) || 'next' WHEN 7 THEN 'I am Alba, I am Bruno. ' || l ELSE l END AS given FROM raw""",
    "based": "SELECT *, first_value(given) OVER (PARTITION BY grp ORDER BY row_id) AS given_base FROM decorated",
    "cleaned": f"SELECT *, {_clean('given')} AS reply, {_clean('given_base')} AS base FROM based",
    "marked": f"SELECT *, {_mt('reply')} AS m FROM cleaned",
    "scored": f"SELECT *, {_by(_hard)} AS hard, {_by(lambda p: _style(p, 'reply'))} AS style, {_by(lambda p: _style(p, 'base'))} AS base_style FROM marked",
    "asked": """SELECT *, sha256(concat_ws(chr(31), 'style-pairwise', character, situation, speaker, line, shown_a, shown_b)) AS key FROM (
      SELECT *, CASE WHEN reverse THEN base ELSE reply END AS shown_a, CASE WHEN reverse THEN reply ELSE base END AS shown_b,
        CASE WHEN reverse THEN base_style ELSE style END AS style_a, CASE WHEN reverse THEN style ELSE base_style END AS style_b
      FROM scored, (VALUES (false), (true)) v(reverse) WHERE hard IS NULL AND reply <> base)""",
    "stub": """SELECT *, CASE WHEN style_a > style_b THEN 'A' WHEN style_a < style_b THEN 'B' ELSE 'tie' END AS w,
      CAST(round_even(4 * style_a, 0) AS INTEGER) AS p, CAST(round_even(4 * style_b, 0) AS INTEGER) AS q, substr(md5(key), 1, 1) AS h FROM asked""",
    "judged": """SELECT *, CASE WHEN h = '0' THEN 'parse_error' ELSE 'ok' END AS status,
      CASE WHEN h = '0' THEN NULL WHEN h = '1' THEN 'insufficient' WHEN h IN ('2', '3') THEN 'A' ELSE w END AS winner,
      CASE WHEN h IN ('0', '1') THEN NULL WHEN h IN ('2', '3') THEN 4 ELSE p END AS a_p, CASE WHEN h = '0' THEN NULL WHEN h IN ('2', '3') THEN 2 ELSE q END AS b_p FROM stub""",
    "sides": """SELECT row_id, max(CASE WHEN NOT reverse THEN status END) AS s1, max(CASE WHEN reverse THEN status END) AS s2,
      bool_or(h = '1') AS unsure, max(CASE WHEN NOT reverse THEN a_p - b_p END) AS g1, max(CASE WHEN reverse THEN b_p - a_p END) AS g2,
      max(CASE WHEN NOT reverse THEN a_p + 6 END) AS p1, max(CASE WHEN reverse THEN b_p + 6 END) AS p2,
      max(CASE WHEN NOT reverse THEN b_p + 6 END) AS b1, max(CASE WHEN reverse THEN a_p + 6 END) AS b2,
      max(CASE WHEN NOT reverse THEN winner END) AS w1, max(CASE WHEN reverse THEN CASE winner WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE winner END END) AS w2
      FROM judged GROUP BY row_id""",
    "outcome": """SELECT *, CASE WHEN unusable IS NULL THEN round((g1 + g2) / 24e0, 6) END AS margin, CASE WHEN unusable IS NULL THEN abs(g1 - g2) END AS order_margin_gap,
      CASE WHEN unusable IS NULL THEN (p1 + p2) / 2e0 END AS policy_prn, CASE WHEN unusable IS NULL THEN (b1 + b2) / 2e0 END AS base_prn,
      CASE WHEN unusable IS NULL THEN CASE WHEN w1 <> w2 THEN 0.5e0 WHEN w1 = 'A' THEN 1e0 WHEN w1 = 'B' THEN 0e0 ELSE 0.5e0 END END AS verdict,
      CASE WHEN unusable IS NULL THEN w1 <> w2 END AS order_inconsistent
      FROM (SELECT *, CASE WHEN s1 <> 'ok' THEN 'AB ' || s1 WHEN s2 <> 'ok' THEN 'BA ' || s2 WHEN unsure THEN 'insufficient' END AS unusable FROM sides)""",
    "final": """SELECT *, CASE status WHEN 'hard' THEN -1e0 WHEN 'identical' THEN 0e0 ELSE margin END AS value FROM (
      SELECT scored.*, outcome.* EXCLUDE (row_id), CASE WHEN hard IS NOT NULL THEN 'hard' WHEN reply = base THEN 'identical' WHEN unusable IS NOT NULL THEN 'unusable' ELSE 'ok' END AS status
      FROM scored LEFT JOIN outcome USING (row_id))""",
    "grouped": """SELECT batch, grp, count(*) AS members, bool_or(unusable IS NOT NULL) AS rejected,
      arg_min(unusable, rank * 1000 + pos) FILTER (WHERE unusable IS NOT NULL) AS reason, count(DISTINCT value) AS distinct_values FROM final GROUP BY batch, grp""",
    "rewarded": "SELECT final.*, rejected, CASE WHEN NOT rejected THEN value END AS reward FROM final JOIN grouped USING (batch, grp)",
    "reused": "SELECT batch, rank, count(DISTINCT key) AS judge_calls, count(*) - count(DISTINCT key) AS reused_requests FROM asked GROUP BY batch, rank",
    "per_batch": """SELECT f.*, groups, rejected_groups, varied_groups, coalesce(judge_calls, 0) AS judge_calls, coalesce(reused_requests, 0) AS reused_requests FROM (
      SELECT batch, {metrics}, count(*) FILTER (WHERE status = 'hard') AS hard, {value6} AS reward_mean, {margin6} AS margin_mean,
        round(avg(CASE WHEN status = 'ok' THEN CAST(margin > 0 AS DOUBLE) END), 6) AS margin_positive_rate, round(avg(policy_prn), 6) AS policy_prn_mean, round(avg(base_prn), 6) AS base_prn_mean,
        round(avg(CAST(status = 'identical' AS DOUBLE)), 6) AS identical_rate, count(*) FILTER (WHERE status = 'identical') AS skipped_identical, round(avg(verdict), 6) AS win_rate_vs_base,
        count(*) FILTER (WHERE order_inconsistent) AS order_inconsistent, round(avg(CASE WHEN status = 'ok' THEN CAST(order_inconsistent AS DOUBLE) END), 6) AS order_inconsistent_rate, 0 AS off_topic
      FROM final GROUP BY batch) f
      JOIN (SELECT batch, count(*) AS groups, count(*) FILTER (WHERE rejected) AS rejected_groups, count(*) FILTER (WHERE NOT rejected AND distinct_values > 1) AS varied_groups FROM grouped GROUP BY batch) g USING (batch)
      LEFT JOIN (SELECT batch, CAST(sum(judge_calls) AS BIGINT) AS judge_calls, CAST(sum(reused_requests) AS BIGINT) AS reused_requests FROM reused GROUP BY batch) r USING (batch)""",
    "suite": """SELECT CAST(u.conv_id AS VARCHAR) || '-L' || CAST(u.turn AS VARCHAR) AS row_id, u.conv_id AS template, u.text AS line, a.text AS reply,
      CASE WHEN substr(md5(CAST(u.conv_id AS VARCHAR)), 1, 1) < '4' THEN 'test' ELSE 'train' END AS split
      FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
    "human": """SELECT f.row_id, f.character, CASE WHEN l.quality = 1 THEN 1 ELSE -1 END AS human, round(f.style - 0.6e0, 6) AS judge
      FROM scored f JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON l.doc_id = f.row_id % 40000000000""",
}

METRICS = f"""count(*) AS samples, round(avg(CAST(hard IS NOT NULL AS DOUBLE)), 6) AS hard_violation_rate,
  round(avg(CASE WHEN character = 'a' THEN CAST(starts_with(reply, 'Th') AS DOUBLE) END), 6) AS self_title_open_rate,
  round(avg(CAST({_by(lambda p: _starts("m", p["open"]))} AS DOUBLE)), 6) AS stock_opener_rate, {mean6('style')} AS style_score_mean,
  round(avg(length(reply)), 6) AS length_mean, round(avg(CAST({_by(lambda p: _has("m", p["markers"]))} AS DOUBLE)), 6) AS marker_rate"""
CTES["per_batch"] = CTES["per_batch"].replace("{metrics}", METRICS).replace("{value6}", mean6("value")).replace("{margin6}", mean6("margin"))

#: What each named table is built from, in order.
ORDER = ("raw", "decorated", "based", "cleaned", "marked", "scored", "asked", "stub", "judged", "sides", "outcome", "final", "grouped", "rewarded", "reused", "per_batch")
SHORT = {"suite": ("suite",), "human": (*ORDER[:6], "human")}


def over(name: str, query: str, *more: str) -> str:
    """``query`` with every table that ``name`` needs, and further (name, body) pairs."""
    need = SHORT.get(name) or ORDER[: ORDER.index(name) + 1]
    parts = [f"{n} AS ({CTES[n]})" for n in need]
    return "WITH " + ",\n".join([*parts, *more]) + "\n" + query
