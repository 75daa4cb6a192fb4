"""URL filters: explicit rules first, then path templates judged by smoothed labelled purity.

Per host, paths form a tree of segments. Level by level, a node with more than ``fan`` different
children has a variable segment: its children become wildcards by shape (digits as ``#``), or ``*``
where even the shapes are more than ``fan``. Segments beyond ``depth`` levels form one last segment.
Then, again from the host down, branches of a node whose labelled shares do not differ significantly from
their siblings' together are merged into one branch ``~``, inner nodes as well as leaves, so that what lies
below them shares its evidence. A merged template without labels takes the evidence of the nearest node
above it whose labelled branches are all similar, merged into one or at least two; one labelled branch alone says nothing of
the others. A template is rejected if it has evidence and its purity, (bad + weight * prior) /
(labelled + weight) with the labels' overall share as prior, reaches ``reject``; without, it is allowed.

All steps are aggregations with map-side combine and joins by (host, template), which adaptive
execution splits where one host holds much of the table. A host has at most fan ** depth templates. Only
the prior, one row, comes to the driver.

Defined results: a null url, or one without "://", has an empty host and path and is judged like any
other host; repeated rows are judged alike and each counts; without labels everything is allowed; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = _rest(url)
    return F.coalesce(common.ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits; null if none does."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        ok = fits(r, host, path)
        name = F.when(ok, r.name) if name is None else name.when(ok, r.name)
        verdict = F.when(ok, r.verdict) if verdict is None else verdict.when(ok, r.verdict)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def _shape(segment: Column) -> Column:
    return F.regexp_replace(segment, "[0-9]+", "#")


def templates(rows: DataFrame, depth: int, fan: int) -> DataFrame:
    """Adds ``template``, as a text and as an array of ``steps``, to rows with host and path."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    tail = F.when(F.size("parts") > depth, F.concat(F.slice("parts", 1, depth - 1), F.array(F.array_join(F.slice(F.col("parts"), F.lit(depth), F.greatest(F.size("parts"), F.lit(1))), "/"))))
    now = rows.withColumn("parts", parts).withColumn("parts", F.coalesce(tail, F.col("parts")))
    now = now.withColumn("template", F.lit("")).withColumn("steps", F.array().cast("array<string>"))
    for level in range(depth):
        segment = F.col("parts")[level]
        deep = F.size("parts") > level
        shapes = now.filter(deep).groupBy("host", "template", segment.alias("segment")).agg(F.count(F.lit(1)).alias("n"))
        shapes = shapes.groupBy("host", "template", _shape(F.col("segment")).alias("shape")).agg(F.count(F.lit(1)).alias("children"))
        nodes = shapes.groupBy("host", "template").agg(F.sum("children").alias("children"), F.count(F.lit(1)).alias("shapes"))
        wild = nodes.filter(F.col("children") > fan)
        joined = now.join(wild, ["host", "template"], "left")
        step = F.when(F.col("children").isNull(), segment).when(F.col("shapes") > fan, F.lit("*")).otherwise(_shape(segment))
        now = joined.withColumn("steps", F.when(deep, F.array_append("steps", step)).otherwise(F.col("steps")))
        now = now.withColumn("template", F.when(deep, F.concat("template", F.lit("/"), step)).otherwise(F.col("template"))).drop("children", "shapes")
        now = common.materialise(now, f"level{level}", small=True)
    return now


def _similar(least: int, z: float) -> Column:
    """Whether a branch (known, bad) and the others of its family (all_known, all_bad) have evidence that does not differ."""
    others, other_bad = F.col("all_known") - F.col("known"), F.col("all_bad") - F.col("bad")
    share = F.col("all_bad") / F.greatest("all_known", F.lit(1))
    gap = F.abs(F.col("bad") / F.greatest("known", F.lit(1)) - other_bad / F.greatest(others, F.lit(1)))
    noise = F.sqrt(share * (1 - share) * (1 / F.greatest("known", F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
    return (F.col("known") >= least) & (others >= least) & (gap <= z * noise)


def _node(steps: Column, level: int) -> Column:
    """The node ``level`` segments below the host."""
    return F.slice(steps, 1, level)


def merge_branches(leaves: DataFrame, depth: int, least: int, z: float) -> DataFrame:
    """Adds ``merged``, the steps of each template (host, steps, known, bad) with similar branches as ``~``."""
    now = leaves.withColumn("merged", F.col("steps"))
    for level in range(depth):
        at = now.withColumns({"node": _node(F.col("merged"), level), "below": F.get("merged", F.lit(level))})
        branches = at.filter("below is not null").groupBy("host", "node", "below").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad"))
        family = branches.groupBy("host", "node").agg(F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"))
        alike = branches.join(family, ["host", "node"]).filter(_similar(least, z)).select("host", "node", "below", F.lit(True).alias("alike"))
        joined = at.join(alike, ["host", "node", "below"], "left")
        rest = F.slice("merged", F.lit(level + 2), F.greatest(F.size("merged") - level - 1, F.lit(0)))
        one = F.when(F.col("alike"), F.concat(F.col("node"), F.array(F.lit("~")), rest)).otherwise(F.col("merged"))
        now = common.materialise(joined.withColumn("merged", one).drop("node", "below", "alike"), f"merged{level}", small=True)
    return now


def _agreed(pooled: DataFrame, level: int, least: int, z: float) -> DataFrame:
    """The inner nodes of a level whose branches of evidence are all similar, two or more or merged into one, and their evidence."""
    at = pooled.select("host", _node(F.col("merged"), level).alias("node"), _node(F.col("merged"), level + 1).alias("below"), "known", "bad")
    branches = at.groupBy("host", "node", "below").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")).filter(F.col("known") > 0)
    family = branches.groupBy("host", "node").agg(F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"))
    held = branches.join(family, ["host", "node"]).groupBy(F.col("host").alias("a_host"), F.col("node").alias("a_node"))
    agreed = held.agg(F.sum("known").alias("a_known"), F.sum("bad").alias("a_bad"), F.count(F.lit(1)).alias("branches"), F.every(_similar(least, z)).alias("alike"), F.every(F.coalesce(F.try_element_at("below", F.lit(-1)) == "~", F.lit(False))).alias("one"))
    return agreed.filter(((F.col("branches") > 1) & F.col("alike")) | ((F.col("branches") == 1) & F.col("one"))).drop("branches", "alike", "one")


def judge(pages: DataFrame, rules: list[Rule], bad: Column | None = None, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", depth: int = 4, fan: int = 16, weight: float = 10.0, reject: float = 0.8, least: int = 5, z: float = 1.96) -> DataFrame:
    """page id, host, path, rule, verdict, template, merged (steps), known, purity, one row per page.

    A page's label is the expression ``bad`` over ``pages`` (1, 0 or null) where that is given; else what
    ``labelled`` (url, bad) says of its host and path, where that is given; else its rule's verdict.
    """
    url = F.col(f"`{url_col}`")
    told = F.lit(None).cast("double") if bad is None else bad.cast("double")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), told.alias("told"))
    name, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", name).withColumn("ruled", verdict)
    if labelled is not None:
        known = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("bad").cast("double").alias("bad"))
        rows = rows.join(known.groupBy("host", "path").agg(F.avg("bad").alias("heard")), ["host", "path"], "left").withColumn("told", F.coalesce("told", "heard"))
    by_rule = (F.col("ruled") == "block").cast("double") if bad is None else F.lit(None).cast("double")
    rows = rows.withColumn("bad", F.coalesce("told", by_rule))
    rows = templates(common.materialise(rows.select("id", "host", "path", "rule", "ruled", "bad"), "urls"), depth, fan)

    leaves = rows.groupBy("host", "template").agg(F.first("steps").alias("steps"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    leaves = merge_branches(leaves, depth, least, z)
    known, n_bad = leaves.agg(F.sum("known"), F.sum("bad")).first()
    prior = n_bad / known if known else 0.0
    pooled = common.materialise(leaves.groupBy("host", "merged").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")), "pooled", small=True)
    judged = pooled
    for level in reversed(range(depth)):
        judged = judged.join(_agreed(pooled, level, least, z), (judged.host == F.col("a_host")) & (_node(F.col("merged"), level) == F.col("a_node")), "left")
        take = (F.col("known") == 0) & F.col("a_known").isNotNull()
        judged = judged.select("host", "merged", F.when(take, F.col("a_known")).otherwise(F.col("known")).alias("known"), F.when(take, F.col("a_bad")).otherwise(F.col("bad")).alias("bad"))
    judged = leaves.select("host", "template", "merged").join(judged, ["host", "merged"])
    judged = judged.withColumn("purity", (F.col("bad") + weight * prior) / (F.col("known") + weight)).drop("bad")
    out = rows.join(judged, ["host", "template"])
    final = F.coalesce("ruled", F.when((F.col("known") > 0) & (F.col("purity") >= reject), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", final.alias("verdict"), "template", "merged", "known", "purity")
