"""The rule engine as Column macros: reply normalisation, violations, style score.

Every macro returns one Column that Catalyst sees whole; lexicons are unrolled into literals, which
stay inside whole-stage code where arrays with lambdas would not.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import Persona, Rules

#: White space as str.strip() takes it: Unicode's, and the four separators that Java leaves out.
SPACE = r"[\s\x1c-\x1f]"
OPEN, CLOSE = "「", "」"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def clean_reply(raw: Column) -> Column:
    """Without a leading empty think block, outer white space, and one pair of quotes around the whole reply."""
    x = strip(F.regexp_replace(raw, rf"(?U)^{SPACE}*<think>{SPACE}*</think>{SPACE}*", ""))
    wrapped = (F.length(x) > 2) & F.startswith(x, F.lit(OPEN)) & F.endswith(x, F.lit(CLOSE))
    inner = F.substring(x, F.lit(2), F.length(x) - 2)
    bare = ~F.contains(inner, F.lit(OPEN)) & ~F.contains(inner, F.lit(CLOSE))
    return F.when(wrapped & bare, strip(inner)).otherwise(x)


def marker_text(reply: Column) -> Column:
    """Runs of three or more dots and of ellipses all become one double ellipsis, for matching only."""
    return F.regexp_replace(reply, r"\.{3,}|…+", "……")


def occurrences(x: Column, part: str) -> Column:
    """Occurrences of ``part`` that do not overlap."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns so that each is computed once. Plain projections are merged by the
    optimizer, which would repeat these expressions in every place that names them; a generator is not."""
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def total(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values, F.lit(0))


def contains_any(x: Column, parts: tuple[str, ...]) -> Column:
    return any_of([F.contains(x, F.lit(p)) for p in parts])


def starts_any(x: Column, parts: tuple[str, ...]) -> Column:
    return any_of([F.startswith(x, F.lit(p)) for p in parts])


def per_persona(rules: Rules, character: Column, make: Callable[[Persona], Column]) -> Column:
    """The macro of whichever persona the row is about; null for an unknown one."""
    a, b = rules.personas
    return F.when(character == a.key, make(a)).when(character == b.key, make(b))


def hard_violation(rules: Rules, reply: Column, character: Column, text: Column | None = None) -> Column:
    """The first rule that the reply breaks, or null. ``text``: its marker_text(), if at hand."""
    text = marker_text(reply) if text is None else text

    def chain(p: Persona) -> Column:
        other = rules.other(p)
        counts = [occurrences(text, m) for m in p.markers]
        most = F.greatest(F.lit(0), F.lit(0), *counts)
        names = p.aliases + other.aliases
        return (
            F.when(~F.length(reply).between(*rules.length), "length")
            .when(F.contains(reply, F.lit("\n")), "multi_line")
            .when(contains_any(reply, rules.out_of_character), "out_of_character")
            .when(contains_any(reply, p.foreign) | contains_any(reply, tuple(rules.claim + a for a in other.aliases)), "impersonation")
            .when(F.rlike(reply, F.lit(r"(?U)^[^，。！？\s\x1c-\x1f]{1,6}[：:]")) & starts_any(reply, names), "speaker_prefix")
            .when((most > rules.marker_cap) | (total(counts) > rules.marker_total_cap), "catchphrase_cap")
        )

    return per_persona(rules, character, chain)


def style_score(rules: Rules, reply: Column, character: Column, text: Column | None = None) -> Column:
    """Share of the tone: markers present (up to two), no marker of the other voice, and length; in [0, 1]."""
    text = marker_text(reply) if text is None else text

    def score(p: Persona) -> Column:
        n = F.length(reply)
        present = total([F.contains(text, F.lit(m)).cast("int") for m in p.markers])
        marker = F.least(present, F.lit(2)) / F.lit(2.0)
        anti = F.when(contains_any(text, p.anti_markers), 0.0).otherwise(1.0)
        slope = F.lit(1.0) - (n - p.soft_max) / F.lit(float(p.zero_at - p.soft_max))
        length = F.when(n < p.soft_min, 0.5).when(n <= p.soft_max, 1.0).otherwise(F.greatest(F.lit(0.0), slope))
        return F.round(F.lit(0.4) * marker + F.lit(0.3) * anti + F.lit(0.3) * length, 6)

    return per_persona(rules, character, score)


def mean6(x: Column) -> Column:
    """Mean of figures that have six decimals, rounded half up to six, in whole millionths: no order of summing and no
    way of rounding doubles can change it."""
    n, millionths = F.count(x), F.sum(F.round(x * 1e6).cast("long"))
    return F.floor((2 * millionths + n) / (F.lit(2.0) * n)) / F.lit(1e6)


def opens_with_stock(rules: Rules, reply: Column, character: Column) -> Column:
    return per_persona(rules, character, lambda p: starts_any(marker_text(reply), p.openers))


def has_marker(rules: Rules, reply: Column, character: Column) -> Column:
    return per_persona(rules, character, lambda p: contains_any(marker_text(reply), p.markers))


def rule_metrics(rules: Rules, reply: Column, character: Column, hard: Column, style: Column) -> list[Column]:
    """Aggregates of a batch of replies; rates of nothing are null, never zero."""
    titled = F.when(character == rules.self_title_persona, F.startswith(reply, F.lit(rules.self_title)).cast("double"))
    return [
        F.count(F.lit(1)).alias("samples"),
        F.round(F.avg(hard.isNotNull().cast("double")), 6).alias("hard_violation_rate"),
        F.round(F.avg(titled), 6).alias("self_title_open_rate"),
        F.round(F.avg(opens_with_stock(rules, reply, character).cast("double")), 6).alias("stock_opener_rate"),
        mean6(style).alias("style_score_mean"),
        F.round(F.avg(F.length(reply)), 6).alias("length_mean"),
        F.round(F.avg(has_marker(rules, reply, character).cast("double")), 6).alias("marker_rate"),
    ]
