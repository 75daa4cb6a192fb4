"""Judge requests: evidence, pair and attribution payloads, their identity, and the policy prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import Rules
from .rules import per_persona

# Protocol names and score dimensions.
PAIR_PROTOCOL = "style-pairwise"
ATTRIBUTION_PROTOCOL = "style-attribution"
DIMENSIONS = ("P", "R", "N")
#: Separates the fields of a request's identity.
FIELD = "\x1f"


def persona_field(rules: Rules, character: Column, field: str) -> Column:
    return per_persona(rules, character, lambda p: F.lit(getattr(p, field)))


def persona_key(rules: Rules, name: Column) -> Column:
    """The key of the persona of that name; an unknown name is an error."""
    a, b = rules.personas
    return F.when(name == a.name, a.key).when(name == b.name, b.key).otherwise(F.raise_error(F.lit("unknown persona name")).cast("string"))


def render_canon(entries: Column) -> Column:
    """Reference lines, one to a line: episode, context and the line itself."""
    return F.array_join(F.transform(entries, lambda e: F.concat(e["episode"], F.lit(" "), e["context"], F.lit(": "), e["line"])), "\n")


def evidence(rules: Rules, character: Column, situation: Column, speaker: Column, line: Column, canon: Column | None = None) -> Column:
    """[(id, text)]: E1 card, E2 situation, E3 the line answered, E4 the own reference lines if given."""
    item = lambda k, text: F.struct(F.lit(k).alias("id"), text.alias("text"))
    card = F.concat(persona_field(rules, character, "name"), F.lit("："), persona_field(rules, character, "card"))
    three = F.array(item("E1", card), item("E2", situation), item("E3", F.concat(speaker, F.lit("："), line)))
    if canon is None:
        return three
    return F.when(canon.isNull(), three).otherwise(F.concat(three, F.array(item("E4", render_canon(canon)))))


def displayed(policy: Column, base: Column, reverse: Column) -> tuple[Column, Column]:
    """What is shown as candidate A and as B."""
    return F.when(reverse, base).otherwise(policy), F.when(reverse, policy).otherwise(base)


def mapping(reverse: Column) -> Column:
    """Displayed label to original label; it stays out of the payload."""
    return F.when(reverse, F.create_map(F.lit("A"), F.lit("B"), F.lit("B"), F.lit("A"))).otherwise(F.create_map(F.lit("A"), F.lit("A"), F.lit("B"), F.lit("B")))


def pair_payload(rules: Rules, character: Column, items: Column, shown_a: Column, shown_b: Column) -> Column:
    """The user message of a pair request. Both candidates must hold more than white space."""
    filled = F.length(F.trim(shown_a)).between(1, 1 << 30) & F.length(F.trim(shown_b)).between(1, 1 << 30)
    body = F.to_json(F.struct(F.lit(PAIR_PROTOCOL).alias("protocol"), persona_field(rules, character, "name").alias("character"), items.alias("evidence"), shown_a.alias("candidate_A"), shown_b.alias("candidate_B")))
    return F.when(filled, body).otherwise(F.raise_error(F.lit("two nonempty candidate texts required")).cast("string"))


def allowed_citations(items: Column) -> Column:
    return F.concat(F.transform(items, lambda e: e["id"]), F.array(F.lit("candidate:A"), F.lit("candidate:B")))


def attribution_payload(rules: Rules, reverse: Column, situation: Column, speaker: Column, line: Column, reply: Column) -> Column:
    """Both cards in either order, and the reply to be attributed."""
    cards = [F.struct(F.lit(p.key).alias("id"), F.lit(p.name).alias("name"), F.lit(p.card).alias("card")) for p in rules.personas]
    order = F.when(reverse, F.array(cards[1], cards[0])).otherwise(F.array(*cards))
    return F.to_json(F.struct(F.lit(ATTRIBUTION_PROTOCOL).alias("protocol"), order.alias("characters"), situation.alias("situation"), F.concat(speaker, F.lit("："), line).alias("interlocutor_line"), reply.alias("reply")))


def policy_prompt(rules: Rules, character: Column, situation: Column, speaker: Column, line: Column) -> Column:
    """Card, situation and line only: no row id, no other card, no reference lines."""
    return F.concat_ws("\n", persona_field(rules, character, "card"), situation, F.concat(speaker, F.lit("："), line))


def identity(*fields: Column) -> Column:
    """Content hash of a request: equal requests are asked once."""
    return F.sha2(F.concat_ws(FIELD, *(F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields)), 256)


def within_budget(payload: Column, most_bytes: int) -> Column:
    """The payload if its UTF-8 form fits, else an error: never cut short."""
    return F.when(F.octet_length(payload) <= most_bytes, payload).otherwise(F.raise_error(F.lit("input budget exceeded")).cast("string"))


def redact(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("[redacted]")) if secret else text


def counterpart_id(row_id: Column, other: Column) -> Column:
    """The same template and line for the other character."""
    return F.concat(F.regexp_replace(row_id, r"-[^-]*\z", ""), F.lit("-"), other)


def character_of(row_id: Column) -> Column:
    return F.substring_index(row_id, "-", -1)
