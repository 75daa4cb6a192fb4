"""Strict validation of judge responses: the first failing rule names the error.

Parsing goes through VARIANT inside a one-element array, which refuses trailing text; repeated keys
are refused at any depth. A score counts only as a genuine integer. A response is parsed once and each
of its objects is opened once: they are bound to lambda variables, since a Column that is named in
many conditions would be evaluated anew in each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .protocol import ATTRIBUTION_PROTOCOL, DIMENSIONS, PAIR_PROTOCOL


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``x``, which is evaluated once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def parsed(raw: Column) -> Column:
    """The one JSON value of ``raw`` as VARIANT, or null."""
    one = lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))
    return _let(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), one)


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _opened(v: Column) -> Column:
    """The members of an object by key; null for anything else."""
    return _as(v, "map<string,variant>")


def _keys(held: Column, wanted: tuple[str, ...]) -> Column:
    """Whether an opened object has exactly these keys."""
    return F.coalesce(F.sort_array(F.map_keys(held)) == F.array(*(F.lit(k) for k in sorted(wanted))), F.lit(False))


def _string(v: Column) -> Column:
    """A genuine string, or null."""
    return F.when(F.schema_of_variant(v) == "STRING", _as(v, "string"))


def _text(v: Column) -> Column:
    """Whether it is a string of more than white space."""
    return F.coalesce(F.rlike(_string(v), F.lit(r"(?U)\S")), F.lit(False))


def _refs(v: Column) -> Column:
    """The citations there: null unless it is an array of strings."""
    strings = _as(v, "array<string>")
    return _let(F.schema_of_variant(v), lambda shape: F.when(shape == "ARRAY<STRING>", strings).when(shape == "ARRAY<VOID>", F.when(F.size(strings) == 0, F.array().cast("array<string>"))))


def _known(refs: Column, allowed: Column) -> Column:
    return F.coalesce(F.size(F.array_except(refs, allowed)) == 0, F.lit(False))


def _first(errors: Column) -> Column:
    return F.get(F.filter(errors, lambda e: e.isNotNull()), F.lit(0))


def _dimension_error(held: Column, allowed: Column) -> Column:
    """The first rule that one opened score breaks."""

    def rules(x: Column) -> Column:
        scored, kind = x["status"] == "scored", F.schema_of_variant(held["score"])
        number = F.coalesce((kind == "BIGINT") & _as(held["score"], "bigint").between(0, 4), F.lit(False))
        return (
            F.when(~F.coalesce(x["status"].isin("scored", "insufficient"), F.lit(False)), "Invalid dimension status")
            .when(scored & ~number, "Score must be integer in 0..4")
            .when(~scored & (F.coalesce(kind, F.lit("VOID")) != "VOID"), "Non-scored dimension must be null")
            .when(~_text(held["reason"]), "Missing dimension reason")
            .when(~_known(x["refs"], allowed), "Unknown evidence citation")
            .when(F.size(x["refs"]) == 0, "Dimension needs evidence citation")
        )

    whole = _keys(held, ("status", "score", "reason", "evidence_ids"))
    return F.when(~whole, "Invalid dimension schema").otherwise(_let(F.struct(_string(held["status"]).alias("status"), _refs(held["evidence_ids"]).alias("refs")), rules))


def _side_error(side: Column, allowed: Column) -> Column:
    """The first rule that one candidate's opened scores break."""
    each = F.transform(F.array(*(side[d] for d in DIMENSIONS)), lambda v: _let(_opened(v), lambda held: _dimension_error(held, allowed)))
    return F.when(~_keys(side, DIMENSIONS), "Three dimensions required").otherwise(_first(each))


def pair_error(raw: Column, allowed: Column) -> Column:
    """Null for a valid pairwise response, else the first rule that it breaks."""
    fields = ("protocol", "winner", "scores", "reason", "preference_evidence_ids")

    def rules(x: Column) -> Column:
        held, winner = x["held"], x["winner"]
        sides = F.transform(F.array(*(x["scores"][s] for s in ("A", "B"))), lambda v: _let(_opened(v), lambda side: _side_error(side, allowed)))
        return (
            F.when(~_keys(held, fields), "Unexpected judge fields")
            .when(~F.coalesce((_as(held["protocol"], "string") == PAIR_PROTOCOL) & winner.isin("A", "B", "tie", "insufficient"), F.lit(False)), "Invalid judge version/winner")
            .when(~_text(held["reason"]), "Missing pairwise reason")
            .when(~_keys(x["scores"], ("A", "B")), "Both candidates required")
            .when(~_known(x["refs"], allowed), "Unknown evidence citation")
            .when(winner.isin("A", "B") & (F.size(x["refs"]) == 0), "Strict preference needs evidence citation")
            .otherwise(_first(sides))
        )

    top = lambda held: F.struct(held.alias("held"), _string(held["winner"]).alias("winner"), _opened(held["scores"]).alias("scores"), _refs(held["preference_evidence_ids"]).alias("refs"))
    return _let(parsed(raw), lambda v: F.when(v.isNull(), "Invalid JSON").otherwise(_let(_opened(v), lambda held: _let(top(held), rules))))


def attribution_error(raw: Column, speakers: tuple[str, ...]) -> Column:
    def rules(held: Column) -> Column:
        return (
            F.when(~_keys(held, ("protocol", "speaker", "reason")), "Unexpected attribution fields")
            .when(~F.coalesce((_as(held["protocol"], "string") == ATTRIBUTION_PROTOCOL) & _string(held["speaker"]).isin(*speakers), F.lit(False)), "Invalid attribution version/speaker")
            .when(~_text(held["reason"]), "Missing attribution reason")
        )

    return _let(parsed(raw), lambda v: F.when(v.isNull(), "Invalid JSON").otherwise(_let(_opened(v), rules)))


def pair_scores(raw: Column) -> Column:
    """winner and the six scores of a valid response; a score is null where it is insufficient."""
    get = lambda v, path, kind: F.try_variant_get(v, f"$.{path}", kind)
    each = lambda v: [get(v, f"scores.{s}.{d}.score", "bigint").alias(f"{s}_{d}") for s in ("A", "B") for d in DIMENSIONS]
    return _let(parsed(raw), lambda v: F.struct(get(v, "winner", "string").alias("winner"), *each(v)))


def envelope(raw: Column, failed: Column, truncated: Column, error: Column) -> Column:
    """ok, parse_error, incomplete_response or inference_error."""
    return F.when(failed, "inference_error").when(truncated, "incomplete_response").when(error.isNotNull(), "parse_error").otherwise("ok")


def provider_text(body: Column) -> Column:
    """The text of a provider's reply: all text parts of assistant messages, or the first choice."""
    parts = F.from_json(body, "output array<struct<type:string,role:string,content:array<struct<type:string,text:string>>>>, choices array<struct<message:struct<content:string>>>")
    said = F.flatten(F.transform(F.filter(parts["output"], lambda m: (m["type"] == "message") & (m["role"] == "assistant")), lambda m: F.filter(m["content"], lambda c: c["type"] == "output_text")))
    return F.when(parts["output"].isNotNull(), F.array_join(F.transform(said, lambda c: c["text"]), "")).otherwise(F.get(parts["choices"], F.lit(0))["message"]["content"])
