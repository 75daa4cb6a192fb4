"""Literal KEY=value configuration. Nothing is expanded or run; the environment wins over the file.

A line is blank, a comment, or KEY=value with a KEY of capitals, digits and underscores. A value is bare, or
stands whole in one pair of equal quotes.
"""

from __future__ import annotations

import os
import re

_LINE = re.compile(r"\s*(?:#.*|(?P<key>[A-Z][A-Z0-9_]*)\s*=\s*(?:(?P<quote>[\"'])(?P<quoted>.*)(?P=quote)|(?P<bare>(?![\"']).*?))\s*)?")


def settings(text: str, known: tuple[str, ...], environment: dict[str, str] | None = None) -> dict[str, str]:
    """The known keys' values; ValueError for a line of another form, an unclosed quote, an unknown or a repeated key."""
    pairs = []
    for number, line in enumerate(text.lstrip("\ufeff").splitlines(), 1):
        m = _LINE.fullmatch(line)
        if m is None:
            raise ValueError(f"line {number} is not KEY=value, or its quote is not closed")
        if m["key"]:
            pairs.append((m["key"], m["bare"] if m["quote"] is None else m["quoted"]))
    keys = [k for k, _ in pairs]
    odd = [k for k in keys if k not in known or keys.count(k) > 1]
    if odd:
        raise ValueError(f"unknown or repeated key {odd[0]}")
    env = os.environ if environment is None else environment
    return dict(pairs) | {k: env[k] for k in known if k in env}


def settings_file(path: str | None, known: tuple[str, ...], environment: dict[str, str] | None = None) -> dict[str, str]:
    """settings() of a file on the driver; a path that is given must exist."""
    if path is None:
        return settings("", known, environment)
    with open(path, encoding="utf-8") as f:
        return settings(f.read(), known, environment)
