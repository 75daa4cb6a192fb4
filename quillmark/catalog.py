"""Registry of the reward-analytics queries and their SQL oracles."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES
from .streaming.queries import STREAM_ORACLES, STREAM_QUERIES


def queries() -> dict:
    return {**QUERIES, **STREAM_QUERIES}


def oracle_sql() -> dict:
    return {**ORACLES, **STREAM_ORACLES}
