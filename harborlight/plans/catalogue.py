"""All queries of the package by name. Importing the modules registers their queries."""

from __future__ import annotations

from harborlight.plans import corpus, dialogue, events, extras, screening  # noqa: F401
from harborlight.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
