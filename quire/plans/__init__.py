"""Queries over the engine's operators, each with its oracle."""

from __future__ import annotations

from quire.plans import pages, records, rendering, structures  # noqa: F401
from quire.plans.base import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
