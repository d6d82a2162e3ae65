"""Every query of the engine by name, with the SQL that states its result where SQL can."""

from __future__ import annotations

from payloom.plans import documents, matching, money, service
from payloom.plans.register import ORACLES, QUERIES

__all__ = ["documents", "matching", "money", "service"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
