"""Every query of the core, with the SQL that states the same result."""

from __future__ import annotations

from . import base, corpus, io, nested, pairs, scoring, stats  # noqa: F401 - registration
from .base import Query


def queries() -> dict[str, Query]:
    return nested.QUERIES | base.QUERIES


def oracle_sql() -> dict[str, str]:
    return nested.SQL | base.SQL
