"""All registered queries of the reference's operators, and the SQL that states them."""

from __future__ import annotations

from . import aggregates, files, flows, helpers, joins, questions, retrieval, scalars, scans, sequences  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
