"""All registered queries of the ledger engine, with their SQL."""

from __future__ import annotations

from . import bridges, clusters, coordination, features, graph, ingest, learning, profiles, relational, reports, suspicion, typology  # noqa: F401  modules register their queries when they are read
from .catalog import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
