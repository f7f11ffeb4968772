"""Registry of the engine's queries over the driver's tables and of their SQL."""

from __future__ import annotations

from evloom.plans import base, q_domain, q_identity, q_judged, q_pages, q_ranking, q_reports, q_search, q_texts  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
